from pyspark.sql import functions as F

from notefold.operators import models


def test_budget_grows_and_failures_stay_values(spark):
    class Short:
        def complete(self, prompt, budget):
            if prompt == "blank":
                return " "
            if budget < 4_000:
                raise models.CutShort(str(budget))
            return str(budget)

    df = spark.createDataFrame([("a",), ("blank",)], "prompt string")
    got = {r["prompt"]: (r["answer"], r["error"]) for r in models.asked(df, Short, budget=1_000, delay=0.01).collect()}
    assert got == {"a": ("4048", None), "blank": (None, "ValueError: empty answer")}
    assert models.asked(df.where("prompt = 'a'"), Short, budget=1_000, cap=3_000).first()["error"] == "CutShort: 3000"


def test_quick_read_prompt(spark):
    df = spark.createDataFrame([("T {text}", "p.pdf", 3, "body")], "t string, p string, n int, b string")
    prompt = df.select(models.quick_read_prompt(*(F.col(c) for c in "tpnb")).alias("x")).first()["x"]
    assert "论文标题：T {text}\n来源路径：p.pdf\n页数：3\n" in prompt and prompt.endswith("```text\nbody\n```") and "%%{init}%%" in prompt


def test_missing_translations_are_appended_whole(spark):
    class Upper:
        def complete(self, prompt):
            if "fail" in prompt:
                raise OSError("no")
            return prompt.split("\n\n", 1)[1].upper()

    done = "# N\n\n## 全文翻译\n" + "译" * 200
    rows = [(1, "# N", "\n\n".join("word%d" % i for i in range(30))), (2, done, "x"), (3, "# N", "ok\n\nfail"), (4, "# N", None)]
    got = {r["id"]: r for r in models.with_translation(spark.createDataFrame(rows, "id int, m string, t string"), "id", "m", "t", "译", Upper, 40).collect()}
    assert got[1]["text"].split() == ["#", "N", "##", "全文翻译", *("WORD%d" % i for i in range(30))] and got[1]["n_chunks"] > 3
    assert got[2]["text"] == done and got[2]["n_chunks"] == 0
    assert got[3]["n_failed"] == 1 and got[3]["text"].endswith(models.NOT_TRANSLATED) and got[4]["text"].endswith(models.NOT_TRANSLATED)


def test_dialogues(spark):
    class Told:
        def complete(self, prompt):
            if "broken" in prompt:
                raise OSError("no")
            return "是" if prompt.split("转录文本片段：\n")[1].startswith("A:") else "否"

    df = spark.createDataFrame([(1, "A: x B: y"), (2, "plain"), (3, "A: broken"), (4, None)], "id int, t string")
    assert {r["id"]: r["is_dialogue"] for r in models.dialogues(df, "id", "t", Told).collect()} == {1: True, 2: False, 3: False, 4: False}
