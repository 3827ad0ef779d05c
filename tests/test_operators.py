import random

import pytest
from pyspark.sql import functions as F

from notefold.operators import conversation, frames, manifest, models, pages, terms, validate
from notefold.operators.chunk import NOTE_MARKS, chunks, consecutive, overlapping, packed_pages


def words(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(["word ", "句。", "\n", "\n\n", "\n## H\n"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_overlapping_chunks(seed):
    t = words(300, seed)
    spans = overlapping(t, 120, 30, NOTE_MARKS)
    assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(b - a <= 120 for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c == b - 30 and t.startswith(NOTE_MARKS, b) and b < d
    assert "".join(t[a:b] for a, b in consecutive(t, 90)) == t


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "x" * 50), (2, None), (3, ""), (4, "y" * 1000)], "id bigint, text string")
    got = {(r["id"], r["chunk_no"]): len(r["text"]) for r in chunks(df, "id", "text", 400, 100).collect()}
    assert got == {(1, 1): 50, (3, 1): 0, (4, 1): 400, (4, 2): 400, (4, 3): 400}
    assert {r["id"] for r in chunks(df, "id", "text", 400, style="plain").collect()} == {1, 4}


def test_packed_pages():
    got = packed_pages([(1, "a" * 20), (2, None), (3, "b" * 20)], 60, 1)
    assert [n for n, _ in got] == ["1, 2", "2, 3"] and all(len(t) <= 60 for _, t in got)


def test_upsert_by_any_key(spark):
    schema = "pos int, path string, url string, status string"
    old = spark.createDataFrame([(1, "a", "u1", "x"), (2, "b", None, "x"), (3, None, "u1", "x"), (4, "", "", "x")], schema)
    new = spark.createDataFrame([(10, "a", None, "n1"), (11, None, "u1", None), (12, "c", "", "n3"), (13, "b", "u9", "n4"), (14, "", "", "n5")], schema)
    got = {tuple(r) for r in manifest.upsert_any(old, new, ["path", "url"], "pos").collect()}
    assert got == {(1, "a", "u1", "x"), (2, "b", "u9", "n4"), (3, None, "u1", "x"), (4, "", "", "x"), (12, "c", "", "n3"), (14, "", "", "n5")}


def test_positions_snapshots_history(spark):
    df = spark.createDataFrame([(i, f"s{i}", None) for i in range(4)], "i int, s string, manual string")
    assert [r["i"] for r in manifest.drop_positions(df, "i", [0, 2, 2]).orderBy("i").collect()] == [1, 3]
    with pytest.raises(ValueError):
        manifest.drop_positions(df, "i", [9])
    set_ = manifest.set_at(df, "i", [0, 2], "manual", "rebuild").orderBy("i").collect()
    assert [r["manual"] for r in set_] == ["rebuild", None, "rebuild", None]
    after = spark.createDataFrame([(0, "s0", None), (1, "S", None), (2, "s2", "x"), (7, "n", None)], "i int, s string, manual string")
    assert {r["i"] for r in manifest.changed(df, after, "i", ["s", "manual"]).collect()} == {1, 2, 7}
    events = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, n int")
    assert [tuple(r) for r in manifest.bounded_history(events, "id", "n", 1).collect()] == [("a", 3)]


def test_rollup(spark):
    df = spark.createDataFrame([("a", "ok"), ("a", "bad"), (None, "ok")], "k string, s string")
    got = {(r["k"], r["is_total"]): (r["items"], r["ok"], r["bad"]) for r in manifest.status_rollup(df, "k", F.col("s"), ["ok", "bad"]).collect()}
    assert got == {("a", False): (2, 1, 1), (None, False): (1, 1, 0), (None, True): (3, 2, 1)}


def test_not_known(spark):
    entries = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z"), ("4", None)], "avid string, bvid string")
    known = {"avid": spark.createDataFrame([("1",), (None,)], "a string"), "bvid": spark.createDataFrame([("y",)], "b string")}
    assert {tuple(r) for r in manifest.not_known(entries, known).select("avid", "bvid").collect()} == {(None, "z"), ("4", None)}
    notes = spark.createDataFrame([("a/t_BV1x.md", "see BV0123456789 ok"), ("a/t_77.md", None), ("plain.md", "")], "path string, body string")
    bvid, avid = manifest.known_ids(notes)
    assert {r[0] for r in bvid.collect()} == {"BV1x", "BV0123456789"} and {r[0] for r in avid.collect()} == {"77"}


def test_terms(spark):
    texts = spark.createDataFrame([(1, "买600519和 000001.SZ，茅台好"), (2, "nothing"), (3, None)], "id int, t string")
    listed = spark.createDataFrame([("贵州茅台", "600519.SH"), ("茅台", "999999.SH"), ("平安", "000001.SZ"), (None, None)], "name string, code string")
    got = [tuple(r) for r in terms.reference_terms(texts, "id", "t", listed, "code", "name").orderBy("rank").collect()]
    assert {g[2] for g in got} == {"000001.SZ", "999999.SH"} and got[0][2] == "000001.SZ"
    assert terms.names_in(texts, "id", "t", listed.limit(0), "name").count() == 0


def test_frames(spark):
    df = spark.createDataFrame([([1.0, 3.0, 9.0, 10.0, 20.0], 100.0)], "t array<double>, d double")
    t = F.col("t")
    row = df.select(frames.thinned(t, 6.0, 9), frames.even_grid(F.col("d"), 3), frames.chosen_times(F.col("d"), t, 3), frames.nearest(F.lit(8.0), t, F.lit(2.0)), frames.nearest(F.lit(50.0), t, F.lit(2.0))).first()
    assert list(row) == [[1.0, 9.0, 20.0], [25.0, 50.0, 75.0], [3.0, 20.0, 50.0], 9.0, 50.0]
    black, ramp = [0] * 256, list(range(256))
    f = spark.createDataFrame([([(1.0, black), (10.0, ramp), (20.0, ramp), (30.0, ramp[::-1]), (32.0, ramp[::2] * 2)],)], "f array<struct<t:double,f:array<int>>>")
    assert f.select(frames.usable_frames(F.col("f"), 5, 256, 18.0, 245.0, 7.0, 10.0, 5.0)).first()[0] == [10.0, 30.0]
    md = "# t\n\n## 结论\n\n关键在于这一点，因此应当记录下来并且反复核对。\n\n短。\n\n" + "另一段没有标记的普通说明文字，长度足够被计入候选。\n\n" * 3
    points = spark.createDataFrame([(md,)], "m string").select(frames.spaced_best(frames.scored_blocks(F.col("m")), F.lit(7), 2)).first()[0]
    assert points[0]["heading"] == "结论" and len(points) == 2 and points[0]["idx"] < points[1]["idx"]


def test_pages(spark):
    df = spark.createDataFrame([(1, "s", "x" * 200), (2, "s", " "), (3, "s", None), (1, "t", "y" * 50)], "page int, source string, text string")
    got = {r["source"]: (r["n_signs"], r["n_sparse"], r["needs_ocr"]) for r in pages.amounts(df, ["source"]).collect()}
    assert got == {"s": (200, 2, True), "t": (50, 0, True)}
    other = spark.createDataFrame([(2, "s", "z" * 40), (3, "s", "short")], "page int, source string, text string")
    new = {r["page"]: r["was_replaced"] for r in pages.replaced(df.where("source = 's'"), other, ["source", "page"]).collect()}
    assert new == {1: False, 2: True, 3: False} or new == {1: None, 2: True, 3: False}
    total = spark.createDataFrame([("s", 4), ("t", 1), ("u", 0)], "source string, total int")
    assert {tuple(r) for r in pages.missing(total, df, ["source"]).select("source", "page").collect()} == {("s", 3), ("s", 4)}


def test_conversation(spark):
    export = """{"name":"c","messages":[{"role":"user","content":"hi"},{"versions":[{"role":"a","content":"old"},{"role":"assistant","content":[{"text":"x"},{"content":"y"}],
        "senderInfo":{"senderName":"S"}}],"currentlySelected":1},{"versions":[{"role":"assistant","steps":[{"content":"p"},{"content":"q","genInfo":{"identifier":"m"}}]}],"currentlySelected":9},{"role":""}]}"""
    df = spark.createDataFrame([(1, export), (2, "{broken"), (3, None)], "id int, j string")
    turns = conversation.exported_turns(df, "id", "j")
    assert [(r["turn"], r["role"], r["sender"], r["text"]) for r in turns.where("id = 1").orderBy("turn").collect()] == [(1, "user", "", "hi"), (2, "assistant", "S", "x\n\ny"), (3, "assistant", "m", "p\n\nq"), (4, "unknown", "", "")]
    text = conversation.rendered(turns.where("id = 1")).first()["text"]
    assert text.startswith("### 1. user\n\nhi\n\n### 2. assistant (S)\n\nx\n\ny") and text.endswith(conversation.EMPTY_MESSAGE)
    back = conversation.marked_turns(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("turn").collect()
    assert [(r["turn"], r["role"], r["sender"]) for r in back] == [(1, "user", ""), (2, "assistant", "S"), (3, "assistant", "m"), (4, "unknown", "")]


def test_models(spark):
    notes = spark.createDataFrame([(1, "p. " * 200), (2, "FAIL " * 5), (3, "short")], "id bigint, text string")
    got = {r["id"]: r for r in models.organised(notes, "id", "text", models.EchoModel, 100, 20, 150).collect()}
    assert got[1]["n_chunks"] > 5 and got[1]["text"] and got[2]["n_failed"] == 1 and got[2]["text"] is None and got[3]["n_chunks"] == 1
    filled = models.placeholders_filled(notes.select("id", F.concat("text", F.lit("【x】")).alias("text")), "id", "text", {"【x】": "ask", "【y】": "no"}, models.EchoModel)
    assert {r["id"]: (r["n_filled"], r["n_failed"], "【x】" in r["text"]) for r in filled.collect()} == {1: (1, 0, False), 2: (0, 1, True), 3: (1, 0, False)}

    class Bad:
        def read(self, image):
            raise OSError("no")

    class Good:
        def read(self, image):
            return image.decode()

    images = spark.createDataFrame([("a", b"text"), ("b", b" ")], "path string, content binary")
    assert {r["path"]: (r["text"], r["error"]) for r in models.read_images(images, [Bad, Good]).collect()} == {"a": ("text", None), "b": (None, "OSError: no")}


def test_validation(spark):
    rows = [(1, "---\nsource_url: x\nstatus: organized\n---\n## 原文抽取\nx"), (2, "draft_path: y"), (3, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {}
    for r in validate.violations(df, "id", "t", F.lit("source")).collect():
        got.setdefault(r["id"], set()).add(r["rule"])
    assert got == {2: {"draft path", "no source", "not organised", "original missing"}, 3: {"no source", "not organised", "original missing"}}
    notes = spark.createDataFrame([(1, "n/a.md", "![x](img/b%20c.png) ![y](../z.png) ![w](http://h/i.png)")], "id int, path string, body string")
    files = spark.createDataFrame([("n/img/b c.png",)], "path string")
    assert [tuple(r) for r in validate.missing_images(notes, "id", "path", "body", files).collect()] == [(1, "../z.png", "z.png")]
