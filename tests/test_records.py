import json

from pyspark.sql import functions as F

from notefold.functions import records as R
from notefold.sources.feeds import paged


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("r")).first()["r"]


def payload(major=None, **data):
    item = {"item": {"id_str": "7", "modules": {"module_dynamic": {"major": major}}}} if major else {}
    return json.dumps({"code": 0, "data": item | data})


def test_payloads(spark):
    opus = payload({"type": "MAJOR_TYPE_OPUS", "opus": {"title": "t", "summary": "s"}})
    blocked = payload({"type": "MAJOR_TYPE_BLOCKED", "blocked": {"hint_message": "hint", "button": {"text": "go", "jump_url": "u"}}})
    video = payload(bvid="BV1", title="t", pages=[{"cid": 5, "page": 1}])
    kinds = [one(spark, p, R.payload_kind) for p in (opus, blocked, video, '{"code":-412}', "{}", "no json", None)]
    assert kinds == ["opus", "blocked", "video", "refused", "unknown", "unknown", "unknown"]
    assert one(spark, blocked, R.blocked_message) == "hint；go u" and one(spark, video, R.payload_video) == "BV1"


def test_choices(spark):
    assert one(spark, '{"body":[{"content":" a "},{"content":""},{"content":"b"}]}', R.subtitle_text) == "a\nb" and one(spark, "x", R.subtitle_text) == ""
    pages = [(5, 1), (6, 2)]
    df = spark.createDataFrame([(pages,)], "p array<struct<cid:bigint,page:int>>")
    assert [df.select(R.chosen_part(F.col("p"), F.lit(n))).first()[0][0] for n in (0, 2, 9)] == [5, 6, 6]
    subs = [("en", 0, 1, "a"), ("zh-CN", 1, 2, "b"), ("zh-CN", 0, 9, "c")]
    df = spark.createDataFrame([(subs,)], "s array<struct<lan:string,is_ai:int,id:int,url:string>>")
    assert df.select(R.chosen_subtitle(F.col("s"))).first()[0]["url"] == "c"
    df = spark.createDataFrame([(["a"],)], "t array<string>")
    assert [df.select(R.appended(F.col("t"), F.lit(x))).first()[0] for x in (" a ", "b\n c", "展开", "")] == [["a"], ["a", "b c"], ["a"], ["a"]]


def test_rendering(spark):
    assert tuple(one(spark, "ab  cd", lambda c: R.truncated(c, 4))) == ("ab", 2, 6, True)
    assert one(spark, ["x", "y", "x"], R.domain_prompts, "array<string>") == ["6a) x", "6b) y"]
    assert "| n |" in one(spark, [["n"], ["v"]], lambda c: R.terms_section(c, "T"), "array<array<string>>") and "未识别" in one(spark, [["n"]], lambda c: R.terms_section(c, "T"), "array<array<string>>")
    text = one(spark, [("s", "t", "f.png", "")], lambda c: R.frames_section(c, F.lit("d")), "array<struct<section:string,title:string,file:string,snippet:string>>")
    assert text.endswith("### s · t\n\n![t](assets/d/f.png)\n\n> —")
    assert one(spark, "體a", lambda c: R.simplified(c, "體", "体")) == "体a"


def test_tables(spark):
    h = spark.createDataFrame([("1", "running", None, None), ("2", "odd", "l", ["o"]), (None, "success", "", [])], "id string, status string, log string, outputs array<string>")
    assert {r["id"]: (r["status"], r["log"], r["outputs"]) for r in R.loaded_history(h).collect()} == {"1": ("interrupted", "", []), "2": ("failed", "l", ["o"])}
    f = spark.createDataFrame([("fav", "1", None), ("fav", "1", "skipped"), ("fav", "2", "rebuild")], "collection_type string, collection_id string, manual_status string")
    assert R.retryable(f, "fav", "1").count() == 1
    items = spark.createDataFrame([(1, "未知"), (2, "5秒"), (3, None)], "k int, d string")
    probed = spark.createDataFrame([(1, "9秒"), (2, "9秒")], "k int, d string")
    assert {r["k"]: (r["d"], r["was_repaired"]) for r in R.repaired(items, "d", probed, "k").collect()} == {1: ("9秒", True), 2: ("5秒", False), 3: (None, False)}
    assert {tuple(r) for r in R.with_extras(items, spark.createDataFrame([(1, ""), (3, "x")], "k int, d string"), "k").collect()} == {(1, "未知"), (2, "5秒"), (3, "x")}


def test_feeds(spark):
    def fetch(feed, cursor):  # local, so that it is shipped by value
        pages = {"": ([("a", "1"), ("b", "2")], "p2"), "p2": ([("b", "again"), ("c", "3")], "p2")}
        return pages[cursor] if feed == "x" else ([], None)

    got = {(r["feed"], r["id"]): (r["position"], r["payload"]) for r in paged(spark, fetch, ["x", "y"]).collect()}
    assert got == {("x", "a"): (0, "1"), ("x", "b"): (1, "2"), ("x", "c"): (3, "3")}
    assert paged(spark, fetch, ["x"], 1).count() == 1
