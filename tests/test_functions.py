import json
import re

import pytest
from pyspark.sql import functions as F

from notefold.functions import markdown as M
from notefold.functions import python_text as P
from notefold.functions import text as T


def one(spark, value, make, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(make(F.col("c")).alias("r")).first()["r"]


CASES = [
    (T.clean_text, " a \r\nb\t\n\n\n\n\nc　", "a\nb\n\n\nc"),
    (T.tidy_markdown, "a b \n\n\n\nc", "a b\n\nc"),
    (T.squeeze_markdown, "a \r\n\r\n\r\n\r\nb", "a \n\nb"),
    (T.compact, "a \t b​\n  c ", "a b\nc"),
    (T.slug, ' a/b: "c"  d. ', "a-b---c--d"),
    (T.slug, " .-", "untitled"),
    (T.slug, "x" * 200, "x" * 120),
    (T.telling_line, "\n  first\nlast", "first"),
    (T.telling_line, "Traceback (most recent call last):\n  x\nValueError: y\n", "ValueError: y"),
    (T.yaml_scalar, "a: b", '"a: b"'),
    (T.yaml_scalar, "plain", "plain"),
    (T.yaml_scalar, 'say "x" 中', '"say \\"x\\" 中"'),
    (T.yaml_scalar, None, ""),
    (T.heading, "x\n# Title \n# Other", "Title"),
    (T.stem, "a/b.c/d.e.md", "d.e"),
    (T.without_details, "<details><summary>s</summary>\n text </details>", "text"),
    (T.listed_code, " 600519 ", "600519.SH"),
    (T.listed_code, "000001", "000001.SZ"),
    (T.listed_code, "abc", "ABC"),
    (T.video_id, "https://x.example/video/BV1ab?p=3", "BV1ab"),
    (T.https, "//x.example/a", "https://x.example/a"),
    (T.iso_seconds, "0", "1970-01-01T00:00:00"),
    (T.iso_seconds, "x", ""),
    (T.iso_millis, "1700000000999", "2023-11-14T22:13:20"),
    (T.duration_text, "3661.5", "1小时1分2秒"),
    (T.duration_text, "59.4", "0分59秒"),
    (T.duration_text, "x", ""),
    (T.duration_minutes, "3661", "61分1秒"),
    (T.dashed_date, "20240102", "2024-01-02"),
    (M.demoted, "## a\n###### b\n# c", "### a\n###### b\n# c"),
    (M.title_from_name, "x/PDF-a_b.md", "a b"),
    (M.original_text, "# T\n\n## 原文抽取\n\nbody\n", "body"),
    (M.original_text, "# T\nbody", "body"),
    (M.model_answer, "<answer> Let's see\n\n# H\nx", "# H\nx"),
    (M.plain_mermaid, "a\n```mermaid\nmindmap\n style x\n  y\n```\nstyle z", "a\n```mermaid\nmindmap\n  y\n```\nstyle z"),
    (M.merged_sections, "i\n\n## A\n1\n\n## B\n2\n\n## A\n1\n\n## A\n3", "i\n\n## A\n\n1\n\n3\n\n## B\n\n2"),
    (M.merged_sections, "no sections\n\n\n\nx", "no sections\n\nx"),
    (M.transcript_of, "a\n<details>\n<summary>📄 原始字幕</summary>\n\nT\n</details>", "T"),
    (M.without_transcript, "a\n---\n## 原始字幕\nT", "a\n"),
    (M.body_of, "---\na: b\n---\n\nbody", "body"),
    (M.asset_path, "a%20b.png#x", "a b.png"),
]


@pytest.mark.parametrize("make,value,want", CASES, ids=[f"{f.__name__}-{i}" for i, (f, _, _) in enumerate(CASES)])
def test_text(spark, make, value, want):
    assert one(spark, value, make) == want


def test_numbers(spark):
    assert [one(spark, v, T.duration_seconds) for v in ("1小时2分3秒", "02:03", "1:02:03", "130:25", "61.5", "", "未知", None)] == [3723, 123, 3723, 7825, 62, None, None, None]
    assert [one(spark, v, T.clock_text, "double") for v in (59.5, 60.5, 3661.0)] == ["01:00", "01:00", "01:01:01"]
    assert [one(spark, v, T.unset_or_positive) for v in (None, " ", "0", "-4", "7", "x")] == [-1, -1, 0, 0, 7, 0]
    assert one(spark, ["3", "1", "bad", "-1", "3"], T.whole_numbers, "array<string>") == [3, 1, 3]
    assert [one(spark, v, T.yes) for v in ("Yes", " on ", "0", None)] == [True, True, False, False]
    assert [one(spark, v, T.sheet_column) for v in ("A1", "Z9", "AA10", "BC2")] == [0, 25, 26, 54]
    assert [one(spark, v, T.part_number) for v in ("u?p=3", "u?p=0", "u")] == [3, 1, 1]


def test_tags_links_and_tables(spark):
    assert one(spark, '[a, "b" ,]', T.split_tags) == ["a", "b"] and one(spark, " x ", T.split_tags) == ["x"] and one(spark, None, T.split_tags) == []
    assert one(spark, "[[b|x]] ![i](p.png) [l](<http://z>) [[a]]", M.links) == ["a", "b", "http://z", "p.png"]
    assert one(spark, "![i](p.png) ![j](http://x/y.png)", M.local_assets) == ["p.png"]
    assert one(spark, '![i](p.png) <IMG src="q.gif">', M.image_targets) == ["p.png", "q.gif"]
    assert one(spark, [["h", "i"], ["a|b"]], M.table, "array<array<string>>") == "| h | i |\n| --- | --- |\n| a\\|b |  |"
    assert one(spark, [], M.table, "array<array<string>>") == M.EMPTY_TABLE


def test_frontmatter_round_trip(spark):
    md = '---\ntitle: "a: b"\ntags:\n  - x\n  - \'y\'\nempty:\nnot a field\nstatus: organized\n---\n\nBody: z'
    fields = [(f["k"], f["v"], f["many"]) for f in one(spark, md, M.frontmatter_fields)]
    assert fields == [("title", ["a: b"], False), ("tags", ["x", "y"], True), ("empty", [], True), ("status", ["organized"], False)]
    assert one(spark, md, lambda c: M.frontmatter_value(c, "status")) == "organized"
    assert one(spark, "no fence", M.frontmatter_fields) == [] and one(spark, md, lambda c: M.any_line_value(c, "Body")) == "z"
    df = spark.createDataFrame([("t", ["a", "b: c"], None)], "title string, tags array<string>, author string")
    out = df.select(M.render_frontmatter([("tags", F.col("tags")), ("author", F.col("author")), ("title", F.col("title"))])).first()[0]
    assert out == '---\ntitle: t\ntags:\n  - a\n  - "b: c"\n---'


def test_sections(spark):
    md = "# t\n\n## A\n\nold\n\n## B\n\nb\n---\n## 原始字幕\nraw"
    put = one(spark, md, lambda c: M.with_section(c, "A", F.lit("## A\n\nnew $1")))
    assert "new $1" in put and "old" not in put and put.endswith("raw")
    added = one(spark, md, lambda c: M.with_section(c, "C", F.lit("## C\n\nc")))
    assert re.search(r"b\n\n## C\n\nc\n\n---\n## 原始字幕\nraw$", added)
    assert one(spark, "x【a】y", lambda c: M.filled(c, "【a】", F.lit(" v "))) == "xvy" and one(spark, "x【a】", lambda c: M.filled(c, "【a】", F.lit(""))) == "x【a】"
    assert one(spark, "## 全文翻译\n" + "字" * 200, M.translated) and not one(spark, "## 全文翻译\n待处理" + "字" * 200, M.translated)


def test_merged_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"})], "o map<string,string>, n map<string,string>")
    assert df.select(T.merged(F.col("o"), F.col("n"))).first()[0] == {"a": "1", "b": None, "c": "3"}


def test_python_functions(spark):
    df = spark.createDataFrame([("a&amp;b", "x\\u4e2d", '{"b":1,"a":[2]}', b"\xc4\xe3\xba\xc3")], "a string, b string, c string, d binary")
    row = df.select(P.unescaped("a"), P.script_literal("b"), P.canonical_json_hash("c"), P.decoded("d"), P.absolute_url("a", F.lit("https://h/x/")), P.safe_name(F.lit(' é/ü: x_y "z" '))).first()
    import hashlib

    assert list(row)[:5] == ["a&b", "x中", hashlib.sha256(json.dumps({"a": [2], "b": 1}).encode()).hexdigest(), "你好", "https://h/x/a&b"] and row[5] == "éü-x_y-z"
    rich = spark.createDataFrame([('{"nodes":[{"text":"a"},{"rich":{"text":"b"}}]}', '{"x":[{"src":"//h/a.png"},{"url":"http://h/a.txt"},{"cover":"//h/a.png"}]}')], "a string, b string")
    assert list(rich.select(P.rich_text("a"), P.image_urls("b")).first()) == ["ab", ["https://h/a.png"]]


def test_assets_and_heads(spark):
    df = spark.createDataFrame([("![a](http://x/1.png) ![b](http://x/2.png)", {"http://x/1.png": "assets/1.png"})], "m string, l map<string,string>")
    assert df.select(M.with_local_assets(F.col("m"), F.col("l"))).first()[0] == "![a](assets/1.png) ![b](http://x/2.png)"
    assert tuple(one(spark, "source \nthe words\nmore", M.headed)) == ("source", "the words\nmore")
