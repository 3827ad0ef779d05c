import io
import json
import zipfile

from pyspark.sql import functions as F

from notefold.functions.html import page_markdown, page_metadata
from notefold.sources import files, sinks
from notefold.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = package({
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p>'
    '<w:p><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>',
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
    "word/_rels/document.xml.rels": RELS.format('<Relationship Id="r1" Target="http://x"/>'),
})
XLSX = package({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Two" r:id="r2"/><sheet name="One" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/>'),
    "xl/sharedStrings.xml": f"<sst {S}><si><t>sh</t></si></sst>",
    "xl/worksheets/a.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c></row><row><c r="A2"><v> </v></c></row></sheetData></worksheet>',
    "xl/worksheets/b.xml": f'<worksheet {S}><sheetData><row><c r="B1" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
})
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PPTX = package({
    "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="r1" Target="slides/s1.xml"/><Relationship Id="r2" Target="slides/s2.xml"/>'),
    "ppt/slides/s1.xml": f"<p:sld {P}><a:t>one</a:t><a:t> more </a:t></p:sld>",
    "ppt/slides/s2.xml": f"<p:sld {P}><a:t>two</a:t></p:sld>",
})


def test_files(spark, tmp_path):
    (tmp_path / "sub" / ".obsidian").mkdir(parents=True)
    for name, data in {"a.docx": DOCX, "b.xlsx": XLSX, "c.pptx": PPTX, "broken.docx": b"no", "t.csv": "﻿h,i\n a ,\"x|y\"\n,\n".encode(), "n.md": "中文".encode("gb18030"), "sub/.obsidian/x.md": b"x", "sub/m.md": b"ok"}.items():
        (tmp_path / name).write_bytes(data)
    root = "file://" + str(tmp_path)
    found = files.discover(spark, root)
    assert [(r["kind"], r["path"].rpartition("/")[2]) for r in found.collect()] == [("document", "a.docx"), ("document", "broken.docx"), ("tabular", "b.xlsx"), ("tabular", "t.csv"), ("presentation", "c.pptx")]
    assert files.discover(spark, root, 1).count() == 3
    docs = {r["path"].rpartition("/")[2]: r for r in files.documents(spark, root).collect()}
    assert docs["a.docx"]["text"] == "## Top\n\n  - item\n\n[link](http://x)\n\n| a\\|b |  |\n| --- | --- |" and docs["broken.docx"]["error"].startswith("BadZipFile")
    assert [(r["sheet"], r["row_no"], r["cells"]) for r in files.workbooks(spark, root).collect()] == [("Two", 1, ["", "in"]), ("One", 1, ["sh", "", "TRUE"])]
    assert [(r["slide_no"], r["text"]) for r in files.presentations(spark, root).collect()] == [(1, "two"), (2, "one\nmore")]
    assert [r["cells"] for r in files.tables(spark, root).orderBy("row_no").collect()] == [["h", "i"], ["a", "x|y"]]
    assert {r["path"].rpartition("/")[2]: r["text"] for r in files.texts(spark, root).collect()} == {"n.md": "中文", "m.md": "ok"}


def test_manifests_settings_logs(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a-manifest.json").write_text(json.dumps({"items": [{"source": "s", "status": "ok"}, {"source": "t"}]}))
    (tmp_path / "env").write_text("# c\nA=1\nB = 'x=y'\nA=2\n\n")
    got = files.manifests(spark, "file://" + str(tmp_path), "source:string,status:string").orderBy("position").collect()
    assert [(r["position"], r["source"], r["status"]) for r in got] == [(0, "s", "ok"), (1, "t", None)]
    assert {r["key"]: r["value"] for r in files.settings(spark.read.text("file://" + str(tmp_path / "env"))).collect()} == {"A": "2", "B": "x=y"}
    lines = spark.createDataFrame([(1, 'R:{"k":1}'), (2, "noise"), (3, 'R:{"k":2}'), (4, "R")], "n int, value string").withColumn("g", F.lit("g"))
    assert files.last_structured(lines, "R:", "n", ["g"], "k int").first()["result"]["k"] == 2
    listing = "COLLECTION_TOTAL:2\n  - AVID: 1\n    BVID: B\n    TITLE: a: b\n  - AVID: 2\n    DURATION: 3\n"
    e = spark.createDataFrame([(listing,)], "t string").select(files.scanned_entries(F.col("t"))).first()[0]
    assert e == [{"avid": "1", "bvid": "B", "title": "a: b"}, {"avid": "2", "duration": "3"}]


def test_sidecar(spark):
    media = spark.createDataFrame([("d/a.mp4",), ("d/b.mp4",), ("e/a.mp4",)], "path string")
    subs = spark.createDataFrame([("d/a_zh.srt", 1), ("d/a.srt", 1), ("d/b_x.srt", 5), ("d/b_a.srt", 5), ("d/b.srt", 0)], "path string, size int")
    assert {tuple(r) for r in files.sidecar(media, subs).collect()} == {("d/a.mp4", "d/a.srt"), ("d/b.mp4", "d/b_a.srt")}


PAGE = """<html><head><title>T</title><meta name="author" content="A&amp;B"><script>x</script></head><body><article><h1>Head <b>bold</b></h1><p>one <a href="/l">link</a><p>two<br>lines
<ul><li>a<li>b <img src="i.png" alt="pic"></ul><ol><li><p>x</p><p>y</p></li></ol><blockquote><p>q</p></blockquote><table><tr><th>h<td>v|w<tr><td>only</table><pre> code </pre><div style="display: none">no</div></article></body></html>"""


def test_html():
    assert page_markdown(PAGE, "https://h.example/d/").split("\n\n") == [
        "# Head **bold**", "one [link](https://h.example/l)", "two\nlines", "- a", "- b ![pic](https://h.example/d/i.png)", "1. x\n  y", "> q", "| h | v\\|w |\n| --- | --- |\n| only |  |", "```text\ncode\n```",
    ]
    assert page_metadata(PAGE, "") == {"title": "Head bold", "author": "A&B", "published": "", "description": ""}
    assert page_markdown("") == "" and page_metadata("", "https://h.example/")["title"] == "h.example"


def test_versions(spark, tmp_path):
    target = "file://" + str(tmp_path / "t")
    assert sinks.current_version(spark, target) is None
    sinks.commit_version(spark.range(3), target)
    sinks.commit_version(spark.range(5), target)
    assert sinks.current_version(spark, target).count() == 5


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), "file://" + str(tmp_path / "out")
    schema = "pos int, path string, status string"
    each = ingest.upserting(spark, target, ["path"], "pos")
    for n, rows in enumerate([[(1, "a", "new"), (2, "b", "new")], [(3, "a", "done"), (4, "c", "new")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.drained(ingest.arriving(spark, source, schema), each, str(tmp_path / "ck")).awaitTermination(60)
        assert spark.read.parquet(f"{target}/v={n}").count() == n + 2
    assert {(r["path"], r["status"]) for r in spark.read.parquet(f"{target}/v=1").collect()} == {("a", "done"), ("b", "new"), ("c", "new")}


def test_windows(spark):
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("a", "2024-01-01 01:05:00", 4.0)]
    df = spark.createDataFrame(rows, "u string, t string, value double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert sorted((r["n"], r["total"]) for r in ingest.windowed_counts(df, "t", "u").collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r["n"] for r in ingest.sessions(df, "t", "u").collect()) == [1, 2]
