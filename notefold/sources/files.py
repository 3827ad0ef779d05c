"""Files as tables: discovery by kind, texts in any encoding, office packages, subtitles, logs, settings.

Every reader starts from ``binaryFile`` or ``text`` and stays lazy; packages are opened in Arrow batches on the executors.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions.python_text import decoded
from notefold.functions.text import blank_as_null, strip
from notefold.operators.manifest import sampled_by_kind
from notefold.session import bounded_batches

# Kinds of source in the order they are listed, with their endings; media endings; folders left out.
KINDS = {
    "pdf": ("pdf",),
    "conversation": ("conversation.json",),
    "document": ("doc", "docx"),
    "tabular": ("csv", "tsv", "xlsx"),
    "presentation": ("pptx",),
    "html": ("html", "htm"),
    "image": ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"),
}
MEDIA = ("mp4", "mkv", "mov", "avi", "flv", "webm", "m4v", "ts", "mp3", "m4a", "wav", "flac", "aac", "ogg", "opus")
SKIPPED = (".obsidian", ".git", ".trash", "node_modules", "assets", "templates", "epub")
_XML = "{http://schemas.openxmlformats.org/%s}"
W, S, A, R = (_XML % x for x in ("wordprocessingml/2006/main", "spreadsheetml/2006/main", "drawingml/2006/main", "package/2006/relationships"))
LINKED = _XML % "officeDocument/2006/relationships"


def _files(spark: SparkSession, root: str, endings: tuple[str, ...], recursive: bool = True) -> DataFrame:
    glob = "*{" + ",".join(f".{e}" for e in endings) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)


def discover(spark: SparkSession, root: str, per_kind: int | None = None) -> DataFrame:
    """``kind, kind_rank, path, size, modified`` of the sources under a folder, by kind and path; contents stay unread."""
    found = [
        _files(spark, root, endings).select(F.lit(kind).alias("kind"), F.lit(i).alias("kind_rank"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        for i, (kind, endings) in enumerate(KINDS.items())
    ]
    every = reduce(DataFrame.unionByName, found)
    return (sampled_by_kind(every, "kind", "path", per_kind) if per_kind else every).orderBy("kind_rank", "path")


def media(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    return _files(spark, root, MEDIA, recursive).where(~F.substring_index("path", "/", -1).startswith(".")).select("path", F.col("length").alias("size")).orderBy("path")


def texts(spark: SparkSession, root: str, ending: str = "md", skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """``path, text, size, modified`` of text files; valid UTF-8 is read on the JVM, other bytes by trying encodings."""
    hit = reduce(Column.__or__, [F.col("path").contains(f"/{s}/") for s in skipped], F.lit(False))
    raw = _files(spark, root, (ending,)).where(~hit)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(decoded(F.col("content")))
    return raw.select("path", text.alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def content_hashes(spark: SparkSession, root: str, ending: str) -> DataFrame:
    return _files(spark, root, (ending,)).select("path", F.sha2("content", 256).alias("source_hash"), F.col("length").alias("size"))


def delimited(text: str, delimiter: str) -> list[list[str]]:
    """Rows of a delimited text without empty ones; a quoted line end doesn't join lines."""
    rows = [[re.sub(r"[ \t]+\n", "\n", c).strip() for c in row] for row in csv.reader(text.splitlines(), delimiter=delimiter)]
    return [r for r in rows if any(r)]


def _column(ref: str) -> int:
    return max(0, reduce(lambda a, c: a * 26 + ord(c) - 64, [c for c in ref.upper() if c.isalpha()], 0) - 1)


def _related(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    return {r.get("Id", ""): r.get("Target", "") for r in ElementTree.fromstring(book.read(part)).iter(f"{R}Relationship")} if part in book.namelist() else {}


def workbook(content: bytes) -> list[tuple[str, int, list[str]]]:
    """``(sheet, row number, cells)`` of a workbook, sheets in order, blank rows left out, gaps filled with empty cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(x.itertext()).strip() for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{S}si")]
        targets, out = _related(book, "xl/_rels/workbook.xml.rels"), []
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{S}sheet"):
            part = "xl/" + targets.get(sheet.get(f"{LINKED}id", ""), "").lstrip("/").removeprefix("xl/")
            if part not in names:
                continue
            number = 0
            for row in ElementTree.fromstring(book.read(part)).iter(f"{S}row"):
                cells: list[str] = []
                for cell in row.iter(f"{S}c"):
                    cells += [""] * (_column(cell.get("r", "A1")) - len(cells))
                    kind, value = cell.get("t", ""), (cell.findtext(f"{S}v") or "").strip()
                    if kind == "inlineStr":
                        value = "".join(x.text or "" for x in cell.iter(f"{S}t")).strip()
                    elif kind == "s" and value.isdigit() and int(value) < len(shared):
                        value = shared[int(value)]
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    cells.append(value)
                if any(c.strip() for c in cells):
                    number += 1
                    out.append((sheet.get("name", "Sheet"), number, cells))
        return out


def slides(content: bytes) -> list[tuple[int, str]]:
    """``(slide number, text)`` in order of the presentation."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        targets, out = _related(book, "ppt/_rels/presentation.xml.rels"), []
        main = ElementTree.fromstring(book.read("ppt/presentation.xml"))
        for n, slide in enumerate((x for x in main.iter() if x.tag.endswith("}sldId")), 1):
            part = "ppt/" + targets.get(slide.get(f"{LINKED}id", ""), "").lstrip("/").removeprefix("ppt/")
            if part in book.namelist():
                runs = [(x.text or "").strip() for x in ElementTree.fromstring(book.read(part)).iter(f"{A}t")]
                out.append((n, "\n".join(r for r in runs if r)))
        return out


def document(content: bytes) -> str:
    """Markdown of a text document: headings one level down, lists, tables, links."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        links = _related(book, "word/_rels/document.xml.rels")
        styles = {}
        if "word/styles.xml" in book.namelist():
            for s in ElementTree.fromstring(book.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                styles[s.get(f"{W}styleId", "")] = name.get(f"{W}val", "") if name is not None else ""
        body = ElementTree.fromstring(book.read("word/document.xml")).find(f"{W}body")

    def inline(node) -> str:
        out = ""
        for x in node:
            if x.tag == f"{W}t":
                out += x.text or ""
            elif x.tag == f"{W}tab":
                out += "\t"
            elif x.tag in (f"{W}br", f"{W}cr"):
                out += "\n"
            elif x.tag == f"{W}hyperlink":
                label, target = inline(x).strip(), links.get(x.get(f"{LINKED}id", ""), "")
                out += f"[{label}]({target})" if label and target else label
            else:
                out += inline(x)
        return out

    def paragraph(node) -> str:
        text, props = inline(node).strip(), node.find(f"{W}pPr")
        if not text or props is None:
            return text
        style = props.find(f"{W}pStyle")
        named = styles.get(style.get(f"{W}val", ""), style.get(f"{W}val", "")) if style is not None else ""
        if m := re.match(r"(?i)heading\s*(\d)|标题\s*(\d)", named):
            return "#" * min(6, int(m.group(1) or m.group(2)) + 1) + " " + text
        level = props.find(f"{W}numPr/{W}ilvl")
        if props.find(f"{W}numPr") is not None:
            return "  " * int(level.get(f"{W}val", "0") if level is not None else 0) + "- " + text
        return text

    def grid(node) -> str:
        rows = [["<br>".join(filter(None, (inline(p).strip() for p in c.iter(f"{W}p")))).replace("|", "\\|") for c in r.iter(f"{W}tc")] for r in node.iter(f"{W}tr")]
        width = max(map(len, rows), default=0)
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return "\n".join([*lines[:1], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if rows else ""

    parts = [paragraph(x) if x.tag == f"{W}p" else grid(x) for x in body if x.tag in (f"{W}p", f"{W}tbl")]
    return "\n\n".join(p for p in parts if p)


def _opened(files: DataFrame, schema: str, rows) -> DataFrame:
    """Rows of each file by ``rows(content)``; a file that can't be read gives one row with its ``error``."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out += [(path, *r, None) for r in rows(bytes(content))]
                except Exception as e:  # a broken file must not end the job
                    out.append((path, *[None] * len(columns), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", *columns, "error"])

    bounded_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(read, f"path string, {schema}, error string")


def workbooks(spark: SparkSession, root: str) -> DataFrame:
    return _opened(_files(spark, root, ("xlsx",)), "sheet string, row_no int, cells array<string>", workbook)


def presentations(spark: SparkSession, root: str) -> DataFrame:
    return _opened(_files(spark, root, ("pptx",)), "slide_no int, text string", slides)


def documents(spark: SparkSession, root: str) -> DataFrame:
    return _opened(_files(spark, root, ("docx",)), "text string", lambda c: [(document(c),)])


def tables(spark: SparkSession, root: str, ending: str = "csv") -> DataFrame:
    """``path, row_no, cells``: all cells strings, ragged rows as they are."""
    mark = "\t" if ending == "tsv" else ","
    decode = lambda c: c.decode("utf-8-sig", errors="replace")
    return _opened(_files(spark, root, (ending,)), "row_no int, cells array<string>", lambda c: [(i, r) for i, r in enumerate(delimited(decode(c), mark), 1)])


def pdf_pages(spark: SparkSession, root: str) -> DataFrame:
    """``path, page_no, text``; a page that fails has its error in place of text. Needs the optional package pypdf."""

    def rows(content: bytes) -> list[tuple[int, str]]:
        import pypdf

        return [(i, (p.extract_text() or "").strip()) for i, p in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1)]

    return _opened(_files(spark, root, ("pdf",)), "page_no int, text string", rows)


def manifests(spark: SparkSession, root: str, item: str) -> DataFrame:
    """Items of all ``*manifest.json`` files under a folder: ``path, position`` and the fields of ``item`` (a DDL)."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*manifest.json").option("recursiveFileLookup", "true").text(root)
    found = raw.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"items array<struct<{item}>>").alias("m"))
    return found.select("path", F.posexplode("m.items").alias("position", "item")).select("path", "position", "item.*")


def cue_text(lines: Column) -> Column:
    """Spoken lines of a numbered subtitle file: no blanks, numbers or cue times."""
    return F.filter(F.transform(lines, strip), lambda x: (x != "") & ~x.rlike(r"^\d+$") & ~x.contains("-->"))


def sidecar(media_files: DataFrame, subtitles: DataFrame) -> DataFrame:
    """``path, subtitle``: the subtitle of the same name, else the first in order that extends it by ``_``."""
    base = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    folder = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    m = media_files.select("path", base(F.col("path")).alias("base"), folder(F.col("path")).alias("folder"))
    s = subtitles.where("size > 0").select(F.col("path").alias("subtitle"), base(F.col("path")).alias("sbase"), folder(F.col("path")).alias("folder"))
    fits = (F.col("sbase") == F.col("base")) | F.col("sbase").startswith(F.concat(F.col("base"), F.lit("_")))
    return m.join(s, "folder").where(fits).groupBy("path").agg(F.min_by("subtitle", F.struct(F.col("sbase") != F.col("base"), F.col("subtitle"))).alias("subtitle"))


def settings(lines: DataFrame) -> DataFrame:
    """``key, value`` of ``KEY=VALUE`` lines; comments and quotes around values dropped, the last of equal keys counts."""
    line = strip(F.col("value"))
    kept = lines.withColumn("n", F.monotonically_increasing_id()).where((line != "") & ~line.startswith("#") & line.contains("="))
    value = F.regexp_replace(strip(F.regexp_extract(line, r"^[^=]*=(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2")
    return kept.select("n", strip(F.substring_index(line, "=", 1)).alias("key"), value.alias("v")).groupBy("key").agg(F.max_by("v", "n").alias("value"))


def scanned_entries(text: Column) -> Column:
    """Entries of a scanner's indented listing: ``ARRAY<MAP<STRING, STRING>>`` with keys in lower case."""
    groups = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n(?=  - AVID:)"), 2, 1 << 30)
    pairs = lambda g: F.regexp_extract_all(g, F.lit(r"(?:^|\n)(?:  - |    )((?:AVID|BVID|TITLE|DURATION|UPPER|PUBTIME):[^\n]*)"), F.lit(1))
    entry = lambda g: F.map_from_entries(F.transform(pairs(g), lambda p: F.struct(F.lower(F.substring_index(p, ":", 1)), strip(F.regexp_extract(p, "^[A-Z]+:(.*)$", 1)))))
    return F.transform(groups, entry)


def last_structured(lines: DataFrame, prefix: str, order: str, by: list[str], schema: str) -> DataFrame:
    """The last line with a prefix per group, its rest read as JSON; null where that fails."""
    hit = lines.where(F.col("value").startswith(prefix)).groupBy(*by).agg(F.max_by("value", order).alias("line"))
    return hit.select(*by, F.from_json(F.substring("line", len(prefix) + 1, 1 << 30), schema).alias("result"))


def processed_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(blank_as_null(strip(F.col("value"))).alias("id")).where("id is not null").distinct()
