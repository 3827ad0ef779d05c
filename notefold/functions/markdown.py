"""Markdown as Column expressions: frontmatter, headings, sections, links, tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notefold.functions.text import WS, blank_as_null, first_filled, heading, is_external, let, padded, squeeze_markdown, stem, strip, without_details, yaml_scalar

# Order of known frontmatter fields, titles of raw-text sections, kinds of note by source, file prefixes.
FIELD_ORDER = (
    "title", "type", "source_type", "source_path", "source_url", "bvid", "avid", "author", "published", "duration",
    "transcript_source", "transcribed_at", "created", "updated", "status", "model", "tags", "source_hash",
)
RAW_TITLES = ("原始字幕", "完整原文")
NOTE_TYPES = {
    "pdf": "paper-note",
    "lmstudio-conversation": "chat-note",
    "doc": "document-note",
    "docx": "document-note",
    "image-ocr": "document-note",
    "webpage": "article-note",
    "wechat-article": "article-note",
    "local-html": "article-note",
    "csv": "spreadsheet-note",
    "tsv": "spreadsheet-note",
    "xlsx": "spreadsheet-note",
    "pptx": "presentation-note",
    "video": "video-note",
    "bilibili": "video-note",
}
PREFIXES = {
    "pdf": "PAPER",
    "lmstudio-conversation": "CHAT",
    "doc": "DOC",
    "docx": "DOCX",
    "webpage": "WEB",
    "wechat-article": "WECHAT",
    "local-html": "HTML",
    "csv": "CSV",
    "tsv": "TSV",
    "xlsx": "XLSX",
    "pptx": "PPTX",
    "image-ocr": "IMAGE",
    "video": "VIDEO",
    "bilibili": "BILI",
    "bilibili-opus": "BILI-OPUS",
    "local-video": "VIDEO",
}
EMPTY_TABLE = "> 未抽取到表格数据。"

LINE = r"(?:^|(?<=\n))"
_NONE = "array<struct<k:string,v:array<string>,many:boolean>>"


def frontmatter_block(markdown: Column) -> Column:
    """What stands between the fences at the head, null where there are none."""
    end = F.locate("\n---", markdown, 5)
    return F.when(markdown.startswith("---\n") & (end > 0), F.substring(markdown, F.lit(5), end - 5))


def body_of(markdown: Column) -> Column:
    """The text behind the frontmatter."""
    end = F.locate("\n---", markdown, 5)
    rest = F.regexp_replace(F.substring(markdown, end + 4, F.length(markdown)), "^\n+", "")
    return F.when(markdown.startswith("---\n") & (end > 0), rest).otherwise(markdown)


def frontmatter_fields(markdown: Column) -> Column:
    """Fields in order: ``ARRAY<STRUCT<k STRING, v ARRAY<STRING>, many BOOLEAN>>``; ``many`` for lists.

    ``k: v`` gives a scalar, ``k:`` starts a list, ``  - v`` adds to the field before it. Quotes around values are dropped,
    escapes in them stay. A field given twice counts at its first place with its last value.
    """
    lines = F.split(strip(F.coalesce(frontmatter_block(markdown), F.lit(""))), "\n")
    bare = lambda c: F.regexp_replace(F.regexp_replace(strip(c), '^"+|"+$', ""), "^'+|'+$", "")
    empty = F.array().cast(_NONE)
    item = lambda k, v, many: F.struct(k.alias("k"), v.alias("v"), many.alias("many"))

    def step(acc: Column, line: Column) -> Column:
        is_item = line.startswith("  - ") & (F.size(acc) > 0)
        last = F.try_element_at(acc, F.lit(-1))
        longer = item(last["k"], F.concat(last["v"], F.array(bare(F.substring(line, 5, 1 << 30)))), F.lit(True))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))
        value = strip(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
        none = F.array().cast("array<string>")
        fresh = item(strip(F.substring_index(line, ":", 1)), F.when(value == "", none).otherwise(F.array(bare(value))), value == "")
        return F.when(is_item, grown).when(F.instr(line, ":") > 0, F.concat(acc, F.array(fresh))).otherwise(acc)

    return F.aggregate(lines, empty, step)


def frontmatter_value(markdown: Column, key: str) -> Column:
    """A scalar field, or null."""
    hit = F.filter(frontmatter_fields(markdown), lambda f: f["k"] == key)
    return F.try_element_at(F.try_element_at(hit, F.lit(-1))["v"], F.lit(1))


def any_line_value(markdown: Column, key: str) -> Column:
    """The value of the first line ``key: value`` anywhere in the text, also behind the frontmatter."""
    return strip(F.regexp_extract(markdown, rf"{LINE}{key}:([^\n]*)", 1))


def render_frontmatter(fields: list[tuple[str, Column]], ordered: bool = True) -> Column:
    """Fields as frontmatter, known ones first in their fixed order; arrays as lists. Null fields are left out."""
    if ordered:
        fields = sorted(fields, key=lambda f: FIELD_ORDER.index(f[0]) if f[0] in FIELD_ORDER else len(FIELD_ORDER))
    lines = []
    for key, value in fields:
        if key == "tags":
            items = F.array_join(F.transform(value, lambda v: F.concat(F.lit("\n  - "), yaml_scalar(v))), "")
            lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{key}:"), items)))
        else:
            lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), yaml_scalar(value))))
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def title_of(meta_title: Column, body: Column, path: Column) -> Column:
    return F.coalesce(blank_as_null(meta_title), blank_as_null(heading(body)), stem(path))


def title_from_name(path: Column) -> Column:
    bare = strip(F.replace(F.regexp_replace(stem(path), "^(PDF|DOCX|CHAT|WEB|WECHAT)-", ""), F.lit("_"), F.lit(" ")))
    return F.coalesce(blank_as_null(bare), F.lit("未命名笔记"))


def source_type(known: Column, url: Column, path: Column, body: Column, course_folder: str = "/courses/") -> Column:
    """Kind of source: as known, else by address, file name, the body's head and the folder that holds course notes."""
    name, url = F.substring_index(path, "/", -1), F.coalesce(url, F.lit(""))
    upper, body = F.upper(F.coalesce(name, F.lit(""))), F.coalesce(body, F.lit(""))
    return (
        F.when(strip(F.coalesce(known, F.lit(""))) != "", strip(known))
        .when(url.contains("bilibili.com/video/") | url.rlike(r"/video/BV") | name.rlike(r"(?<![0-9A-Za-z])BV[0-9A-Za-z]+"), "bilibili")
        .when(url.startswith("file://") | F.substring(body, 1, 800).contains("转录来源"), "local-video")
        .when(upper.startswith("PDF-"), "pdf")
        .when(upper.startswith("DOCX-"), "docx")
        .when(upper.startswith("CHAT-"), "lmstudio-conversation")
        .when(upper.startswith("WECHAT-") | url.contains("mp.weixin.qq.com"), "wechat-article")
        .when(upper.startswith("WEB-") | url.rlike("^https?://"), "webpage")
        .when(path.contains(course_folder), "course")
        .otherwise("markdown")
    )


def note_type(known: Column, kind: Column, body: Column) -> Column:
    """Kind of note: as known, else by the source, else by sections of the body."""
    body = F.coalesce(body, F.lit(""))
    return (
        F.when(strip(F.coalesce(known, F.lit(""))) != "", strip(known))
        .when(kind.isin("bilibili", "local-video", "video"), "video-note")
        .when(kind.isin("pdf", "docx", "lmstudio-conversation", "webpage", "wechat-article"), "source-conversion")
        .when(kind == "course", "course-note")
        .when(F.substring(body, 1, 2000).contains("## 视频摘要") | F.substring(body, 1, 3000).contains("## 完整转录"), "video-note")
        .otherwise("note")
    )


def created_date(created: Column, published: Column, path: Column, today: str) -> Column:
    day = r"\d{4}-\d{2}-\d{2}"
    return first_filled(F.regexp_extract(created, day, 0), F.regexp_extract(published, day, 0), F.regexp_extract(F.substring_index(path, "/", -1), day, 0), F.lit(today))


def quoted_field(body: Column, label: str) -> Column:
    """Value of a line ``> **label**：value``."""
    return blank_as_null(strip(F.regexp_extract(body, rf"{LINE}>\s*\*\*{label}\*\*[：:]([^\n]*)", 1)))


def demoted(markdown: Column) -> Column:
    """Headings of levels two to five one level deeper."""
    return F.regexp_replace(strip(markdown), rf"{LINE}(#{{2,5}})({WS}+)", "#$1$2")


def section(markdown: Column, title: str) -> Column:
    """The text of a level-two section up to the next one, or the empty string."""
    return strip(F.regexp_extract(markdown, rf"(?s){LINE}##[^\S\n]+{title}[^\S\n]*\n(.+?)(?=\n##\s|\z)", 1))


def rest_from(markdown: Column, title: str) -> Column:
    """The text behind a level-two heading, to the end."""
    return strip(F.regexp_extract(markdown, rf"(?s){LINE}##[^\S\n]+{title}[^\S\n]*\n(.+)\z", 1))


def original_text(body: Column) -> Column:
    """The extracted original: behind its heading, else the body without a leading level-one heading."""
    text = F.coalesce(blank_as_null(rest_from(body, "原文抽取")), strip(body))
    return F.when(text.startswith("# "), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), rf"^{WS}+", "")).otherwise(text)


def transcript_of(markdown: Column) -> Column:
    """Raw transcript of a video note: folded or as a section, under either title; empty if there is none."""
    folded = [F.regexp_extract(markdown, rf"(?s)<details>\s*<summary>📄\s*{t}</summary>\s*(.+?)\s*</details>", 1) for t in RAW_TITLES]
    return F.coalesce(first_filled(*(without_details(c) for c in [*folded, *(rest_from(markdown, t) for t in RAW_TITLES)])), F.lit(""))


def without_transcript(markdown: Column) -> Column:
    """Without the raw transcript at the end; unchanged where there is none."""
    cut = markdown
    for p in (
        r"(?s)\n---\s*\n<details>\s*<summary>📄\s*原始字幕</summary>\s*.+?\s*</details>\s*\z",
        r"(?s)\n<details>\s*<summary>📄\s*原始字幕</summary>\s*.+?\s*</details>\s*\z",
        r"(?s)\n---\s*\n##[^\S\n]+原始字幕[^\S\n]*\n.+\z",
        r"(?s)\n##[^\S\n]+原始字幕[^\S\n]*\n.+\z",
    ):
        cut = F.regexp_replace(cut, p, "")
    return F.when(cut != markdown, F.concat(F.regexp_replace(cut, rf"{WS}+\z", ""), F.lit("\n"))).otherwise(markdown)


def with_section(markdown: Column, title: str, text: Column) -> Column:
    """A section put in place of the one with its title, else before the raw transcript, else at the end."""
    own = rf"(?s){LINE}##[^\S\n]+{title}[^\S\n]*\n.+?(?=\n##\s|\n---\s*\n<details>|\n<details>|\z)"
    raw = r"\n(?:---\n)?(?:<details>\n<summary>📄 |## )(?:原始字幕|完整原文)"
    at = F.regexp_instr(markdown, F.lit(raw))
    bare = lambda c: F.regexp_replace(c, rf"{WS}+\z", "")
    literal = F.regexp_replace(strip(text), r"([\\$])", r"\\$1")
    before = F.concat(bare(F.substring(markdown, F.lit(1), at - 1)), F.lit("\n\n"), strip(text), F.lit("\n"), F.substring(markdown, at, F.length(markdown)))
    return (
        F.when(markdown.rlike(own), F.regexp_replace(markdown, F.lit(own), F.concat(literal, F.lit("\n"))))
        .when(at > 0, before)
        .otherwise(F.concat(bare(markdown), F.lit("\n\n"), strip(text), F.lit("\n")))
    )


def filled(markdown: Column, placeholder: str, value: Column) -> Column:
    """A placeholder replaced where there is a value for it."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.replace(markdown, F.lit(placeholder), strip(value))).otherwise(markdown)


def model_answer(c: Column) -> Column:
    """A model's Markdown without its answer tag and, where its head leaks reasoning, from the first heading on."""
    text = F.regexp_replace(strip(F.replace(c, F.lit("\u0000"), F.lit(""))), r"^\s*(?i:<answer>)\s*", "")
    leaks = "Self-Correction|Mental Refinement|Draft Generation|Output Generation|I will |I'll |Let's "
    at = F.regexp_instr(text, F.lit(rf"{LINE}#{{1,4}}\s+\S"))
    return F.when(F.substring(text, 1, 2500).rlike(leaks) & (at > 0), strip(F.substring(text, at, F.length(text)))).otherwise(text)


def plain_mermaid(markdown: Column) -> Column:
    """Mermaid blocks without their lines of styling."""
    parts = F.split(markdown, "(?=```mermaid)|(?<=\n```)(?=\n)")
    styled = r"(?i)^\s*(?:theme|style|classdef|class|linkstyle)\s|^\s*%%\{|\}%%\s*$"
    lines = lambda p: F.array_join(F.filter(F.split(p, "\n"), lambda x: ~x.rlike(styled)), "\n")
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("```mermaid"), lines(p)).otherwise(p)), "")


def translated(markdown: Column) -> Column:
    """Whether a full translation of some length stands in the note."""
    text = section(markdown, "全文翻译")
    return (F.length(text) >= 200) & ~F.substring(text, 1, 200).contains("待处理")


def wiki_links(body: Column) -> Column:
    found = F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.transform(found, lambda x: strip(F.substring_index(x, "|", 1)))


def link_targets(body: Column) -> Column:
    found = F.regexp_extract_all(body, F.lit(r"!?\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(strip(x), "^[<>]+|[<>]+$", ""))


def links(body: Column) -> Column:
    """All link targets, each once, in order of code points."""
    return F.array_sort(F.array_distinct(F.concat(wiki_links(body), link_targets(body))))


def image_targets(body: Column) -> Column:
    """Targets of Markdown images and of HTML image tags."""
    marked = F.regexp_extract_all(body, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    tagged = F.regexp_extract_all(body, F.lit(r"""(?i)<img\b[^>]*\bsrc=["']([^"']+)["']"""), F.lit(1))
    return F.transform(F.concat(marked, tagged), strip)


def local_assets(body: Column) -> Column:
    """Markdown image targets that are files beside the note."""
    marked = F.regexp_extract_all(body, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    bare = F.transform(marked, lambda x: F.regexp_replace(strip(x), "^[<>]+|[<>]+$", ""))
    return F.filter(bare, lambda x: ~is_external(x))


def asset_path(target: Column) -> Column:
    """The file a target names, without fragment and query, percent signs resolved."""
    bare = F.regexp_replace(F.substring_index(strip(target), " ", 1), "^[<>]+|[<>]+$", "")
    bare = F.substring_index(F.substring_index(bare, "#", 1), "?", 1)
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def blocks(text: Column) -> Column:
    """Runs of lines without a blank one between them."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda x: x != "")


def markdown_paths(log: Column) -> Column:
    """Absolute paths of Markdown files in a log, each once."""
    return F.array_distinct(F.regexp_extract_all(log, F.lit(r"(/[^\s]+\.md)"), F.lit(1)))


def table(rows: Column) -> Column:
    """An array of rows as a Markdown table, the first row as its head, short rows padded."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    even = F.transform(rows, lambda r: line(padded(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), width)))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(even, 1, 1), F.array(rule), F.slice(even, 2, F.greatest(F.size(rows), F.lit(1)))), "\n")).otherwise(EMPTY_TABLE)


def merged_sections(markdown: Column) -> Column:
    """Level-two sections of one title as one, at the first's place, their distinct texts in order; the intro stays ahead."""
    text = F.regexp_replace(markdown, "\r\n|\r", "\n")
    body = lambda part: squeeze_markdown(F.regexp_replace(part, r"^[^\n]*\n?", ""))
    named = lambda p: F.struct(F.substring_index(p, "\n", 1).alias("t"), body(p).alias("b"))

    def texts(parts: Column, title: Column) -> Column:
        own = F.transform(F.filter(parts, lambda p: p["t"] == title), lambda p: p["b"])
        return F.array_join(F.array_distinct(F.filter(own, lambda b: b != "")), "\n\n")

    def whole(cut: Column) -> Column:
        pieces = let(
            F.transform(F.slice(cut, 2, 1 << 30), named),
            lambda parts: F.flatten(F.transform(F.array_distinct(F.transform(parts, lambda p: p["t"])), lambda t: F.array(t, texts(parts, t)))),
        )
        joined = F.array_join(F.filter(F.concat(F.array(squeeze_markdown(F.element_at(cut, 1))), pieces), lambda p: strip(p) != ""), "\n\n")
        return F.when(F.size(cut) == 1, squeeze_markdown(markdown)).otherwise(squeeze_markdown(joined))

    return let(F.split(F.concat(F.lit("\n"), text), r"\n(?=## )"), whole)


def with_local_assets(markdown: Column, local: Column) -> Column:
    """Image targets replaced by their local paths (``MAP<STRING, STRING>``); others stay."""
    pairs = F.map_entries(F.coalesce(local, F.create_map().cast("map<string,string>")))
    put = lambda text, p: F.replace(text, F.concat(F.lit("]("), p["key"], F.lit(")")), F.concat(F.lit("]("), p["value"], F.lit(")")))
    return F.aggregate(pairs, markdown, put)


def headed(text: Column) -> Column:
    """``STRUCT<head, rest>``: the first line and what follows, the way recognisers put the source before the words."""
    return F.struct(strip(F.substring_index(text, "\n", 1)).alias("head"), strip(F.regexp_replace(text, r"^[^\n]*\n?", "")).alias("rest"))
