"""Queries over notes, documents and their Markdown, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions import markdown as M
from notefold.functions import text as T
from notefold.functions.html import html_blocks, html_metadata
from notefold.functions.python_text import json_scalar, long_merged_sections, safe_name, unescaped
from notefold.operators import conversation as C
from notefold.operators import manifest, models, pages, terms, validate
from notefold.operators.chunk import chunks, page_packs
from notefold.session import spread, table

#: Day that stands for today where nothing names one: queries read no clock.
TODAY = "2026-01-01"

#: Code points beyond which a body's sections are merged in Python, in linear time; no body is left out.
LONG_BODY = 100_000

# White space as DuckDB's and the JVM's expressions both know it, for the SQL below.
W = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+\\z', '', 'g')"


def _lines(x: str) -> str:
    return f"regexp_replace({x}, '\\r\\n|\\r', chr(10), 'g')"


def note_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per note: title, kind, size, hash, links, local assets."""
    n, body = spread(table(spark, sf_dir, "notes"), "note_id"), F.coalesce("body", F.lit(""))
    return n.select(
        "note_id",
        "path",
        M.title_of(F.col("title"), body, F.col("path")).alias("title"),
        F.coalesce("note_type", F.lit("")).alias("note_type"),
        F.coalesce("source_type", F.lit("")).alias("source_type"),
        F.length(body).alias("size"),
        T.content_hash(body).alias("body_hash"),
        F.size(M.links(body)).alias("n_links"),
        F.size(M.local_assets(body)).alias("n_assets"),
    )


def note_index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = note_index(spark, sf_dir)
    return i.groupBy("source_type").agg(F.count("*").alias("notes"), F.sum("n_assets").alias("assets"), F.sum("n_links").alias("links"), F.sum("size").alias("size"))


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spread(table(spark, sf_dir, "notes"), "note_id").where("body is not null")
    h = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    b = F.col("body")
    return n.select("note_id", h(T.clean_text(b)).alias("cleaned"), h(T.tidy_markdown(b)).alias("tidied"), h(T.squeeze_markdown(b)).alias("squeezed"), h(T.compact(b)).alias("compacted"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "notes").where("title is not null")
    return n.select("note_id", T.slug(F.col("title")).alias("slug"), M.title_from_name(F.col("path")).alias("name_title"), T.head_lines(F.col("body"), 3).alias("head"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "notes").where("title is not null")
    return n.select("note_id", safe_name(F.col("title")).alias("name"), unescaped(F.col("title")).alias("title"), json_scalar(F.col("published")).alias("published"))


def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spread(table(spark, sf_dir, "notes"), "note_id")
    kind = M.source_type(F.col("source_type"), F.col("source_url"), F.col("path"), F.col("body"))
    return n.select(
        "note_id",
        kind.alias("source_type"),
        M.note_type(F.col("note_type"), kind, F.col("body")).alias("note_type"),
        T.looked_up(M.NOTE_TYPES, kind, "organized-note").alias("organised_type"),
        F.concat(T.looked_up(M.PREFIXES, kind, "NOTE"), F.lit("-"), T.slug(F.coalesce("title", F.lit(""))), F.lit(".md")).alias("file_name"),
        M.created_date(F.col("created"), F.col("published"), F.col("path"), TODAY).alias("created_day"),
    )


def inferred_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "notes")
    tags = T.inferred_tags(F.col("tags"), F.coalesce("note_type", F.lit("")), F.coalesce("source_type", F.lit("")), F.coalesce("status", F.lit("")))
    return n.select("note_id", F.array_join(tags, ",").alias("tags"))


def _with_frontmatter(n: DataFrame) -> DataFrame:
    fields = [(f, F.col(f)) for f in ("title", "source_type", "source_url", "bvid", "author", "published", "status", "tags")]
    return n.withColumn("markdown", F.concat(M.render_frontmatter(fields), F.lit("\n\n"), F.coalesce("body", F.lit(""))))


def frontmatter_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _with_frontmatter(table(spark, sf_dir, "notes"))
    return n.select("note_id", F.sha2("markdown", 256).alias("markdown_hash"), F.length("markdown").alias("size"))


def frontmatter_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from rendered notes, and the body behind them."""
    n = _with_frontmatter(spread(table(spark, sf_dir, "notes"), "note_id"))
    fields = M.frontmatter_fields(F.col("markdown"))
    return n.select("note_id", F.size(fields).alias("n_fields"), M.frontmatter_value(F.col("markdown"), "status").alias("status"), F.length(M.body_of(F.col("markdown"))).alias("body_size"))


def sections_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note's body twice in a row, its equal sections merged; bodies beyond ``LONG_BODY`` in Arrow batches."""
    n = spread(table(spark, sf_dir, "notes"), "note_id").where("body is not null")
    twice = F.concat("body", F.lit("\n\n"), "body")
    is_long = F.length("body") > LONG_BODY
    merged = n.where(~is_long).select("note_id", M.merged_sections(twice).alias("merged")).unionByName(n.where(is_long).select("note_id", long_merged_sections(twice).alias("merged")))
    return merged.select("note_id", F.sha2("merged", 256).alias("merged_hash"), F.length("merged").alias("size"))


def headings_demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spread(table(spark, sf_dir, "notes"), "note_id").where("body is not null")
    return n.select("note_id", F.sha2(M.demoted(F.col("body")), 256).alias("demoted_hash"), T.heading(F.col("body")).alias("first_heading"))


def originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "notes").where("body is not null")
    text = M.original_text(F.col("body"))
    return n.select("note_id", F.length(text).alias("size"), F.sha2(text, 256).alias("text_hash"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "notes").where("body is not null")
    found = n.select("note_id", F.explode(M.links(F.col("body"))).alias("target"))
    return found.select("note_id", "target", T.is_external(F.col("target")).alias("is_external"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of images; the notes at hand have none, so each of their links is shown as one."""
    n = table(spark, sf_dir, "notes").where("body is not null")
    found = n.select("note_id", F.posexplode(M.image_targets(F.regexp_replace("body", r"(?<!!)\[", "!["))).alias("at", "target"))
    return found.select("note_id", "at", "target", T.is_remote(F.col("target")).alias("is_remote"), T.asset_extension(F.col("target"), F.lit("")).alias("ending"))


def note_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("note_type") == "video-note", "video").when(F.col("note_type") == "source-conversion", "source").otherwise("")
    return validate.violations(_with_frontmatter(table(spark, sf_dir, "notes")), "note_id", "markdown", kind)


def transcript_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts put into notes as sections, read back, and removed again."""
    t = table(spark, sf_dir, "transcripts").where("transcript_text is not null and trim(transcript_text) <> ''")
    note = F.concat(F.lit("# t\n\n## 核心观点\n\nx\n\n---\n## 原始字幕\n\n"), "transcript_text")
    return t.select("transcript_id", F.sha2(M.transcript_of(note), 256).alias("text_hash"), M.without_transcript(note).alias("rest"), M.with_section(note, "核心观点", F.lit("## 核心观点\n\ny")).contains("\ny\n").alias("put"))


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("note_type = 'chat' and text is not null")
    return C.marked_turns(d, "doc_id", "text").select(F.col("id").alias("doc_id"), "turn", "role", F.length("text").alias("size"))


def chat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_turns(spark, sf_dir).groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("doc_id").alias("chats"), F.sum("size").alias("size"))


def chats_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("note_type = 'chat' and text is not null")
    return C.rendered(C.marked_turns(d, "doc_id", "text")).select(F.col("id").alias("doc_id"), "n_turns", F.sha2("text", 256).alias("text_hash"))


def first_seen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("text_hash"), F.coalesce("source", F.lit("")).alias("source"))
    return manifest.first_seen(d, ["text_hash"], "doc_id")


def sampled_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two notes of each source type, the feature of a sample run."""
    n = table(spark, sf_dir, "notes").select("note_id", F.coalesce("source_type", F.lit("")).alias("source_type"))
    return manifest.sampled_by_kind(n, "source_type", "note_id", 2)


def term_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each reference term occurs in."""
    d, t = spread(table(spark, sf_dir, "documents"), "doc_id"), table(spark, sf_dir, "ocr_lexicon")
    return terms.names_in(d, "doc_id", "text", t, "word").groupBy("name").agg(F.count("*").alias("documents"))


def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(table(spark, sf_dir, "notes"), "note_id", "body", 22_000, 800).select(F.col("id").alias("note_id"), "chunk_no", F.length("text").alias("size"))


def speech_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(table(spark, sf_dir, "transcripts"), "transcript_id", "transcript_text", 20_000, 800, "speech").select(F.col("id").alias("transcript_id"), "chunk_no", F.length("text").alias("size"))


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 16_000, style="plain").select(F.col("id").alias("doc_id"), "chunk_no", F.length("text").alias("size"))


def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "page_results").withColumn("backend", F.coalesce("backend", F.lit("")))
    return page_packs(p, ["source", "backend"], "page", "text", 18_000, 1).select("source", "backend", "pack_run", "pack_no", "labels", F.length("text").alias("size"))


def page_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "page_results").withColumn("backend", F.coalesce("backend", F.lit("")))
    return pages.amounts(p, ["source", "backend"])


def pages_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the text layer, sparse ones replaced by another backend's."""
    p = table(spark, sf_dir, "page_results")
    layer, other = p.where("backend = 'text-layer'"), p.where("backend is null or backend <> 'text-layer'")
    return pages.replaced(layer, other, ["source", "page"]).select("page_id", "source", "page", pages.signs(F.col("text")).alias("n_signs"), F.coalesce("was_replaced", F.lit(False)).alias("was_replaced"))


def pages_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "page_results").withColumn("backend", F.coalesce("backend", F.lit("")))
    total = p.groupBy("source", "backend").agg(F.max("total").alias("total"))
    return pages.missing(total, p, ["source", "backend"]).groupBy("source", "backend").agg(F.count("*").alias("n_missing"))


def organised_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes organised chunk by chunk and combined in a tree, by the deterministic stand-in of a model."""
    n = spread(table(spark, sf_dir, "notes"), "note_id").where("trim(body) <> ''")
    done = models.organised(n, "note_id", "body", models.EchoModel, 4_000, 400, 2_000)
    return done.select(F.col("id").alias("note_id"), "n_chunks", "n_failed", F.length("text").alias("size"))


def html_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped as web pages and read back as blocks."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id").where("text is not null")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>t</title></head><body><nav>n</nav><article><p>"), F.regexp_replace(escaped, r"\n\s*\n", "</p><p>"), F.lit("</p></article></body></html>"))
    read = d.select("doc_id", html_blocks(page, F.lit("https://x.example/")).alias("b"), html_metadata(page, F.lit("https://x.example/")).alias("m"))
    return read.select("doc_id", "m.title", F.size("b").alias("n_blocks"), F.aggregate("b", F.lit(0), lambda a, x: a + F.length(x["text"])).alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        note_index, note_index_totals, clean_texts, slugs, safe_names, inferred_types, inferred_tags, frontmatter_rendered, frontmatter_parsed,
        sections_merged, headings_demoted, originals, links, images, note_violations, transcript_sections, chat_turns, chat_stats, chats_rendered,
        first_seen_texts, sampled_notes, term_names, note_chunks, speech_chunks, plain_chunks, page_windows, page_amounts, pages_replaced, pages_missing,
        organised_notes, html_read,
    )
}

_B = "coalesce(body, '')"
_LINKS = rf"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(@b@, '\[\[([^\]]+)\]\]', 1), lambda x: {_strip("split_part(x, '|', 1)")}), list_transform(regexp_extract_all(@b@, '!?\[[^\]]*\]\(([^)]+)\)', 1), lambda x: regexp_replace({_strip('x')}, '^[<>]+|[<>]+$', '', 'g')))))"
_ASSETS = rf"len(list_filter(list_transform(regexp_extract_all(@b@, '!\[[^\]]*\]\(([^)]+)\)', 1), lambda x: regexp_replace({_strip('x')}, '^[<>]+|[<>]+$', '', 'g')), lambda x: NOT (regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9+.-]*:') OR starts_with(x, '#'))))"
_STEM = r"regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1')"
_HEADING = rf"{_strip(rf"regexp_extract(@b@, '(?m)^#{W}+([^\n]+)', 1)")}"
_SLUG = rf"coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(@t@, '[\\/:*?\"<>|]+', '-', 'g'), '{W}+', '-', 'g'), '^[ .\-_]+|[ .\-_]+\z', '', 'g'), 1, 120), ''), 'untitled')"
_CLEAN = _strip(rf"regexp_replace(regexp_replace({_lines('body')}, '[ \t]+\n', chr(10), 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")
_TIDY = _strip(r"regexp_replace(regexp_replace(replace(body, chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_SQUEEZE = _strip(rf"regexp_replace({_lines('@b@')}, '\n{{3,}}', chr(10) || chr(10), 'g')")
_COMPACT = _strip(r"regexp_replace(regexp_replace(regexp_replace(replace(body, chr(160), ' '), '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), '[ \t\r\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g')")
_YAML = rf"CASE WHEN @c@ IS NULL OR @c@ = '' THEN '' WHEN regexp_matches(@c@, '[:#\[\]{{}},&*!|>''\"%@`]|^{W}|{W}\z') THEN CAST(to_json(@c@) AS VARCHAR) ELSE @c@ END"
_FIELD = "CASE WHEN @c@ IS NOT NULL THEN '@c@: ' || " + _YAML + " END"
_FRONT = (
    "concat_ws(chr(10), '---', "
    + ", ".join(_FIELD.replace("@c@", c) for c in ("title", "source_type", "source_url", "bvid", "author", "published", "status"))
    + ", CASE WHEN tags IS NOT NULL THEN 'tags:' || array_to_string(list_transform(tags, lambda v: chr(10) || '  - ' || "
    + _YAML.replace("@c@", "v")
    + "), '') END, '---') || chr(10) || chr(10) || coalesce(body, '')"
)
_WORDS = r"regexp_replace(@t@, '" + W + "', '', 'g')"
_DAY = r"'\d{4}-\d{2}-\d{2}'"
_KIND = r"""CASE WHEN trim(coalesce(source_type, '')) <> '' THEN trim(source_type)
    WHEN contains(coalesce(source_url, ''), 'bilibili.com/video/') OR regexp_matches(coalesce(source_url, ''), '/video/BV') OR regexp_matches(regexp_extract(path, '[^/]*$'), '(^|[^0-9A-Za-z])BV[0-9A-Za-z]+') THEN 'bilibili'
    WHEN starts_with(coalesce(source_url, ''), 'file://') OR contains(substring(coalesce(body, ''), 1, 800), '转录来源') THEN 'local-video'
    WHEN starts_with(upper(regexp_extract(path, '[^/]*$')), 'PDF-') THEN 'pdf' WHEN starts_with(upper(regexp_extract(path, '[^/]*$')), 'DOCX-') THEN 'docx'
    WHEN starts_with(upper(regexp_extract(path, '[^/]*$')), 'CHAT-') THEN 'lmstudio-conversation' WHEN starts_with(upper(regexp_extract(path, '[^/]*$')), 'WECHAT-') OR contains(coalesce(source_url, ''), 'mp.weixin.qq.com') THEN 'wechat-article'
    WHEN starts_with(upper(regexp_extract(path, '[^/]*$')), 'WEB-') OR regexp_matches(coalesce(source_url, ''), '^https?://') THEN 'webpage' WHEN contains(path, '/courses/') THEN 'course' ELSE 'markdown' END"""


def _case(table_: dict[str, str], key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE '{default}' END"


_INDEX = f"""SELECT note_id, path, coalesce(nullif(title, ''), nullif({_HEADING.replace("@b@", _B)}, ''), {_STEM}) AS title, coalesce(note_type, '') AS note_type,
    coalesce(source_type, '') AS source_type, length({_B}) AS size, sha256({_B}) AS body_hash, len({_LINKS.replace("@b@", _B)}) AS n_links, {_ASSETS.replace("@b@", _B)} AS n_assets FROM notes"""
_ORIGINAL = rf"coalesce(nullif({_strip(rf"regexp_extract(body, '(?s)(?:^|\n)##[^\S\n]+原文抽取[^\S\n]*\n(.+)\z', 1)")}, ''), {_strip('body')})"
_SIGNS = f"coalesce(length({_WORDS.replace("@t@", 'text')}), 0)"
_TURNS = r"""SELECT doc_id, unnest(list_slice(regexp_split_to_array(chr(10) || regexp_replace(text, '\r\n?', chr(10), 'g'), '\n(### )'), 2, 1000000)) AS part FROM documents WHERE note_type = 'chat' AND text IS NOT NULL"""

def _chunk_sql(source: str, key: str, text: str, limit: int, overlap: int, marks: tuple[str, ...], keep: int = 0, stripped: bool = True, first: bool = False) -> str:
    """The chunkers' contract by recursion over starts; ``first`` takes the first mark found instead of the last place."""
    shared = min(overlap, limit // 3)
    stretch = limit if first else min(limit - limit // 2, max(2 * shared, 1))
    chars = lambda m: " || ".join("chr(10)" if part == "\n" else f"'{part}'" for part in re.split("(\n)", m) if part)
    low = f"greatest(s + {limit - stretch}, s + 1)"
    tail = lambda m: f"list_extract(string_split(w, {chars(m)}), -1)"
    odd = lambda m: f" + CASE WHEN starts_with({tail(m)}, chr(10)) THEN 1 ELSE 0 END" if m == "\n\n" else ""
    place = lambda m: f"CASE WHEN contains(w, {chars(m)}) THEN low + length(w) - length({tail(m)}) - {len(m)}{odd(m)} + {keep} END"
    end = f"CASE WHEN s + {limit} >= n THEN n ELSE coalesce({'coalesce' if first else 'greatest'}({', '.join(map(place, marks))}), s + {limit}) END"
    step = lambda rows: f"SELECT id, t, n, s, {end} AS e FROM (SELECT *, {low} AS low, substring(t, {low} + 1, s + {limit} - {low}) AS w FROM ({rows}))"
    body = _strip(text) if stripped else text
    own = f"SELECT {key} AS id, {body} AS t, length({body}) AS n FROM {source} WHERE {text} IS NOT NULL" + (f" AND {body} <> ''" if stripped else "")
    part = _strip("substring(t, s + 1, e - s)")
    return f"""WITH RECURSIVE own AS ({own}), c AS ({step(f"SELECT *, 0 AS s FROM own WHERE n > {limit}")} UNION ALL {step(f"SELECT id, t, n, CASE WHEN e - {shared} > s THEN e - {shared} ELSE e END AS s FROM c WHERE e < n")})
        SELECT id AS {key}, CAST(row_number() OVER (PARTITION BY id ORDER BY s) AS INTEGER) AS chunk_no, length({part}) AS size FROM c WHERE {part} <> '' UNION ALL SELECT id, 1, n FROM own WHERE n <= {limit}"""


def _rest(title: str) -> str:
    return _strip(rf"regexp_extract(m, '(?s)(?:^|\n)##[^\S\n]+{title}[^\S\n]*\n(.+)\z', 1)")


# A rule a note breaks, as validate.violations names it, and when.
_BROKEN = {
    "draft path": r"regexp_matches(m, '(^|\n)draft_path:')",
    "no source": r"NOT regexp_matches(m, '(^|\n)(source_path|source_url):[ \t]*\S') AND NOT contains(m, '## 来源追溯')",
    "subtitle missing": r"note_type = 'video-note' AND NOT regexp_matches(m, '(^|\n)(##\s+原始字幕|<summary>📄\s*原始字幕</summary>)')",
    "not organised": r"note_type = 'source-conversion' AND NOT regexp_matches(m, '(^|\n)status:\s*organized\s*(\n|\z)')",
    "original missing": f"note_type = 'source-conversion' AND {_rest('原文抽取')} = ''",
}

_sq = lambda x: _SQUEEZE.replace("@b@", x)
_MERGED = rf"""SELECT note_id, CASE WHEN len(cut) = 1 THEN {_sq("m")} ELSE {_sq("array_to_string(list_filter(list_concat([" + _sq("cut[1]") + "], flatten(list_transform(list_filter(ts, lambda x, i: NOT list_contains(list_slice(ts, 1, i - 1), x)), lambda t: [t, array_to_string(list_filter(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN ts[i] = t AND bs[i] <> '' AND NOT list_contains(list_slice(tb, 1, i - 1), tb[i]) THEN bs[i] END), lambda x: x IS NOT NULL), chr(10) || chr(10))]))), lambda p: " + _strip("p") + " <> ''), chr(10) || chr(10))")} END AS merged
    FROM (SELECT *, list_transform(range(1, len(ts) + 1), lambda i: ts[i] || chr(2) || bs[i]) AS tb FROM (SELECT *, list_transform(cut[2:], lambda x: split_part(x, chr(10), 1)) AS ts, list_transform(cut[2:], lambda x: {_sq(r"regexp_replace(x, '^[^\n]*\n?', '')")}) AS bs
    FROM (SELECT note_id, m, string_split(replace(chr(10) || {_lines("m")}, chr(10) || '## ', chr(10) || chr(1) || '## '), chr(10) || chr(1)) AS cut FROM (SELECT note_id, body || chr(10) || chr(10) || body AS m FROM notes WHERE body IS NOT NULL))))"""

SQL = {
    "note_index": _INDEX,
    "sections_merged": f"SELECT note_id, sha256(merged) AS merged_hash, length(merged) AS size FROM ({_MERGED})",
    "page_windows": r"""WITH RECURSIVE p AS (SELECT source, coalesce(backend, '') AS backend, page, coalesce(CAST(page AS VARCHAR), 'None') AS label,
            length('### Page ' || coalesce(CAST(page AS VARCHAR), 'None') || chr(10) || chr(10) || coalesce(nullif(text, ''), '本页未抽取到可读文本。')) AS size FROM page_results),
        g AS (SELECT source, backend, list(page ORDER BY page NULLS LAST, size) AS pages, list(label ORDER BY page NULLS LAST, size) AS labels, list(size ORDER BY page NULLS LAST, size) AS sizes FROM p GROUP BY ALL),
        h AS (SELECT *, list_transform(range(0, len(sizes) + 1), lambda j: coalesce(list_sum(list_slice(sizes, 1, j)), 0)) AS upto FROM g),
        c AS (SELECT *, 0 AS a, 1 AS no, greatest(1, coalesce(list_max(list_filter(range(1, len(sizes) + 1), lambda j: upto[j + 1] <= 18000)), 1)) AS e FROM h
            UNION ALL SELECT source, backend, pages, labels, sizes, upto, a, no, greatest(f, coalesce(list_max(list_filter(range(f, len(sizes) + 1), lambda j: upto[j + 1] - upto[a + 1] <= 18000)), f)) AS e
            FROM (SELECT source, backend, pages, labels, sizes, upto, greatest(a, e - 1) AS a, no + 1 AS no, e + 1 AS f FROM c WHERE e < len(sizes)))
        SELECT source, backend, CAST(floor(pages[a + 1] / 512) AS INTEGER) AS pack_run, no AS pack_no, array_to_string(list_slice(labels, a + 1, e), ', ') AS labels, upto[e + 1] - upto[a + 1] + 2 * (e - a - 1) AS size FROM c""",
    "note_violations": f"SELECT id, unnest(list_filter([{', '.join(f"CASE WHEN {test} THEN '{rule}' END" for rule, test in _BROKEN.items())}], lambda x: x IS NOT NULL)) AS rule FROM (SELECT note_id AS id, note_type, {_FRONT} AS m FROM notes)",
    "frontmatter_parsed": rf"""SELECT note_id, len(list_filter([title, source_type, source_url, bvid, author, published, status], lambda x: x IS NOT NULL)) + CASE WHEN tags IS NULL THEN 0 ELSE 1 END AS n_fields,
        nullif({_strip("status")}, '') AS status, length(regexp_replace({_B}, '^\n+', '')) AS body_size FROM notes""",
    "transcript_sections": f"""SELECT transcript_id, sha256({_strip("transcript_text")}) AS text_hash, concat_ws(chr(10), '# t', '', '## 核心观点', '', 'x', '') AS rest, true AS put FROM transcripts
        WHERE transcript_text IS NOT NULL AND trim(transcript_text) <> ''""",
    "note_chunks": _chunk_sql("notes", "note_id", "body", 22_000, 800, ("\n## ", "\n\n", "\n", "。"), stripped=False),
    "speech_chunks": _chunk_sql("transcripts", "transcript_id", "transcript_text", 20_000, 800, ("\n\n", "\n", "。", "！", "？"), keep=1),
    "plain_chunks": _chunk_sql("documents", "doc_id", "text", 16_000, 0, ("\n\n", "\n"), first=True),
    "note_index_totals": f"SELECT source_type, count(*) AS notes, sum(n_assets) AS assets, sum(n_links) AS links, sum(size) AS size FROM ({_INDEX}) GROUP BY source_type",
    "clean_texts": f"SELECT note_id, substring(sha256({_CLEAN}), 1, 16) AS cleaned, substring(sha256({_TIDY}), 1, 16) AS tidied, substring(sha256({_SQUEEZE.replace("@b@", 'body')}), 1, 16) AS squeezed, substring(sha256({_COMPACT}), 1, 16) AS compacted FROM notes WHERE body IS NOT NULL",
    "slugs": rf"""SELECT note_id, {_SLUG.replace("@t@", 'title')} AS slug,
        coalesce(nullif({_strip(rf"replace(regexp_replace({_STEM}, '^(PDF|DOCX|CHAT|WEB|WECHAT)-', ''), '_', ' ')")}, ''), '未命名笔记') AS name_title,
        CASE WHEN len(string_split(c, chr(10))) > 3 THEN array_to_string(list_slice(string_split(c, chr(10)), 1, 3), chr(10)) || chr(10) || '...' ELSE c END AS head
        FROM (SELECT *, {_CLEAN.replace('body', _B)} AS c FROM notes WHERE title IS NOT NULL)""",
    "inferred_types": rf"""SELECT note_id, k AS source_type, CASE WHEN trim(coalesce(note_type, '')) <> '' THEN trim(note_type) WHEN k IN ('bilibili', 'local-video', 'video') THEN 'video-note'
        WHEN k IN ('pdf', 'docx', 'lmstudio-conversation', 'webpage', 'wechat-article') THEN 'source-conversion' WHEN k = 'course' THEN 'course-note'
        WHEN contains(substring({_B}, 1, 2000), '## 视频摘要') OR contains(substring({_B}, 1, 3000), '## 完整转录') THEN 'video-note' ELSE 'note' END AS note_type,
        {_case(M.NOTE_TYPES, 'k', 'organized-note')} AS organised_type, {_case(M.PREFIXES, 'k', 'NOTE')} || '-' || {_SLUG.replace("@t@", "coalesce(title, '')")} || '.md' AS file_name,
        coalesce(nullif(regexp_extract(created, {_DAY}), ''), nullif(regexp_extract(published, {_DAY}), ''), nullif(regexp_extract(regexp_extract(path, '[^/]*$'), {_DAY}), ''), '{TODAY}') AS created_day
        FROM (SELECT *, {_KIND} AS k FROM notes)""",
    "inferred_tags": rf"""SELECT note_id, coalesce(array_to_string(list_filter(t, lambda x, i: x <> '' AND NOT list_contains(list_slice(t, 1, i - 1), x)), ','), '') AS tags FROM (
        SELECT note_id, list_concat(list_transform(coalesce(tags, []), lambda x: {_strip('x')}),
            CASE WHEN note_type = 'video-note' THEN ['video'] WHEN note_type = 'course-note' THEN ['course'] ELSE [] END,
            CASE WHEN source_type = 'wechat-article' THEN ['source/web', 'source/wechat'] WHEN coalesce(source_type, '') NOT IN ('', 'markdown') THEN ['source/' || source_type] ELSE [] END,
            CASE WHEN coalesce(status, '') <> '' THEN ['status/' || status] ELSE [] END) AS t FROM notes)""",
    "frontmatter_rendered": f"SELECT note_id, sha256(m) AS markdown_hash, length(m) AS size FROM (SELECT note_id, {_FRONT} AS m FROM notes)",
    "headings_demoted": rf"SELECT note_id, sha256(regexp_replace({_strip('body')}, '(?m)^(#{{2,5}})({W}+)', '#\1\2', 'g')) AS demoted_hash, {_HEADING.replace("@b@", 'body')} AS first_heading FROM notes WHERE body IS NOT NULL",
    "originals": rf"""SELECT note_id, length(t) AS size, sha256(t) AS text_hash FROM (SELECT note_id, CASE WHEN starts_with(o, '# ') THEN regexp_replace(regexp_replace(o, '^[^\n]*\n?', ''), '^{W}+', '') ELSE o END AS t
        FROM (SELECT note_id, {_ORIGINAL} AS o FROM notes WHERE body IS NOT NULL))""",
    "links": f"SELECT note_id, target, regexp_matches(target, '^[a-zA-Z][a-zA-Z0-9+.-]*:') OR starts_with(target, '#') AS is_external FROM (SELECT note_id, unnest({_LINKS.replace("@b@", 'body')}) AS target FROM notes WHERE body IS NOT NULL)",
    "chat_turns": rf"""SELECT doc_id, TRY_CAST(regexp_extract(part, '^(\d+)\. ', 1) AS INTEGER) AS turn, {_strip(rf"regexp_extract(part, '^\d+\. ([^\n(]*)', 1)")} AS role,
        length({_strip(rf"regexp_replace(part, '^[^\n]*\n?', '')")}) AS size FROM ({_TURNS})""",
    "chat_stats": rf"""SELECT role, count(*) AS turns, count(DISTINCT doc_id) AS chats, sum(size) AS size FROM (SELECT doc_id, {_strip(rf"regexp_extract(part, '^\d+\. ([^\n(]*)', 1)")} AS role,
        length({_strip(rf"regexp_replace(part, '^[^\n]*\n?', '')")}) AS size FROM ({_TURNS})) GROUP BY role""",
    "first_seen_texts": "SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash, arg_min(coalesce(source, ''), doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)",
    "sampled_notes": "SELECT note_id, coalesce(source_type, '') AS source_type FROM notes QUALIFY row_number() OVER (PARTITION BY coalesce(source_type, '') ORDER BY note_id) <= 2",
    "term_names": "SELECT word AS name, count(DISTINCT doc_id) AS documents FROM documents JOIN (SELECT DISTINCT word FROM ocr_lexicon) ON contains(text, word) GROUP BY word",
    "page_amounts": f"""SELECT source, coalesce(backend, '') AS backend, count(*) AS n_pages, sum({_SIGNS}) AS n_signs, count(*) FILTER ({_SIGNS} < 30) AS n_sparse,
        sum({_SIGNS}) < 160 OR count(*) FILTER ({_SIGNS} < 30) >= greatest(1.0, count(*) / 2.0) AS needs_ocr FROM page_results GROUP BY source, coalesce(backend, '')""",
    "pages_missing": """SELECT source, backend, count(*) AS n_missing FROM (SELECT source, backend, unnest(range(1, total + 1)) AS page FROM
        (SELECT source, coalesce(backend, '') AS backend, max(total) AS total FROM page_results GROUP BY source, coalesce(backend, ''))) t
        WHERE NOT EXISTS (SELECT 1 FROM page_results p WHERE p.text IS NOT NULL AND p.source = t.source AND coalesce(p.backend, '') = t.backend AND p.page = t.page) GROUP BY source, backend""",
    "pages_replaced": f"""SELECT page_id, source, page, CASE WHEN r THEN o ELSE s END AS n_signs, coalesce(r, false) AS was_replaced FROM (
        SELECT a.page_id, a.source, a.page, a.s, b.o, a.s < 30 AND b.o >= 30 AS r FROM (SELECT *, {_SIGNS} AS s FROM page_results WHERE backend = 'text-layer') a
        LEFT JOIN (SELECT source, page, max({_SIGNS}) AS o FROM page_results WHERE backend IS NULL OR backend <> 'text-layer' GROUP BY source, page) b ON a.source = b.source AND a.page = b.page)""",
}
