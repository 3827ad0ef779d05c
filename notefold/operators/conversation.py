"""Chat exports: selected versions of messages, their text, and conversations as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions.text import blank_as_null, clean_text, strip

EMPTY_MESSAGE = "> 空消息或暂未解析到文本。"

_BLOCK = "array<struct<text:string,content:string>>"
_VERSION = (
    "struct<role:string,content:string,preprocessed:struct<role:string,content:string>,"
    "steps:array<struct<content:string,genInfo:struct<indexedModelIdentifier:string,identifier:string>>>,senderInfo:struct<senderName:string>>"
)
EXPORT = f"name string, createdAt bigint, messages array<struct<versions:array<{_VERSION}>,currentlySelected:int,{_VERSION.removeprefix('struct<')}>"


def content_text(content: Column) -> Column:
    """Text of a message's content: a string, or a JSON array of strings and blocks with text."""
    blocks = F.from_json(content, _BLOCK)
    plain = F.from_json(content, "array<string>")
    text = F.transform(blocks, lambda b: F.coalesce(b["text"], b["content"]))
    listed = F.array_join(F.filter(F.zip_with(text, plain, lambda t, p: F.coalesce(t, F.when(~p.startswith("{"), p))), lambda t: t.isNotNull()), "\n\n")
    return F.when(strip(content).startswith("["), F.coalesce(listed, content)).otherwise(F.coalesce(content, F.lit("")))


def selected(message: Column) -> Column:
    """The selected version of a message; the first where the selection is out of range, the message itself without any."""
    own = F.struct(*[message[f].alias(f) for f in ("role", "content", "preprocessed", "steps", "senderInfo")])
    n, at = F.size(message["versions"]), F.coalesce(message["currentlySelected"], F.lit(0))
    pick = F.try_element_at(message["versions"], F.when((at >= 0) & (at < n), at).otherwise(0) + 1)
    return F.when(n > 0, pick).otherwise(own)


def message_parts(version: Column) -> Column:
    """``STRUCT<role, sender, text>`` of a version."""
    steps = F.transform(version["steps"], lambda s: content_text(s["content"]))
    joined = F.array_join(F.filter(steps, lambda t: t != ""), "\n\n")
    text = F.coalesce(blank_as_null(content_text(version["content"])), blank_as_null(content_text(version["preprocessed"]["content"])), joined, F.lit(""))
    models = F.transform(version["steps"], lambda s: F.coalesce(blank_as_null(s["genInfo"]["indexedModelIdentifier"]), s["genInfo"]["identifier"]))
    model = F.try_element_at(F.filter(models, lambda m: m.isNotNull() & (m != "")), F.lit(1))
    sender = F.coalesce(blank_as_null(version["senderInfo"]["senderName"]), model, F.lit(""))
    role = F.coalesce(blank_as_null(version["role"]), blank_as_null(version["preprocessed"]["role"]), F.lit("unknown"))
    return F.struct(role.alias("role"), sender.alias("sender"), clean_text(text).alias("text"))


def exported_turns(exports: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, turn, role, sender, text`` of exports kept as JSON text; turns count from 1."""
    read = exports.select(F.col(id_col).alias("id"), F.from_json(json_col, EXPORT).alias("x"))
    return read.select("id", F.posexplode("x.messages").alias("turn", "m")).select("id", (F.col("turn") + 1).alias("turn"), message_parts(selected(F.col("m"))).alias("p")).select("id", "turn", "p.*")


def rendered(turns: DataFrame) -> DataFrame:
    """``id, n_turns, text``: a conversation's turns in order, each under a heading."""
    sender = F.when(F.col("sender") != "", F.concat(F.lit(" ("), F.col("sender"), F.lit(")"))).otherwise("")
    text = F.coalesce(blank_as_null(F.col("text")), F.lit(EMPTY_MESSAGE))
    part = F.concat(F.lit("### "), F.col("turn").cast("string"), F.lit(". "), F.col("role"), sender, F.lit("\n\n"), text)
    listed = F.array_sort(F.collect_list(F.struct("turn", part.alias("part"))))
    return turns.groupBy("id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(listed, lambda x: x["part"]), "\n\n").alias("text"))


def marked_turns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, turn, role, sender, text`` of conversations kept as Markdown with headings ``### 1. role``."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(F.col(text_col), "\r\n?", "\n")), r"\n(?=### \d+\. )")
    own = df.select(F.col(id_col).alias("id"), F.explode(F.slice(parts, 2, 1 << 30)).alias("part"))
    head = r"^### (\d+)\. ([^\n(]*?)(?: \(([^\n]*)\))?(?:\n|\z)"
    pick = lambda i: F.regexp_extract("part", head, i)
    return own.select("id", pick(1).try_cast("int").alias("turn"), strip(pick(2)).alias("role"), pick(3).alias("sender"), strip(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("text"))
