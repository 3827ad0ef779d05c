"""Columns of requests, histories, payloads and small rendered sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions.markdown import table
from notefold.functions.text import WS, blank_as_null, first_filled, strip, video_id

# States of a task, languages by preference, phrases of a page that are no text.
STATES = ("running", "success", "failed", "cancelled", "interrupted")
LANGUAGES = ("zh-CN", "zh-Hans", "zh", "zh-Hant", "en", "ja")
NO_TEXT = ("点击查看", "展开", "收起")
SHOWN_TERMS = 40

PAYLOAD = (
    "code int, message string, data struct<item:struct<id_str:string,modules:struct<module_dynamic:struct<major:struct<type:string,"
    "opus:struct<title:string,summary:string>,blocked:struct<hint_message:string,button:struct<text:string,jump_url:string>>>>>>,"
    "bvid:string,title:string,pages:array<struct<cid:bigint,page:int>>>"
)


def subtitle_text(body: Column) -> Column:
    """Lines of a player's subtitle JSON (``body`` entries with ``content``), filled ones joined."""
    lines = F.transform(F.from_json(body, "body array<struct<content:string>>")["body"], lambda x: strip(x["content"]))
    return F.coalesce(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), F.lit(""))


def chosen_part(pages: Column, number: Column) -> Column:
    """The part of a multi-part item, its number held within what there is; null without parts."""
    return F.try_element_at(pages, F.least(F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)), F.greatest(F.size(pages), F.lit(1))))


def chosen_subtitle(subtitles: Column) -> Column:
    """Of ``ARRAY<STRUCT<lan, is_ai, id, url>>`` the one of the best language, by people before machines, of the least id."""
    rank = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LANGUAGES)), s["lan"]), F.lit(0)), F.lit(99))
    ranked = F.transform(subtitles, lambda s: F.struct(rank(s).alias("r"), s["is_ai"].alias("ai"), s["id"].alias("id"), s.alias("s")))
    return F.array_min(ranked)["s"]


def appended(texts: Column, more: Column) -> Column:
    """Texts with another, squeezed, unless it is empty, a phrase of the page, or there already."""
    text = strip(F.regexp_replace(more, rf"{WS}+", " "))
    skip = text.isNull() | text.isin("", *NO_TEXT) | F.array_contains(texts, text)
    return F.when(skip, texts).otherwise(F.concat(texts, F.array(text)))


def simplified(text: Column, traditional: str = "", simple: str = "") -> Column:
    """Signs replaced by a table the caller supplies; unchanged without one."""
    return F.translate(text, traditional, simple) if traditional else text


def payload_kind(raw: Column) -> Column:
    """What a payload is: ``opus``, ``video``, ``blocked``, ``refused`` (an error code), or ``unknown``."""
    p = F.from_json(raw, PAYLOAD)
    major = p["data"]["item"]["modules"]["module_dynamic"]["major"]
    return (
        F.when(p["code"].isNull(), "unknown")
        .when(p["code"] != 0, "refused")
        .when(major["type"] == "MAJOR_TYPE_BLOCKED", "blocked")
        .when(major["opus"].isNotNull() & (p["data"]["item"]["id_str"] != ""), "opus")
        .when((p["data"]["bvid"] != "") & (F.size(p["data"]["pages"]) > 0), "video")
        .otherwise("unknown")
    )


def blocked_message(raw: Column) -> Column:
    """Hint, button and link of a blocked payload in one line."""
    b = F.from_json(raw, PAYLOAD)["data"]["item"]["modules"]["module_dynamic"]["major"]["blocked"]
    said = F.concat_ws("；", blank_as_null(b["hint_message"]), blank_as_null(b["button"]["text"]))
    return F.concat_ws(" ", blank_as_null(said), blank_as_null(b["button"]["jump_url"]))


def truncated(text: Column, most: int) -> Column:
    """``STRUCT<text, used, total, cut>``: a text cut to a length, blanks at its new end dropped."""
    kept = F.when(F.length(text) > most, F.regexp_replace(F.substring(text, 1, most), rf"{WS}+\z", "")).otherwise(text)
    return F.struct(kept.alias("text"), F.length(kept).alias("used"), F.length(text).alias("total"), (F.length(text) > most).alias("cut"))


def without_keys(options: Column, keys: list[str]) -> Column:
    return F.map_filter(options, lambda k, v: ~k.isin(keys))


def domain_prompts(domains: Column, first: str = "6") -> Column:
    """Distinct domains in order as numbered prompts ``6a``, ``6b``, ..."""
    return F.transform(F.array_distinct(domains), lambda d, i: F.concat(F.lit(first), F.char(F.lit(97) + i % 26), F.lit(") "), d))


def terms_section(terms: Column, title: str) -> Column:
    """Found terms (``ARRAY<ARRAY<STRING>>``, the first row its head) as a section, or a notice."""
    notice = f"## {title}\n\n> 未识别到参考词。"
    return F.when(F.size(terms) > 1, F.concat(F.lit(f"## {title}\n\n"), table(F.slice(terms, 1, SHOWN_TERMS + 1)))).otherwise(notice)


def frames_section(frames: Column, folder: Column) -> Column:
    """Frames (``ARRAY<STRUCT<section, title, file, snippet>>``) as a section with an image and a quote each."""
    part = lambda f: F.concat(F.lit("### "), f["section"], F.lit(" · "), f["title"], F.lit("\n\n!["), f["title"], F.lit("](assets/"), folder, F.lit("/"), f["file"], F.lit(")\n\n> "), first_filled(f["snippet"], F.lit("—")))
    return F.concat(F.lit("## 关键帧图文笔记\n\n"), F.array_join(F.transform(frames, part), "\n\n"))


def loaded_history(entries: DataFrame) -> DataFrame:
    """Entries as loaded: unknown states failed, running ones interrupted, missing logs and outputs empty; without id none."""
    state = F.when(F.col("status") == "running", "interrupted").when(F.col("status").isin(*STATES), F.col("status")).otherwise("failed")
    return entries.where(F.coalesce("id", F.lit("")) != "").withColumn("status", state).withColumn("log", F.coalesce("log", F.lit(""))).withColumn("outputs", F.coalesce("outputs", F.array().cast("array<string>")))


def retryable(failures: DataFrame, kind: str, collection: str) -> DataFrame:
    """Failures of one collection that weren't settled by hand."""
    open_ = F.coalesce("manual_status", F.lit("failed")).isin("failed", "rebuild")
    return failures.where((F.col("collection_type") == kind) & (F.col("collection_id") == collection) & open_)


def repaired(items: DataFrame, column: str, probed: DataFrame, key: str, wrong: tuple[str, ...] = ("", "未知", "unknown")) -> DataFrame:
    """Missing values of a column taken from ``probed`` (``key, column``); ``was_repaired`` tells where."""
    other = probed.select(key, F.col(column).alias("__new"))
    lacking = F.col(column).isNull() | strip(F.col(column)).isin(*wrong)
    use = lacking & (F.coalesce("__new", F.lit("")) != "")
    return items.join(other, key, "left").withColumn("was_repaired", use).withColumn(column, F.when(use, F.col("__new")).otherwise(F.col(column))).drop("__new")


def with_extras(parsed: DataFrame, extras: DataFrame, key: str) -> DataFrame:
    """Filled values of ``extras`` over parsed ones, column by column."""
    shared = [c for c in extras.columns if c != key and c in parsed.columns]
    other = extras.select(key, *[F.col(c).alias(f"__{c}") for c in shared])
    return parsed.join(other, key, "left").select(*[F.coalesce(blank_as_null(F.col(f"__{c}")), c).alias(c) if c in shared else F.col(c) for c in parsed.columns])


def payload_video(raw: Column) -> Column:
    """The video a payload names, from its field or from any address in it."""
    return first_filled(F.from_json(raw, PAYLOAD)["data"]["bvid"], video_id(raw))
