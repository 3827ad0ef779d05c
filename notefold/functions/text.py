"""String, time and number functions as Column expressions.

White space means Unicode's white space throughout, spelled out, as Java's ``\\s`` covers ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# File endings by media type, and words that mean yes in an option.
EXTENSIONS = {
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/svg+xml": ".svg",
    "image/avif": ".avif",
}
YES = ("1", "true", "yes", "y", "on")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it.

    Inside higher-order functions nothing is shared between the uses of an expression, so this matters there.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def blank_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(blank_as_null(c) for c in columns))


def line_feeds(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n|\r", "\n")


def clean_text(c: Column) -> Column:
    """Line ends evened, blanks before them dropped, at most two blank lines in a row, stripped."""
    c = F.regexp_replace(line_feeds(c), "[ \t]+\n", "\n")
    return strip(F.regexp_replace(c, "\n{4,}", "\n\n\n"))


def tidy_markdown(c: Column) -> Column:
    """No-break spaces as spaces, blanks before line ends dropped, at most one blank line in a row, stripped."""
    c = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), "[ \t]+\n", "\n")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def squeeze_markdown(c: Column) -> Column:
    """Line ends evened, at most one blank line in a row, stripped; blanks and no-break spaces stay."""
    return strip(F.regexp_replace(line_feeds(c), "\n{3,}", "\n\n"))


def compact(c: Column) -> Column:
    """Runs of blanks as one, none around line ends, no zero-width signs, stripped. Entities are ``html.unescaped``'s."""
    c = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), "[​‌‍﻿]", "")
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t\r\f\u000b]+", " "), " *\n *", "\n"))


def slug(c: Column, fallback: Column | str = "untitled") -> Column:
    """A file name: forbidden signs and white space as hyphens, trimmed, 120 code points at most."""
    c = F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]+', "-"), rf"{WS}+", "-")
    c = F.substring(F.regexp_replace(c, r"^[ .\-_]+|[ .\-_]+\z", ""), 1, 120)
    return F.coalesce(blank_as_null(c), fallback if isinstance(fallback, Column) else F.lit(fallback))


def head_lines(c: Column, most: int = 10) -> Column:
    """The first lines of a cleaned text, with ``...`` if there are more."""
    lines = F.split(clean_text(F.coalesce(c, F.lit(""))), "\n")
    cut = F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n..."))
    return F.when(F.size(lines) > most, cut).otherwise(F.array_join(lines, "\n"))


def telling_line(c: Column) -> Column:
    """The first filled line, or the last one of a traceback; empty if there is none."""
    lines = F.filter(F.transform(F.split(line_feeds(F.coalesce(c, F.lit(""))), "\n"), strip), lambda x: x != "")
    trace = F.element_at(lines, 1).startswith("Traceback")
    return F.when(F.size(lines) == 0, "").when(trace, F.element_at(lines, -1)).otherwise(F.element_at(lines, 1))


def yaml_scalar(c: Column) -> Column:
    """A frontmatter value, quoted as JSON where it holds a sign of YAML or white space at an end."""
    risky = c.rlike(rf"""[:#\[\]{{}},&*!|>'"%@`]|^{WS}|{WS}\z""")
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(c.isNull() | (c == ""), "").when(risky, quoted).otherwise(c)


def heading(c: Column, fallback: Column | None = None) -> Column:
    """The first level-one heading, else ``fallback`` or the empty string."""
    found = strip(F.regexp_extract(c, rf"(?m)(?:^|(?<=\n))#{WS}+([^\n]+)", 1))
    return F.coalesce(blank_as_null(found), fallback) if fallback is not None else F.coalesce(found, F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def split_tags(c: Column) -> Column:
    """Tags of a scalar: ``[a, b]`` or one tag; quotes and blanks around them dropped."""
    inner = F.transform(F.split(F.regexp_replace(c, r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(strip(x), r"""^["']+|["']+$""", ""))
    one = F.array(strip(c))
    bracketed = c.startswith("[") & c.endswith("]")
    tags = F.when(bracketed, F.filter(inner, lambda x: x != "")).otherwise(one)
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(tags)


def inferred_tags(tags: Column, note_type: Column, source_type: Column, status: Column) -> Column:
    """Tags with those that follow from a note's type, source and status; the first of equals stays."""
    web = F.when(source_type == "wechat-article", F.array(F.lit("source/web"), F.lit("source/wechat")))
    source = web.when((source_type != "markdown") & (source_type != ""), F.array(F.concat(F.lit("source/"), source_type)))
    kind = F.when(note_type == "video-note", F.array(F.lit("video"))).when(note_type == "course-note", F.array(F.lit("course")))
    state = F.when(status != "", F.array(F.concat(F.lit("status/"), status)))
    none = F.array().cast("array<string>")
    parts = [F.transform(F.coalesce(tags, none), strip), *(F.coalesce(x, none) for x in (kind, source, state))]
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "")))


def snippet_at(c: Column, second: Column, duration: Column, most: int = 90) -> Column:
    """The sentence at a moment's share of the duration."""
    flat = strip(F.regexp_replace(c, rf"{WS}+", " "))
    parts = F.filter(F.transform(F.split(flat, "[。！？\n]+"), strip), lambda x: x != "")
    at = F.floor(second / F.greatest(duration, F.lit(1.0)) * F.size(parts))
    at = F.greatest(F.lit(0), F.least(F.size(parts) - 1, at)).cast("int")
    chosen = F.regexp_replace(F.substring(F.element_at(parts, at + 1), 1, most), "[，,、 ]+$", "")
    return F.when(F.size(parts) == 0, F.substring(flat, 1, most)).otherwise(chosen)


def without_details(c: Column) -> Column:
    """Without ``details`` tags and a leading ``summary``."""
    return strip(F.regexp_replace(strip(F.regexp_replace(c, r"(?i)</?details>", "")), rf"(?is)^<summary>.*?</summary>{WS}*", ""))


def asset_extension(url: Column, content_type: Column) -> Column:
    """File ending of an asset by its address's format parameter, its path, or its media type."""
    asked = first_filled(F.parse_url(url, F.lit("QUERY"), F.lit("wx_fmt")), F.parse_url(url, F.lit("QUERY"), F.lit("format")))
    asked = F.lower(F.substring_index(asked, ";", 1))
    asked = F.when(asked == "jpeg", "jpg").otherwise(asked)
    suffix = F.lower(F.regexp_extract(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), r"[^/.](\.[A-Za-z0-9]{2,6})$", 1))
    kinds = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    by_type = F.try_element_at(kinds, F.lower(F.substring_index(content_type, ";", 1)))
    return (
        F.when(asked.rlike("^[a-z0-9]+$"), F.concat(F.lit("."), asked))
        .when(suffix == ".jpeg", ".jpg")
        .when(suffix != "", suffix)
        .otherwise(F.coalesce(by_type, F.lit(".bin")))
    )


def data_url(content: Column, media_type: Column) -> Column:
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.regexp_replace(F.base64(content), "\r?\n", ""))


def listed_code(c: Column) -> Column:
    """A listing code in capitals, with its exchange where only six digits stand."""
    c = F.upper(strip(c))
    return F.when(c.rlike(r"^[03]\d{5}$"), F.concat(c, F.lit(".SZ"))).when(c.rlike(r"^6\d{5}$"), F.concat(c, F.lit(".SH"))).otherwise(c)


def is_external(target: Column) -> Column:
    return target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | target.startswith("#")


def is_remote(url: Column) -> Column:
    return url.rlike(r"^(?i)https?://")


def video_id(url: Column) -> Column:
    return blank_as_null(F.regexp_extract(url, r"(?<![0-9A-Za-z])(BV[0-9A-Za-z]+)", 1))


def part_number(url: Column) -> Column:
    """The part of a multi-part item, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_extract(url, r"[?&]p=(\d+)", 1).try_cast("int"), F.lit(1)))


def https(url: Column) -> Column:
    """Addresses without scheme, or with plain HTTP, as HTTPS."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("http://"), F.concat(F.lit("https://"), F.substring(url, 8, 1 << 30))).otherwise(url)


def iso_seconds(epoch: Column) -> Column:
    """Epoch seconds as ISO text in UTC, empty if they are none."""
    n = epoch.try_cast("bigint")
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)
    return F.coalesce(F.date_format(F.when(F.abs(n) < 250_000_000_000, at), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def iso_millis(epoch: Column) -> Column:
    return iso_seconds(F.floor(epoch.try_cast("bigint") / 1000))


def duration_text(seconds: Column) -> Column:
    """``1小时2分3秒`` or ``2分3秒``, rounded half up; empty if it is no number."""
    rounded = F.floor(seconds.try_cast("double") + 0.5)
    total = F.when(rounded.isNotNull(), F.greatest(F.lit(0), rounded)).cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    short = F.concat(m.cast("string"), F.lit("分"), s.cast("string"), F.lit("秒"))
    return F.coalesce(F.when(h > 0, F.concat(h.cast("string"), F.lit("小时"), short)).otherwise(short), F.lit(""))


def duration_minutes(seconds: Column) -> Column:
    """Minutes and seconds only, as lists of videos give them."""
    n = seconds.try_cast("bigint")
    return F.coalesce(F.concat(F.floor(n / 60).cast("string"), F.lit("分"), (n % 60).cast("string"), F.lit("秒")), F.lit(""))


def duration_seconds(c: Column) -> Column:
    """Seconds of ``1小时2分3秒``, ``1:02:03``, ``02:03`` or a plain number; null otherwise."""
    words = rf"^{WS}*(?:(\d+)\s*小时)?\s*(?:(\d+)\s*分钟?)?\s*(?:(\d+)\s*秒)?{WS}*$"
    clock = rf"^{WS}*(?:(\d+):)?(\d{{1,3}}):(\d{{2}}){WS}*$"
    part = lambda p, i: F.coalesce(F.regexp_extract(c, p, i).try_cast("bigint"), F.lit(0))
    total = lambda p: part(p, 1) * 3600 + part(p, 2) * 60 + part(p, 3)
    return (
        F.when(strip(c) == "", None)
        .when(c.rlike(words), total(words))
        .when(c.rlike(clock), total(clock))
        .otherwise(F.floor(strip(c).try_cast("double") + 0.5).cast("bigint"))
    )


def clock_text(seconds: Column) -> Column:
    """``MM:SS``, or ``HH:MM:SS`` from an hour on; halves are rounded to even."""
    total = F.bround(seconds.cast("double"), 0).cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).when(h.isNotNull(), F.format_string("%02d:%02d", m, s))


def dashed_date(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def whole_number(c: Column, default: int = 0) -> Column:
    return F.coalesce(strip(c).try_cast("int"), F.lit(default))


def unset_or_positive(c: Column) -> Column:
    """-1 for nothing, otherwise a number that isn't negative."""
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", -1).otherwise(F.greatest(F.lit(0), whole_number(c)))


def whole_numbers(c: Column) -> Column:
    """The numbers of an array that aren't negative, repeats kept."""
    return F.filter(F.transform(c, lambda x: whole_number(x, -1)), lambda x: x >= 0)


def yes(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(*YES)


def sheet_column(ref: Column) -> Column:
    """Place from 0 of a spreadsheet column named by letters."""
    letters = F.split(F.regexp_replace(F.upper(ref), "[^A-Z]", ""), "")
    return F.greatest(F.lit(0), F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1)


def human_bytes(n: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    one = lambda x: F.format_string("%.1f", x)
    return (
        F.when(n >= gb, F.concat(one(n / gb), F.lit(" GB")))
        .when(n >= mb, F.concat(one(n / mb), F.lit(" MB")))
        .otherwise(F.concat(one(n / kb), F.lit(" KB")))
    )


def padded(row: Column, width: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(row)).cast("int")))


def looked_up(table: dict[str, str], key: Column, default: str | Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, key), default if isinstance(default, Column) else F.lit(default))


def merged(old: Column, new: Column) -> Column:
    """Two maps in one; where both have a key the new value counts, even if it is null."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def head_hash(content: Column, head: int = 65_536, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.substring(content, 1, head), 256), 1, digits)


def error_class(code: Column, message: Column, http: Column) -> Column:
    """Kinds of failure of a remote call, the gravest first."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(http.isin(401) | (code == -101), "login")
        .when(http.isin(403, 412) | (code == -412), "blocked")
        .when(http.isin(404) | code.isin(-404, 62002), "gone")
        .when(http.isin(408, 425, 429) | (http >= 500) | text.contains("timed out"), "retry")
        .otherwise("other")
    )


def retryable(http: Column) -> Column:
    return http.isin(408, 409, 425, 429) | (http >= 500)
