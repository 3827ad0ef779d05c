"""Timestamps of mixed spelling, precision and zone, as UTC instants.

Every value becomes an array of its valid readings, built by JVM expressions only. Readings differ in the order of day,
month and two-digit year of an all-numeric date, in the unit of a count of ticks that fits two, and, where the machine has
no zone, in the place that a zone abbreviation stands for. Per source (machine) and field, in record order, a Viterbi pass
picks one reading per value; it penalises a switch of convention between records and a jump backwards in time. What the
machine declares, its date order and its zone, outweighs both: there the pass is left with what is not declared. Local
times that occur twice or not at all are no alternatives, as their reading is stated.

A pass needs each source's records in order, yet one source may hold any share of the rows. Records are therefore range
partitioned by (source, order), and each Arrow batch solves its stretch of a source for every pair of a first and a last
convention and reduces it to a min-plus matrix of 9 x 9. The matrices, one per source and batch, are then chained, and each
row takes the pick of its stretch's pair. No task holds more of a source than a batch of its records, or its matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.session import materialise, small, spread

# English month names by their first three letters, and the date orders of all-numeric dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ORDERS = ("ymd", "dmy", "mdy")

#: Costs of the Viterbi pass.
SWITCH, BACKWARD, UNDECLARED, IMPOSSIBLE = 3.0, 1.0, 1e6, 1e12

#: A convention is a date order and one of ``ALTERNATIVES`` readings of a unit or an abbreviation; rows of a range partition.
ALTERNATIVES, PARTITION_ROWS = 3, 500_000
STATES = len(ORDERS) * ALTERNATIVES

# Minutes east of Greenwich that a zone abbreviation may stand for.
ABBREVIATIONS = {
    "GMT": [0], "WET": [0], "WEST": [60], "CET": [60], "CEST": [120], "EET": [120], "EEST": [180], "MSK": [180], "SGT": [480], "HKT": [480], "JST": [540], "KST": [540],
    "AEST": [600], "AEDT": [660], "NZST": [720], "NZDT": [780], "EDT": [-240], "CDT": [-300], "MDT": [-360], "PDT": [-420], "MST": [-420],
    "EST": [-300, 600], "CST": [-360, 480, -300], "PST": [-480, 480], "BST": [60, 360], "IST": [330, 120, 60], "AST": [-240, 180],
}

#: Rows up to which the machine table, or the table of chosen pairs, is broadcast.
BROADCAST_ROWS = 200_000

FULL = "０１２３４５６７８９－：／．，＋（）　   "
HALF = "0123456789-:/.,+()    "

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(?:([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"Z|(?:UTC|GMT)?\s*[+-]\d{1,2}(?::?\d{2})?|[\[(]?[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+[\])]?|[\[(]?[A-Za-z]{2,5}[\])]?"
_TAIL = rf"(?:[Tt ]\s*{_CLOCK})?\s*({_ZONE})?$"
ISO = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TAIL}"
NUMERIC = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_TAIL}"
SHORT = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{2}}){_TAIL}"
DAY_MONTH = rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3,9}})\.?,?\s+(\d{{4}}){_TAIL}"
MONTH_DAY = rf"^([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}){_TAIL}"
CHINESE = (
    r"^(\d{4})年(\d{1,2})月(\d{1,2})[日号]?\s*"
    r"(?:(上午|下午|中午|凌晨|早上|晚上)?\s*(\d{1,2})(?:[时點点:])(?:(\d{1,2})分?)?(?::?(\d{1,2})秒?)?)?$"
)
PACKED = r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})?(Z)?)?$"
EPOCH = r"^(\d{9,10})(?:\.\d+)?$|^(\d{12,13})$|^(\d{15,16})$|^(\d{18,19})$"
UNSURE = r"^(\d{11})$|^(\d{17})$"

_RESULT = (
    "kind int, source string, part bigint, id bigint, field string, picks array<bigint>, "
    "costs array<double>, first_sec array<bigint>, last_sec array<bigint>"
)


def clean(value: Column) -> Column:
    """Full-width signs narrowed; blanks, quotes and invisible marks around the value removed."""
    narrow = F.regexp_replace(F.translate(value, FULL, HALF), "[​-‍﻿⁠]", "")
    return F.regexp_replace(narrow, r"""^[\s"'`]+|[\s"'`]+$""", "")


def _seconds(ntz: Column) -> Column:
    """Epoch seconds of a TIMESTAMP_NTZ read as UTC, whatever the session's zone."""
    days = F.unix_date(ntz.cast("date")).cast("bigint")
    return days * 86400 + F.hour(ntz) * 3600 + F.minute(ntz) * 60 + F.second(ntz)


def _utc(local: Column, zone: Column, machine_zone: Column, known: list[str]) -> Column:
    """Epoch seconds of a local time, null without a usable zone.

    A local time that occurs twice means the earlier instant, a skipped one takes the offset before the change; the JVM's
    zone rules do both. A zone abbreviation other than UTC is read as the machine's own zone.
    """
    bare = F.regexp_replace(F.coalesce(zone, F.lit("")), r"[\[\]()\s]", "")
    upper, wall = F.upper(bare), _seconds(local)
    digits = F.regexp_replace(F.regexp_extract(upper, r"^(?:UTC|GMT)?([+-]\d{1,2}(?::?\d{2})?)$", 1), ":", "")
    sign = F.when(digits.startswith("-"), -1).otherwise(1)
    hours = F.substring(F.regexp_replace(digits, r"^([+-])(\d)(\d\d)?$", "$10$2$3"), 2, 2).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(digits, r"^[+-]\d{1,2}?(\d{2})$", 1).try_cast("int"), F.lit(0))
    minutes = F.when(F.length(digits) > 3, minutes).otherwise(0)
    name = F.when(bare.contains("/"), bare).otherwise(machine_zone)
    name = F.when(name.isin(known), name)
    return (
        F.when(upper.isin("Z", "UTC"), wall)
        .when(digits != "", F.when((hours <= 18) & (minutes <= 59), wall - sign * (hours * 3600 + minutes * 60)))
        .otherwise(_seconds(F.convert_timezone(name, F.lit("UTC"), local)))
    )


def readings(value: Column, machine_zone: Column, known: list[str]) -> Column:
    """All valid readings of a value: ``ARRAY<STRUCT<ord INT, alt INT, sec BIGINT>>``, empty if it names no instant.

    ``ord`` is the place in ``ORDERS`` of the date order a reading supposes, ``alt`` that of the unit or of the abbreviation's
    meaning, each -1 where the spelling leaves no choice.
    A date alone stands for midnight; fractions of a second are dropped; an impossible date or time gives no reading.
    """
    t = clean(value)
    text = lambda p, i: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    number = lambda p, i: text(p, i).try_cast("int")

    def parts(order: int, y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, zone: Column) -> Column:
        zero = lambda c: F.coalesce(c, F.lit(0))
        day = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", y, mo, d, zero(h), zero(mi), zero(s))
        fits = (zero(h) <= 23) & (zero(mi) <= 59) & (zero(s) <= 59) & mo.isNotNull()
        local = F.when(fits, day.try_cast("timestamp_ntz"))
        return F.struct(F.lit(order).alias("ord"), local.alias("local"), zone.alias("zone"))

    def dated(p: str, y: int, mo: int, d: int, order: int = -1, named: bool = False, short: bool = False) -> Column:
        month, year = number(p, mo), number(p, y)
        if short:
            year = F.when(F.length(text(p, y)) == 2, F.when(year < 70, year + 2000).otherwise(year + 1900))
        if named:
            at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(text(p, mo), 1, 3)))
            month = F.nullif(at, F.lit(0)).cast("int")
        half, hour = F.lower(F.substring(text(p, 8), 1, 1)), number(p, 4)
        noon = F.when((hour < 1) | (hour > 12), 99).when(half == "p", hour % 12 + 12).otherwise(hour % 12)
        return parts(order, year, month, number(p, d), F.when(half.isNull(), hour).otherwise(noon), number(p, 5), number(p, 6), text(p, 9))

    half, hour, nothing = text(CHINESE, 4), number(CHINESE, 5), F.lit(None).cast("string")
    late = half.isin("下午", "晚上") | ((half == "中午") & (hour < 11))
    hour = F.when(late & (hour < 12), hour + 12).when(half.isin("上午", "凌晨", "早上") & (hour == 12), 0).otherwise(hour)
    chinese = parts(-1, *(number(CHINESE, i) for i in (1, 2, 3)), hour, number(CHINESE, 6), number(CHINESE, 7), nothing)
    packed = parts(-1, *(number(PACKED, i) for i in range(1, 7)), text(PACKED, 7))
    found = (
        F.when(t.rlike(ISO), F.array(dated(ISO, 1, 2, 3)))
        .when(t.rlike(NUMERIC), F.array(dated(NUMERIC, 3, 2, 1, 1), dated(NUMERIC, 3, 1, 2, 2)))
        .when(t.rlike(SHORT), F.array(dated(SHORT, 1, 2, 3, 0, short=True), dated(SHORT, 3, 2, 1, 1, short=True), dated(SHORT, 3, 1, 2, 2, short=True)))
        .when(t.rlike(CHINESE), F.array(chinese))
        .when(t.rlike(PACKED), F.array(packed))
        .when(t.rlike(DAY_MONTH), F.array(dated(DAY_MONTH, 3, 2, 1, named=True)))
        .when(t.rlike(MONTH_DAY), F.array(dated(MONTH_DAY, 3, 1, 2, named=True)))
    )
    offsets = F.create_map(*(F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, ",".join(map(str, v)))))
    kind = "array<struct<ord:int,alt:int,sec:bigint>>"

    def instants(r: Column) -> Column:
        sec = _utc(r["local"], r["zone"], machine_zone, known)
        meant = F.split(F.element_at(offsets, F.upper(F.regexp_replace(r["zone"], r"[\[\]()\s]", ""))), ",")
        placed = F.transform(meant, lambda x, i: F.struct(r["ord"].alias("ord"), F.when(F.size(meant) > 1, i).otherwise(-1).alias("alt"), (_seconds(r["local"]) - x.cast("int") * 60).alias("sec")))
        return F.when(sec.isNotNull(), F.array(F.struct(r["ord"].alias("ord"), F.lit(-1).alias("alt"), sec.alias("sec")))).otherwise(placed).cast(kind)

    read = F.flatten(F.filter(F.transform(F.filter(found, lambda r: r["local"].isNotNull()), instants), lambda r: r.isNotNull()))
    whole = lambda i: text(EPOCH, i).try_cast("decimal(20,0)")
    since = F.coalesce(whole(1), F.floor(whole(2) / 1000), F.floor(whole(3) / 1_000_000), F.floor(whole(4) / 1_000_000_000))
    tick = lambda alt, sec: F.struct(F.lit(alt).alias("ord"), F.lit(alt).alias("alt"), sec.cast("bigint").alias("sec"))
    epoch = F.when(since.isNotNull(), F.array(tick(-1, since)))
    unsure = lambda i, a, b: F.when(text(UNSURE, i).isNotNull(), F.array(*(F.struct(F.lit(-1).alias("ord"), F.lit(k).alias("alt"), F.floor(text(UNSURE, i).try_cast("decimal(20,0)") / n).cast("bigint").alias("sec")) for k, n in enumerate((a, b)))))
    none = F.array().cast(kind)
    return F.coalesce(F.filter(F.coalesce(read, epoch, unsure(1, 1000, 1), unsure(2, 1_000_000_000, 1_000_000)), lambda r: r["sec"].isNotNull()), none)


def _costs(read: list, declared: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The instant each convention gives a record, and its own cost."""
    secs, emit = np.zeros(STATES, np.int64), np.full(STATES, IMPOSSIBLE)
    for r in read:
        price = 0.0 if r["ord"] < 0 or declared is None or declared == ORDERS[r["ord"]] else UNDECLARED
        for o in range(len(ORDERS)) if r["ord"] < 0 else (r["ord"],):
            for a in range(ALTERNATIVES) if r["alt"] < 0 else (r["alt"],):
                if price < emit[o * ALTERNATIVES + a]:
                    secs[o * ALTERNATIVES + a], emit[o * ALTERNATIVES + a] = r["sec"], price
    bad = emit >= IMPOSSIBLE  # a convention this record can't follow stands for its best reading, at a price
    secs[bad] = secs[emit.argmin()]
    emit[bad] = emit.min() + SWITCH
    return secs, emit


def _change() -> np.ndarray:
    order, alt = np.divmod(np.arange(STATES), ALTERNATIVES)
    return SWITCH * ((order[:, None] != order[None, :]).astype(float) + (alt[:, None] != alt[None, :]))


def _stretch(read: list[list], declared: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Best costs for every pair of a first and a last convention, each record's picks by pair (``first * STATES + last``;
    one pick where all agree), and what the first and the last record are under each convention."""
    change, costs, steps = _change(), None, []
    settled = False  # no switch of convention pays before the next record that has a choice
    first_secs = before = None
    for options, order in zip(read, declared):
        sure = len(options) == 1 and options[0]["ord"] < 0 and options[0]["alt"] < 0
        secs, emit = (np.full(STATES, options[0]["sec"]), np.zeros(STATES)) if sure else _costs(options, order)
        if before is None:
            costs, first_secs, back = np.full((STATES, STATES), IMPOSSIBLE), secs, None
            costs[np.arange(STATES), np.arange(STATES)] = emit
        elif sure and settled:
            costs, back = costs + BACKWARD * float(secs[0] < before[0]), None
        else:
            ways = costs[:, :, None] + (change + BACKWARD * (secs[None, :] < before[:, None]))[None]
            back = ways.argmin(1).astype(np.int8)
            costs = ways.min(1) + emit[None, :]
        settled = sure and back is not None or sure and settled
        steps.append((None if sure else secs, secs, back))
        before = secs
    first, at = np.repeat(np.arange(STATES), STATES), np.tile(np.arange(STATES), STATES)
    picks = [None] * len(steps)
    for i in range(len(steps) - 1, -1, -1):
        choice, secs, back = steps[i]
        picks[i] = secs[:1] if choice is None else choice[at]
        if back is not None:
            at = back[first, at]
    return costs.ravel(), picks, first_secs, before


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Solve each batch's stretch of a source in a sorted partition; a row of kind 1 per record, one of kind 0 per stretch."""
    number = 0
    for batch in batches:
        for source, own in batch.groupby("source", sort=False, dropna=False):
            costs, picks, first, last = _stretch(own["readings"].tolist(), own["date_order"].tolist())
            part = (int(own["part"].iloc[0]) << 32) + number
            number += 1
            yield pd.DataFrame({"kind": 1, "source": own["source"], "part": part, "id": own["id"], "field": own["field"], "picks": picks, "costs": None, "first_sec": None, "last_sec": None})
            yield pd.DataFrame({"kind": [0], "source": [source], "part": [part], "id": [None], "field": [None], "picks": [None], "costs": [costs], "first_sec": [first], "last_sec": [last]}).astype({"id": "Int64"})


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """The pair of first and last convention of each stretch of one source."""
    rows = rows.sort_values("part")
    change, total, before, steps, links = _change(), None, None, [], []
    for flat, first, last in zip(rows["costs"], rows["first_sec"], rows["last_sec"]):
        matrix = np.asarray(flat, float).reshape(STATES, STATES)
        if total is None:
            enter, link = np.zeros(STATES), np.zeros(STATES, np.int8)
        else:
            ways = total[:, None] + change + BACKWARD * (np.asarray(first)[None, :] < before[:, None])
            enter, link = ways.min(0), ways.argmin(0).astype(np.int8)
        ways = enter[:, None] + matrix
        links.append(link)
        steps.append(ways.argmin(0).astype(np.int8))
        total, before = ways.min(0), np.asarray(last)
    last, pairs = int(total.argmin()), []
    for step, link in zip(reversed(steps), reversed(links)):
        first = int(step[last])
        pairs.append(first * STATES + last)
        last = int(link[first])
    return pd.DataFrame({"source": rows["source"], "part": rows["part"], "pair": pairs[::-1]})


def to_instants(
    df: DataFrame, machines: DataFrame, fields: list[str], id_col: str = "note_id", machine: str = "machine", order_by: str = "saved_at"
) -> DataFrame:
    """UTC instants of string columns: rows ``id_col, field STRING, utc_second BIGINT``, one per row and field of ``df``.

    ``machines`` has ``machine, zone, date_order``, one row each (the first by zone counts if there are more). A value that
    names no instant (null, blank, words, an impossible date) gives null, as does a local time of an unknown machine.
    Repeated rows give repeated results; other columns of ``df``, whatever their names, take no part; an empty table gives
    none. ``order_by`` may be null (such records come first); ties are ordered by id and field.
    """
    known = sorted(str(z) for z in df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())
    m = machines.select(F.col("machine").alias("source"), F.col("zone").alias("zone"), F.col("date_order").alias("date_order"))
    m = small(m.groupBy("source").agg(F.min_by("zone", F.coalesce("zone", F.lit(""))).alias("zone"), F.min_by("date_order", F.coalesce("zone", F.lit(""))).alias("date_order")), BROADCAST_ROWS)
    long = spread(df, id_col).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(machine).alias("source"),
        F.col(order_by).cast("timestamp_ntz").alias("at"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("v"),
    ).select("id", "source", "at", "v.field", "v.value")
    read = long.join(m, "source", "left").select("id", "source", "at", "field", "date_order", readings(F.col("value"), F.col("zone"), known).alias("readings"))
    read = materialise(read, "readings")
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-read.count() // PARTITION_ROWS))
    ranged = (
        read.where(F.size("readings") > 0)
        .repartitionByRange(parts, "source", "field", "at", "id")
        .sortWithinPartitions("source", "field", "at", "id")
        .withColumn("source", F.concat_ws("\u0001", F.coalesce("source", F.lit("")), "field"))
        .withColumn("part", F.spark_partition_id())
    )
    solved = materialise(ranged.select("id", "source", "field", "date_order", "readings", "part").mapInPandas(_solve, _RESULT), "solved")
    pairs = solved.where("kind = 0").select("source", "part", "costs", "first_sec", "last_sec").groupBy("source").applyInPandas(_chain, "source string, part bigint, pair int")
    picked = solved.where("kind = 1").join(small(materialise(pairs, "pairs"), BROADCAST_ROWS), ["source", "part"])
    return picked.select(F.col("id").alias(id_col), "field", F.element_at("picks", F.when(F.size("picks") == 1, 1).otherwise(F.col("pair") + 1)).alias("utc_second")).unionByName(
        read.where(F.size("readings") == 0).select(F.col("id").alias(id_col), "field", F.lit(None).cast("bigint").alias("utc_second"))
    )
