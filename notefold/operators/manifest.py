"""Manifests as keyed tables: upserts, skips, rollups, edits by position, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notefold.functions.text import blank_as_null


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the largest ``order`` per key; one aggregation with map-side combining, no window."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("top"))
    return top.select(*keys, "top.*").select(*df.columns)


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the smallest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("top"))
    return top.select(*keys, "top.*").select(*df.columns)


def upsert_any(old: DataFrame, new: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows of ``new`` merged into the first row of ``old`` that shares any filled key; the others are appended.

    The disjunction is an equal join per key, united, so no nested loop is needed. Values of ``new`` that aren't null count,
    others keep the old row's. Rows of ``old`` keep their ``position``; if several rows of ``new`` meet one of ``old``, the
    last by ``position`` counts.
    """
    others = [c for c in old.columns if c != position]
    links = [
        old.select(blank_as_null(F.col(k)).alias("k"), F.col(position).alias("o")).where("k is not null").groupBy("k").agg(F.min("o").alias("o")).join(
            new.select(blank_as_null(F.col(k)).alias("k"), F.col(position).alias("n")).where("k is not null"), "k"
        ).select("n", "o")
        for k in keys
    ]
    matched = reduce(DataFrame.unionByName, links).groupBy("n").agg(F.min("o").alias("o"))
    winner = matched.groupBy("o").agg(F.max("n").alias("n"))
    fresh = new.select(F.col(position).alias("n"), *[F.col(c).alias(f"new_{c}") for c in others])
    updates = winner.join(fresh, "n").withColumnRenamed("o", position)
    kept = old.join(updates, position, "left").select(position, *[F.coalesce(f"new_{c}", c).alias(c) for c in others])
    appended = new.join(matched.select(F.col("n").alias(position)), position, "left_anti")
    return kept.unionByName(appended.select(position, *others))


def upsert_all(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full merge by all keys, null keys alike; values of ``new`` that aren't null count."""
    others = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.join(b, same, "full_outer").select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in [*keys, *others]])


def not_known(entries: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """Entries none of whose ids is known: one anti join per id column, instead of one with a disjunction."""
    for column, ids in known.items():
        entries = entries.join(ids.select(F.col(ids.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct(), column, "left_anti")
    return entries


def known_ids(notes: DataFrame, path: str = "path", text: str = "body", head: int = 4096) -> tuple[DataFrame, DataFrame]:
    """``bvid`` and ``avid`` of notes, from the file name behind the last underscore and from the text's head."""
    name = F.substring_index(F.regexp_replace(F.col(path), r"\.[^./]*$", ""), "_", -1)
    in_text = F.explode(F.regexp_extract_all(F.substring(F.col(text), 1, head), F.lit(r"BV[0-9A-Za-z]{10}"), F.lit(0)))
    bvid = notes.select(name.alias("bvid")).where("bvid rlike '^BV'").unionByName(notes.where(F.col(text).isNotNull()).select(in_text.alias("bvid"))).distinct()
    avid = notes.select(name.alias("avid")).where(r"avid rlike '^[0-9]+$'").distinct()
    return bvid, avid


def status_rollup(items: DataFrame, by: str, status: Column, kinds: list[str]) -> DataFrame:
    """Counts per status for each value of ``by`` and in total (``by`` null, ``is_total`` true), in one pass."""
    counts = [F.count_if(status == k).alias(k) for k in kinds]
    return items.rollup(by).agg(F.grouping(by).cast("boolean").alias("is_total"), F.count("*").alias("items"), *counts)


def drop_positions(items: DataFrame, position: str, positions: list[int]) -> DataFrame:
    """Without the rows at the given positions; an unknown position is an error and changes nothing."""
    wanted = sorted(set(positions))
    held = items.where(F.col(position).isin(wanted)).select(position).distinct().count()
    if held != len(wanted):
        raise ValueError("a position is out of range")
    return items.where(~F.col(position).isin(wanted))


def set_at(items: DataFrame, position: str, positions: list[int], column: str, value: str | None) -> DataFrame:
    """``column`` set (or cleared with None) at the given positions."""
    at = F.col(position).isin(sorted(set(positions)))
    return items.withColumn(column, F.when(at, F.lit(value).cast("string")).otherwise(F.col(column)))


def changed(before: DataFrame, after: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """Rows of ``after`` that are new or differ from ``before`` in any mark, nulls compared as values."""
    old = before.select(F.col(key), *[F.col(m).alias(f"old_{m}") for m in marks], F.lit(True).alias("was"))
    differs = reduce(Column.__or__, [~F.col(m).eqNullSafe(F.col(f"old_{m}")) for m in marks])
    return after.join(old, key, "left").where(F.col("was").isNull() | differs).select(*after.columns)


def not_done(sources: DataFrame, done: DataFrame, key: str, content_hash: str | None = None) -> DataFrame:
    """Sources without an output, or, with ``content_hash``, also those whose content differs from the one recorded."""
    keys = [key, *([content_hash] if content_hash else [])]
    return sources.join(done.select(*keys).distinct(), keys, "left_anti")


def bounded_history(entries: DataFrame, id_col: str, order: str, most: int = 100) -> DataFrame:
    """The latest entry per id, of those the ``most`` recent."""
    return latest(entries, [id_col], order).orderBy(F.desc(order), F.asc(id_col)).limit(most)


def sampled_by_kind(df: DataFrame, kind: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each kind."""
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")
