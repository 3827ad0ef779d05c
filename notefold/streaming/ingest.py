"""Incremental ingestion as structured streams: manifests upserted batch by batch, events in windows, log results.

Each stream stops by itself once what has arrived is processed (``availableNow``), and its checkpoint in the shared folder
makes the next start go on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from notefold.operators.manifest import latest, upsert_any


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drained(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that has arrived, ``each(batch, number)`` at a time; a repeated number must repeat its effect."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserting(spark: SparkSession, target: str, keys: list[str], position: str) -> Callable[[DataFrame, int], None]:
    """A batch function that merges a batch into a versioned table: version ``n + 1`` is written from version ``n``.

    A repeated batch overwrites the version it made before, so the table holds each batch once.
    """

    def each(batch: DataFrame, number: int) -> None:
        if number == 0:
            merged = latest(batch, [position], position)
        else:
            old = spark.read.schema(batch.schema).parquet(f"{target}/v={number - 1}")
            merged = upsert_any(old, batch, keys, position)
        merged.write.mode("overwrite").parquet(f"{target}/v={number}")

    return each


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``by, start, n, total`` per window of event time; events later than the watermark are dropped by the engine.

    ``at`` is cast to an instant, as a watermark can't be put on a timestamp without zone.
    """
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    counted = timed.groupBy(F.window("__at", width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(by, F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``by, start, end, n`` of sessions that end after a gap."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    counted = timed.groupBy(F.session_window("__at", gap), by).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def structured_lines(lines: DataFrame, prefix: str, schema: str) -> DataFrame:
    """Lines with a prefix, what follows read as JSON; null where that fails."""
    return lines.where(F.col("value").startswith(prefix)).select(F.from_json(F.substring("value", len(prefix) + 1, 1 << 30), StructType.fromDDL(schema)).alias("result"))


def running_status(events: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """``key, status, at, changes`` kept per key over all batches: the latest status and how often it changed."""
    out = f"{key} string, status string, at timestamp, changes bigint"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, seen, changes = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        for new, when in zip(rows["status"], rows["at"]):
            if seen is None or when >= seen:
                changes += last is not None and new != last
                last, seen = new, when
        state.update((last, seen, changes))
        yield pd.DataFrame({key: [k[0]], "status": [last], "at": [seen], "changes": [changes]})

    own = events.select(F.col(key).cast("string").alias(key), F.col(at).cast("timestamp").alias("at"), F.col(status).alias("status"))
    return own.groupBy(key).applyInPandasWithState(step, out, "status string, at timestamp, changes bigint", "update", "NoTimeout")
