"""Packing of texts into containers of fixed capacity, by the sum-of-squares rule.

Texts are spread by a hash of their ids, and each task packs its texts online: a text goes to the fill level for which the sum of squared counts of partly filled
containers grows least, the counts kept in an array by level. Containers left open at a partition's end then go up a
reduction tree as items of their own, packed by the same rule, so that little space is lost however many partitions there
are. The tree moves only open containers, and a task of it takes a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.llm.tokens import VOCABULARY, counter
from notefold.session import bounded_batches, materialise, spread

#: Texts that one task packs, open containers that one task of the reduction tree takes, and how many of its tasks merge into
#: one. Which texts meet depends on their ids and number alone, not on how the table was stored.
TEXTS_PER_TASK, OPEN_PER_TASK, FAN_IN = 20_000, 50_000, 8

#: The fill from which a container counts as closed, and the part of the open containers above which a level that leaves so
#: many is the last one. Containers open then stay as they are; ``fill_report`` counts them.
CLOSED, LAST_LEVEL = 0.995, 0.98


class SumOfSquares:
    """Online packer. ``place(size)`` gives the container's number; ``counts[h]`` are the containers filled up to ``h``."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.counts = np.zeros(capacity + 1, np.int64)
        self.at: dict[int, list[int]] = {}

    def place(self, size: int) -> int:
        c, cap = self.counts, self.capacity
        if not 0 < size <= cap:
            raise ValueError("a size must be above 0 and within the capacity")
        bin_no, level = -1, 0
        new = 2 * c[size] + 1 if size < cap else 0
        if size < cap:
            now = c[1 : cap - size + 1]
            grown = 2 * (c[size + 1 : cap + 1] - now) + 2
            grown[-1] = 1 - 2 * now[-1]  # a container that gets full leaves the sum
            grown[now == 0] = np.iinfo(np.int64).max
            back = int(grown[::-1].argmin())  # of equals, the fullest
            if grown[-1 - back] <= new:
                level = cap - size - back
        if level:
            bin_no = self.at[level].pop()
            c[level] -= 1
        else:
            bin_no, self.made = self.made, self.made + 1
        if level + size < cap:
            c[level + size] += 1
            self.at.setdefault(level + size, []).append(bin_no)
        return bin_no


def _packer(capacity: int, level: int, key: str):
    """mapInPandas function: adds ``bin``, a number unique over all levels and partitions, by the column ``size``."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, packer = (level << 56) | (TaskContext.get().partitionId() << 32), SumOfSquares(capacity)
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "size": batch["size"], "bin": [base | packer.place(int(s)) for s in batch["size"]]})

    return pack


def pack_texts(docs: DataFrame, capacity: int, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Containers of texts: ``doc_id, piece_no, n_pieces, token_start, n_tokens, container``.

    A text of more tokens than ``capacity`` is divided into full containers and a rest (token ranges); no other is. A null
    or empty text has no tokens and no container (null, ``n_tokens`` 0, one piece). Repeated rows are packed each for
    itself; other columns are left out; an empty table gives none.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "doc_id bigint, piece_no int, n_pieces int, token_start bigint, n_tokens bigint"

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"]):
                n = count(text) if text else 0
                parts = max(1, -(-n // capacity))
                for i in range(parts):
                    rows.append((doc, i + 1, parts, i * capacity, min(capacity, n - i * capacity)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "n_pieces", "token_start", "n_tokens"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, packer = TaskContext.get().partitionId() << 32, SumOfSquares(capacity)
        for batch in batches:
            yield batch.assign(bin=pd.array([base | packer.place(int(size)) if size else None for size in batch["n_tokens"]], dtype="Int64"))

    sized = materialise(spread(docs, id_col).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInPandas(tokenise, schema), "sized")
    first = max(1, -(-sized.count() // TEXTS_PER_TASK))
    spread_out = sized.repartition(first, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id", "piece_no"), "doc_id", "piece_no")
    placed = materialise(spread_out.mapInPandas(place, f"{schema}, bin bigint"), "placed")
    bins = placed.where("bin is not null").groupBy("bin").agg(F.sum("n_tokens").alias("size"))
    closed = int(capacity * CLOSED)
    opened = materialise(bins.where(F.col("size") < closed), "open")
    # A container's number after the levels so far; one that was never merged keeps its own.
    number = None
    level, tasks = 0, first
    while True:
        before = opened.count()
        if tasks == 1 or before < 2:
            break
        level += 1
        tasks = max(1, -(-tasks // FAN_IN), -(-before // OPEN_PER_TASK))
        ordered = opened.select(F.col("bin").alias("child"), "size").repartition(tasks, F.xxhash64("child", F.lit(level))).sortWithinPartitions(F.desc("size"), "child")
        merged = materialise(ordered.mapInPandas(_packer(capacity, level, "child"), "child bigint, size bigint, bin bigint"), "merged")
        step = merged.select("child", "bin")
        number = step if number is None else number.withColumnRenamed("bin", "mid").join(step.select(F.col("child").alias("mid"), F.col("bin").alias("next")), "mid", "left").select("child", F.coalesce("next", "mid").alias("bin"))
        opened = materialise(merged.groupBy("bin").agg(F.sum("size").alias("size")).where(F.col("size") < closed), "open")
        if tasks > 1 and opened.count() > LAST_LEVEL * before:
            break
    if number is None:
        return placed.withColumnRenamed("bin", "container")
    found = placed.join(number.select(F.col("child").alias("bin"), F.col("bin").alias("container")), "bin", "left")
    return found.select("doc_id", "piece_no", "n_pieces", "token_start", "n_tokens", F.coalesce("container", "bin").alias("container"))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """``n_containers, n_tokens, mean_fill`` of a packing."""
    return (
        packed.where("container is not null")
        .groupBy("container")
        .agg(F.sum("n_tokens").alias("filled"))
        .agg(F.count("*").alias("n_containers"), F.sum("filled").alias("n_tokens"), (F.sum("filled") / F.count("*") / capacity).alias("mean_fill"))
    )
