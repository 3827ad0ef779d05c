"""Mixing of sources to target shares of all tokens, by pivotal dependent rounding.

Every record of a source has the same expected number of copies, its source's wanted tokens over its tokens at hand, cut
at the source's most repeats. The whole part is given to each record; the fractional parts are rounded dependently: pairs
of records exchange token mass at random until one of the two is whole, which keeps a source's total and each record's
expectation. A source's few large records settle first, each against all its smaller ones together. A partition passes on at most one unsettled record per source; these few settle in a reduction tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.llm.tokens import VOCABULARY, counter
from notefold.session import bounded_batches, materialise, small, spread

#: Unsettled records of a source that one task of the reduction tree takes.
FAN_IN = 64
#: A record is large from this part of its source's tokens on, so a source has at most the inverse of them.
LARGE = 0.01
#: Records that one task settles, and sources whose rates may be broadcast; more are joined by a shuffle.
RECORDS_PER_TASK, BROADCAST_SOURCES = 20_000, 100_000

_EPS = 1e-9
_MASK = (1 << 64) - 1
_ROUNDED = "doc_id bigint, source string, n_tokens bigint, copies bigint, part_copy double, part int"


def _uniform(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) that depends on two records and the seed only, so that a repeated task repeats its choices."""
    z = (a * 0x9E3779B97F4A7C15 + b * 0xBF58476D1CE4E5B9 + seed * 0x94D049BB133111EB) & _MASK
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = ((z ^ (z >> shift)) * factor) & _MASK
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def pivot(open_one: tuple | None, other: tuple, seed: int) -> tuple[list[tuple[int, int]], tuple | None]:
    """Settle two unsettled records ``(id, size, share in (0, 1))`` against each other.

    Returns settled ``(id, extra copy)`` pairs and the record left unsettled, if any.
    """
    if open_one is None:
        return [], other
    (a, wa, xa), (b, wb, xb) = open_one, other
    up, down = min((1 - xa) * wa, xb * wb), min(xa * wa, (1 - xb) * wb)
    moved = up if _uniform(a, b, seed) * (up + down) < down else -down
    settled, left = [], None
    for doc, size, share in ((a, wa, xa + moved / wa), (b, wb, xb - moved / wb)):
        if share < _EPS or share > 1 - _EPS:
            settled.append((doc, int(share > 0.5)))
        else:
            left = (doc, size, share)
    return settled, left


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens``, written once; a null or empty text has 0 tokens."""
    bounded_batches(docs.sparkSession)

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": [count(t) if t else 0 for t in batch["text"]]})

    return materialise(spread(docs, "doc_id").select("doc_id", "source", "text").mapInPandas(tokenise, "doc_id bigint, source string, n_tokens bigint"), "tokens")


def rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: tokens at hand and wanted, expected copies of a record, and whether the share is reachable.

    Wanted are ``target_share`` times the tokens of all records of the targets' sources, each counted once.
    """
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    own = sized.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_records"))
    joined = t.join(own, "source", "left").na.fill(0, ["n_tokens", "n_records"])
    total = joined.agg(F.sum("n_tokens")).first()[0] or 0
    wanted = F.col("target_share") * F.lit(total)
    return joined.select(
        "source",
        "target_share",
        "max_repeats",
        "n_records",
        "n_tokens",
        wanted.alias("wanted_tokens"),
        ((F.col("n_records") > 0) & (F.col("n_tokens") * F.col("max_repeats") >= wanted)).alias("reachable"),
        F.when(F.col("n_tokens") > 0, F.least(wanted / F.col("n_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0).alias("rate"),
    )


def mix_sources(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix ``doc_id, source, n_tokens, copies`` and its report by source.

    The report has ``source, target_share, max_repeats, n_records, n_tokens, wanted_tokens, reachable, mixed_tokens,
    share_reached``; ``share_reached`` is of all mixed tokens. Records of null sources or of sources without target are not
    mixed; a source without records reaches 0. A record without tokens gets the whole part of its source's rate. Repeated
    rows are records of their own. Of repeated targets of a source the largest values count.
    """
    spark = docs.sparkSession
    sized = count_tokens(docs, vocabulary)
    plan = materialise(rates(sized, targets), "rates")
    rated = sized.join(small(plan.select("source", "rate", F.col("n_tokens").alias("pool")), BROADCAST_SOURCES), "source")
    is_large = F.col("n_tokens") >= LARGE * F.col("pool")

    def settle_large(rows: pd.DataFrame) -> pd.DataFrame:
        # A large record's counterpart is the mass of all smaller ones of its source, taken as one.
        rows = rows.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
        source, rate = rows["source"].iloc[0], float(rows["rate"].iloc[0])
        whole = int(np.floor(rate + _EPS))
        rest, share, out = int(rows["pool"].iloc[0]), rate - whole, []
        for doc, size in zip(rows["doc_id"], rows["n_tokens"]):
            rest -= size
            up, down = min((1 - share) * size, share * rest), min(share * size, (1 - share) * rest)
            extra = _uniform(int(doc), whole + 1, seed) * (up + down) < down
            moved = up if extra else -down
            if share < _EPS or abs(moved) + _EPS < (1 - share if extra else share) * size:
                break  # the smaller ones would be used up first: the rest settle record by record
            share -= moved / rest
            out.append((doc, source, size, whole + int(extra), None))
        unsettled = list(zip(rows["doc_id"], rows["n_tokens"]))[len(out) :]
        out += [(doc, source, size, -1, whole + share) for doc, size in unsettled]
        out.append((None, source, None, -2, whole + share))
        return pd.DataFrame(out, columns=["doc_id", "source", "n_tokens", "copies", "rate"]).astype({"doc_id": "Int64", "n_tokens": "Int64"})

    large = materialise(rated.where(is_large & (F.col("n_tokens") > 0)).groupBy("source").applyInPandas(settle_large, "doc_id bigint, source string, n_tokens bigint, copies bigint, rate double"), "large")
    shifted = large.where("copies = -2").select("source", F.col("rate").alias("shifted"))
    small_ones = rated.where(~is_large | (F.col("n_tokens") == 0)).join(small(shifted, BROADCAST_SOURCES), "source", "left").select("doc_id", "source", "n_tokens", F.coalesce("shifted", "rate").alias("rate"))
    rated = small_ones.unionByName(large.where("copies = -1").select("doc_id", "source", "n_tokens", "rate"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, open_ones, wholes = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            out = []
            for doc, source, size, rate in zip(batch["doc_id"], batch["source"], batch["n_tokens"], batch["rate"]):
                whole = int(np.floor(rate + _EPS))
                share = rate - whole
                if size == 0 or share < _EPS:
                    out.append((doc, source, size, whole, 0.0, part))
                    continue
                settled, left = pivot(open_ones.get(source), (doc, size, share), seed)
                sizes = wholes.pop(source, {}) | {doc: size}
                out += [(d, source, sizes[d], whole + extra, 0.0, part) for d, extra in settled]
                open_ones[source] = left
                if left:
                    wholes[source] = {left[0]: left[1]}
            yield pd.DataFrame(out, columns=["doc_id", "source", "n_tokens", "copies", "part_copy", "part"])
        out = [(one[0], source, one[1], -1, one[2], part) for source, one in open_ones.items() if one]
        yield pd.DataFrame(out, columns=["doc_id", "source", "n_tokens", "copies", "part_copy", "part"])

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
        sizes = dict(zip(rows["doc_id"], rows["n_tokens"]))
        source, part, out, left = rows["source"].iloc[0], int(rows["part"].iloc[0]), [], None
        for one in zip(rows["doc_id"], rows["n_tokens"], rows["part_copy"]):
            settled, left = pivot(left, one, seed + 1)
            out += [(d, source, sizes[d], extra, 0.0, part) for d, extra in settled]
        if left:
            out.append((left[0], source, left[1], -1, left[2], part))
        return pd.DataFrame(out, columns=["doc_id", "source", "n_tokens", "copies", "part_copy", "part"])

    # The largest first: a large record needs many small ones to settle against, and what is left at the end is small.
    # Which records meet depends on their ids and number alone, not on how the table was stored.
    tasks = max(1, -(-sized.count() // RECORDS_PER_TASK))
    ordered = rated.repartition(tasks, F.xxhash64("doc_id")).sortWithinPartitions(F.desc("n_tokens"), "doc_id")
    level = materialise(ordered.mapInPandas(settle, _ROUNDED), "settled")
    done = level.where("copies >= 0").select("doc_id", "source", "n_tokens", "copies").unionByName(large.where("copies >= 0").select("doc_id", "source", "n_tokens", "copies"))
    width = (level.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        width = -(-width // FAN_IN)
        level = level.where("copies < 0").withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        level = materialise(level.groupBy("source", "part").applyInPandas(reduce, _ROUNDED), "reduced")
        settled = level.where("copies >= 0")
        done = done.unionByName(_with_whole(settled, plan))
        if width == 1:
            break
    # One record per source is left with a fraction; it is rounded by its own chance.
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rest = level.where("copies < 0").withColumn("copies", (chance < F.col("part_copy")).cast("bigint"))
    done = done.unionByName(_with_whole(rest, plan))
    mixed = materialise(done, "mix")
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    report = plan.drop("rate").join(F.broadcast(reached), "source", "left").na.fill(0, ["mixed_tokens"])
    total = reached.agg(F.sum("mixed_tokens")).first()[0] or 0
    report = report.withColumn("share_reached", F.col("mixed_tokens") / F.lit(float(max(total, 1))))
    return mixed.where("copies > 0"), report


def _with_whole(settled: DataFrame, plan: DataFrame) -> DataFrame:
    """The records of the reduction tree with the whole part of their source's rate added."""
    whole = plan.select("source", F.floor(F.col("rate") + _EPS).alias("whole"))
    return settled.join(F.broadcast(whole), "source").select("doc_id", "source", "n_tokens", (F.col("copies") + F.col("whole")).alias("copies"))
