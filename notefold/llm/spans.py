"""Long exact spans shared between records.

Per shard, a compressed FM-index is built and written; texts are streamed through it by backward search, and the matching
statistics against other records, cut at the least length of interest, yield the shared intervals. Searching every text in every shard would grow as the square of
the corpus, so texts are first routed: of every window of the least length the smallest n-gram hash is kept (winnowing). A
shared span holds a whole window, hence an n-gram kept in both records; only n-grams kept in two records are followed, each
with the text around it that a span of the least length through it can reach, in the shard of its hash. Nothing is lost
this way, and that two texts share a span is told by the index alone.

Records of equal text (by length and SHA-256) form classes before all this; one per class goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notefold.llm.fmindex import FMIndex
from notefold.session import bounded_batches, materialise, small, spread

#: Code points of an n-gram, as a part of the least length; code points of a shard; code points hashed at once.
GRAM_PART, SHARD_SYMBOLS, CHUNK = 0.6, 1_000_000, 4_000_000

#: Rows up to which a table of record ids or hashes is broadcast; members of a set or class that one task pairs.
BROADCAST_ROWS, PAIR_MEMBERS = 500_000, 500

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` code points from each place on, by doubling."""
    level, width, power = _mix(codes.astype(np.uint64) + np.uint64(1)), 1, np.array([0x9E3779B97F4A7C15], np.uint64)
    n, done, out, parts = len(codes) - gram + 1, 0, None, gram
    while parts:
        if parts & 1:
            piece = level[done : done + n]
            out = piece.copy() if out is None else out * power + piece
            done += width
        parts >>= 1
        if parts:
            level = level[:-width] * power + level[width:]
            power, width = power * power, width * 2
    return _mix(out)


def winnow(texts: list[np.ndarray], gram: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, place, hash)`` of the n-grams kept: the smallest hash of each window of ``least`` code points, the leftmost
    of equals. Texts shorter than ``least`` keep none."""
    window = least - gram + 1
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.concatenate(texts)
    none = np.zeros(0, np.int64)
    if len(codes) < least:
        return none, none, none.astype(np.uint64)
    hashes = _gram_hashes(codes, gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    keyed = (hashes & ~np.uint64(0xFFFFFF)) | places  # CHUNK and a text's overlap stay below 2^24 places
    width = 1
    while width * 2 <= window:
        keyed = np.minimum(keyed[:-width], keyed[width:])
        width *= 2
    if window > width:
        keyed = np.minimum(keyed[: len(keyed) - (window - width)], keyed[window - width :])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(keyed)]
    inside = np.arange(len(keyed)) + least <= ends[owner]
    kept = np.unique((keyed[inside] & np.uint64(0xFFFFFF)).astype(np.int64))
    own = np.searchsorted(ends, kept, side="right")
    return own, kept - starts[own], hashes[kept]


def _segments(text: str, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """A text's code points, a very long one in stretches that overlap so that every window lies in one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, max(1, len(codes) - least + 1), CHUNK):
        yield at, codes[at : at + CHUNK + least - 1]


def _fingerprints(gram: int, least: int):
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pending, size = [], 0
            for doc, text in zip(batch["doc"], batch["text"]):
                for at, codes in _segments(text, least):
                    pending.append((doc, at, codes))
                    size += len(codes)
                    if size > CHUNK:
                        yield flush(pending)
                        pending, size = [], 0
            if pending:
                yield flush(pending)

    def flush(pending: list) -> pd.DataFrame:
        own, place, hashes = winnow([c for _, _, c in pending], gram, least)
        docs, ats = np.array([d for d, _, _ in pending], np.int64), np.array([a for _, a, _ in pending], np.int64)
        return pd.DataFrame({"h": hashes.view(np.int64), "doc": docs[own], "place": ats[own] + place})

    return keep


def _contexts(gram: int, least: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, marks in zip(batch["doc"], batch["text"], batch["marks"]):
                for m in marks:
                    start = max(0, m["place"] - (least - gram))
                    rows.append((m["h"], text[start : m["place"] + least], doc, start))
            yield pd.DataFrame(rows, columns=["h", "context", "doc", "at"])

    return cut


def _codes(texts: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(c.encode("utf-32-le", "surrogatepass"), np.uint32) for c in texts]


def _index(least: int):
    """applyInPandas function: the FM-index of a shard's contexts, in order of ``h, x``."""

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "x"], kind="stable")
        built = FMIndex.build(_codes(rows["context"]), rows["low"].to_numpy(), rows["high"].to_numpy(), least)
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "index": [built.dump()], "hs": [rows["h"].to_numpy()], "xs": [rows["x"].to_numpy()]})

    return index


_FOUND = {"kind": "int32", "set_id": "int64", "h": "int64", "x": "int64", "start": "int64", "end": "int64"}


def _search(least: int):
    """Cogrouped function: a shard's texts streamed through its index. Of kind 0 the stretches of each text that another
    record holds too; of kind 1 the distinct sets of texts that one span of the least length occurs in."""

    def search(streamed: pd.DataFrame, indexes: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: pd.Series([], dtype=t) for c, t in _FOUND.items()})]
        for _, shard, data, hs, xs in indexes[["shard", "index", "hs", "xs"]].itertuples() if len(streamed) else ():
            index = FMIndex.load(data)
            text, start, low, high = index.statistics(_codes(streamed["context"]))
            if not len(text):
                continue
            by = np.lexsort((start, text))  # following windows of a text are one stretch
            t, s = text[by], start[by]
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (s[1:] > s[:-1] + 1)))
            a, b = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(t)) - 1
            h, x = streamed["h"].to_numpy(), streamed["x"].to_numpy()
            out.append(pd.DataFrame({"kind": 0, "set_id": 0, "h": h[t[a]], "x": x[t[a]], "start": s[a], "end": s[b] + least}))
            # Occurrences are located per distinct interval; equal sets of texts count once.
            low, first = np.unique(low, return_index=True)
            sizes = high[first] - low
            group = np.repeat(np.arange(len(low)), sizes)
            member = index.text_of[np.repeat(low - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes) + np.arange(sizes.sum())]
            pairs = np.unique(np.stack((group, member), 1), axis=0)
            marks = _mix(pairs[:, 1].astype(np.uint64) + np.uint64(7))
            at = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] != pairs[:-1, 0])))
            counts = np.diff(np.append(at, len(pairs)))
            signs = np.stack((np.add.reduceat(marks, at), np.add.reduceat(_mix(marks), at), counts.astype(np.uint64)), 1)
            _, chosen = np.unique(signs, axis=0, return_index=True)
            members = pairs[np.isin(np.repeat(np.arange(len(at)), counts), chosen)]
            out.append(pd.DataFrame({"kind": 1, "set_id": members[:, 0] + (int(shard) << 32), "h": np.asarray(hs)[members[:, 1]], "x": np.asarray(xs)[members[:, 1]], "start": 0, "end": 0}))
        return pd.concat(out, ignore_index=True).astype(_FOUND)

    return search


def _paired(df: DataFrame, group: str, item: str) -> DataFrame:
    """``a, b`` of all items of one group with ``a < b``. A group of more than ``PAIR_MEMBERS`` is split over as many salts
    as it has times that many members: its left sides are spread over them, its right sides repeated."""
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") / PAIR_MEMBERS).cast("int").alias("salts"))
    sized = df.join(sizes, group)
    left = sized.select(group, F.pmod(F.hash(item), F.col("salts")).alias("salt"), F.col(item).alias("a"))
    right = sized.select(group, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col(item).alias("b"))
    return left.join(right, [group, "salt"]).where("a < b").select("a", "b")


class SharedSpans:
    """Shared spans of at least ``least`` code points among the rows ``id_col, text_col`` of ``docs``.

    ``copies``: ``doc_id, rep`` of all records in classes of equal text of two members or more (texts of ``least`` code
    points at least). ``spans()``: a row per maximal shared span of a record. ``amounts()``: a row per record. ``pairs()``:
    all pairs of records. Null texts and texts shorter than ``least`` share nothing. Ids must be unique; of rows with equal
    id and text one counts. Other columns are left out.
    """

    def __init__(self, docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text"):
        if least < 8:
            raise ValueError("the least length must be 8 or more")
        bounded_batches(docs.sparkSession)
        self.least, gram = least, max(4, int(least * GRAM_PART))
        self.docs = spread(docs, id_col).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where(F.length("text") >= least)
        keyed = self.docs.select("doc", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))
        classes = keyed.groupBy("digest", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("members")).where("members > 1").drop("members")
        self.copies = materialise(keyed.join(materialise(classes, "classes"), ["digest", "n"]).select(F.col("doc").alias("doc_id"), "rep").distinct(), "copies")
        repeats = small(self.copies.where("doc_id <> rep").select(F.col("doc_id").alias("doc")), BROADCAST_ROWS)
        self.singles = self.docs.join(repeats, "doc", "left_anti")
        kept = materialise(self.singles.mapInPandas(_fingerprints(gram, least), "h bigint, doc bigint, place bigint"), "grams")
        shared = materialise(kept.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("h"), "shared")
        marks = kept.join(small(shared, BROADCAST_ROWS), "h", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("h", "place")).alias("marks"))
        marks = small(materialise(marks, "marks"), BROADCAST_ROWS // 10)
        cut = self.singles.join(marks, "doc").select("doc", "text", "marks").mapInPandas(_contexts(gram, least), "h bigint, context string, doc bigint, at bigint")
        contexts = materialise(cut.withColumn("x", F.xxhash64("context")), "contexts")
        self.places = contexts.select("h", "x", "doc", "at")
        distinct = contexts.groupBy("h", "x").agg(F.first("context").alias("context"), F.min("doc").alias("low"), F.max("doc").alias("high"))
        distinct = materialise(distinct, "distinct")
        distinct = self._divided(distinct, SHARD_SYMBOLS // (2 * least))
        symbols = distinct.agg(F.sum(F.length("context") + 1)).first()[0] or 0
        # Shards of a bounded size; of a small table more of them, so that the cores have something to do.
        cores = docs.sparkSession.sparkContext.defaultParallelism
        shards = max(1, -(-symbols // SHARD_SYMBOLS), min(3 * cores, symbols // (SHARD_SYMBOLS // 8)))
        sharded = distinct.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
        self.index = materialise(sharded.groupBy("shard").applyInPandas(_index(least), "shard int, index binary, hs array<bigint>, xs array<bigint>"), "index")
        streamed = sharded.select("shard", "h", "x", "context").groupBy("shard").cogroup(self.index.groupBy("shard"))
        self.found = materialise(streamed.applyInPandas(_search(least), "kind int, set_id bigint, h bigint, x bigint, start bigint, end bigint"), "found")

    def _divided(self, distinct: DataFrame, most: int) -> DataFrame:
        hot = distinct.groupBy("h").count().where(F.col("count") > most)
        return self._divide(distinct, materialise(hot.select("h"), "hot")) if hot.limit(1).count() else distinct

    def _divide(self, distinct: DataFrame, hot: DataFrame) -> DataFrame:
        """Contexts of an n-gram with more of them than a shard takes are routed again by their single windows."""
        windows = F.transform(F.sequence(F.lit(0), F.length("context") - self.least), lambda i: F.struct(i.alias("at"), F.substring(F.col("context"), i + 1, F.lit(self.least)).alias("w")))
        cut = distinct.join(hot, "h", "left_semi").select(F.col("h").alias("h0"), F.col("x").alias("x0"), "low", "high", F.explode(windows).alias("p"))
        cut = materialise(cut.select("h0", "x0", "low", "high", F.xxhash64("p.w").alias("h"), F.xxhash64(F.lit("w"), "p.w").alias("x"), "p.w", F.col("p.at").alias("shift")), "windows")
        moved = cut.select("h", "x", "shift", F.col("h0"), F.col("x0"))
        again = self.places.join(moved, (F.col("h0") == self.places["h"]) & (F.col("x0") == self.places["x"])).select(moved["h"], moved["x"], "doc", (F.col("at") + F.col("shift")).alias("at"))
        self.places = self.places.join(hot, "h", "left_anti").unionByName(again)
        parts = cut.groupBy("h", "x").agg(F.first("w").alias("context"), F.min("low").alias("low"), F.max("high").alias("high"))
        return materialise(distinct.join(hot, "h", "left_anti").unionByName(parts), "divided")

    def spans(self) -> DataFrame:
        """``doc_id, start, end`` of maximal spans found in another record, of one record per class of copies."""
        at = self.found.where("kind = 0").join(self.places, ["h", "x"]).select("doc", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end")).distinct()
        before = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
        fresh = F.coalesce(F.col("start") > F.max("end").over(before) - self.least + 1, F.lit(True))
        upto = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
        islands = at.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(upto))
        return islands.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(F.col("doc").alias("doc_id"), "start", "end")

    def amounts(self) -> DataFrame:
        """``doc_id, rep, n_chars, shared_chars, shared_part`` of every record with a text of the least length; copies of a
        text are shared whole."""
        spans = self.spans()
        # Spans may overlap by less than the least length: what lies before a span's own start is counted once.
        before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
        ends = F.max("end").over(before)
        own = spans.withColumn("seen", F.coalesce(ends, F.lit(0))).groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).alias("shared_chars"))
        lengths = self.docs.select(F.col("doc").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"))
        every = lengths.join(self.copies, "doc_id", "left").join(own, "doc_id", "left")
        amount = F.when(F.col("rep").isNotNull(), F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0)))
        return every.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n_chars", amount.alias("shared_chars"), (amount / F.col("n_chars")).alias("shared_part"))

    def pairs(self) -> DataFrame:
        """``doc_id_a, doc_id_b`` of all pairs that share a span, copies included."""
        sets = materialise(self.found.where("kind = 1").join(self.places, ["h", "x"]).select("set_id", "doc").distinct(), "sets")
        reps = _paired(sets, "set_id", "doc").distinct()
        members = lambda c: self.copies.select(F.col("rep").alias(c), F.col("doc_id").alias(f"{c}_member"))
        wide = reps.join(members("a"), "a", "left").join(members("b"), "b", "left").select(F.coalesce("a_member", "a").alias("a"), F.coalesce("b_member", "b").alias("b"))
        alike = _paired(self.copies, "rep", "doc_id")
        return wide.unionByName(alike).select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))

