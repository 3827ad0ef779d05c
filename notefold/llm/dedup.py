"""Deduplication of new batches against all history, by incremental record linkage.

An item's blocking keys are the identities it names: a video by either of its ids, a page by its canonical address, where
short links have been followed. Each pair of an item and a key it names is scored against the key's first item by agreement
weights learned from the data; only a score of the threshold or more links them, so a key that two different sources came
to share does not join them.

The state is an append-only key table in the shared folder: per key its first item's fields, its parent in a union-find
forest and, at a root, the first accepted item. A link of a batch appends one segment of the rows it made or changed and
never rewrites another; readers take the youngest row of a key. A segment is cut into blocks by hash, their number grows
with its rows, and a batch reads only the blocks its keys fall into. Segments of like size are merged, so there are as many
as the logarithm of the history and each row is rewritten that often.

Work is per key, never per pair of items: a source named by any share of the rows is one key with a pre-aggregated minimum,
and the few keys with a large share of a batch meet their rows by broadcast, not in one task.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from notefold.session import materialise, shared_dir, small

#: Keys in a block of a segment, rows up to which a side table is broadcast, and the share of a batch's rows from which a
#: key is hot, so that there are at most 1 / ``HOT_SHARE`` of them.
BLOCK_KEYS, BROADCAST_ROWS, HOT_SHARE = 100_000, 200_000, 1e-3

# Query parameters that track a visit and select nothing, and the hosts' prefixes of one site's faces.
TRACKING = r"^(utm_\w+|spm\w*|share_\w+|vd_source|from|ref|referer|source_from|fbclid|gclid|msclkid|igshid|_ga|timestamp)$"
FACES = r"^(www|m|mobile|wap)\."

FULL_ASCII = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
HALF_ASCII = "".join(map(chr, range(0x21, 0x7F))) + " "
AROUND = " \t\n\x0b\f\r\"'"

VIDEO = r"(?i:bv)([0-9A-Za-z]{10})(?![0-9A-Za-z])"

#: Fields compared of a candidate and its key's first item: those that name a source, and those that describe it.
NAMING, DESCRIBING = ("bvid", "avid", "page"), ("title", "author", "mid")
FIELDS = NAMING + DESCRIBING

#: How often two different sources carry one identity by accident; the most that one describing field may count against.
ACCIDENT, MOST_AGAINST = 2.0**-20, 4.0

_ROW = "key string, seq int, root string, accepted bigint, first_item bigint, " + ", ".join(f"{f} bigint" for f in FIELDS)
LAST_BATCH = 2**31 - 1


def tidy(value: Column) -> Column:
    """Full-width ASCII narrowed; blanks, angle brackets and quotes around the value removed; null if nothing is left."""
    narrow = F.when(F.octet_length(value) == F.length(value), value).otherwise(F.translate(value, FULL_ASCII, HALF_ASCII))
    return F.nullif(F.rtrim(F.ltrim(narrow, F.lit(AROUND + "<")), F.lit(AROUND + ">")), F.lit(""))


def _short(value: Column) -> Column:
    """A value that is only ever compared, as its hash, which is what gets shuffled."""
    return F.when(value.isNotNull(), F.xxhash64(value))


def _selecting(query: Column) -> Column:
    """The parameters of a query string that select content, in order of name."""
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING))
    return F.when(query == "", "").otherwise(F.array_join(F.array_sort(kept), "&"))


def _divided(df: DataFrame, source: str, sign: str, left: str, right: str) -> DataFrame:
    """``source`` cut at the first ``sign`` into ``left`` and ``right`` without it; no sign leaves ``right`` empty."""
    at = F.instr(F.col(source), sign)
    return df.withColumns({left: F.when(at > 0, F.substring(source, F.lit(1), at - 1)).otherwise(F.col(source)), right: F.when(at > 0, F.substring(source, at + 1, F.length(source))).otherwise("")})


def with_page(df: DataFrame, url: str, into: str) -> DataFrame:
    """``df`` with the canonical address of the page that ``url`` names: without scheme, port, the site's face and whatever
    doesn't select content; null where there is none. Each part is worked out once, in a projection of its own."""
    kept = [c for c in df.columns if c != into]
    df = df.withColumn("_u", F.regexp_replace(tidy(F.col(url)), r"^(?i:https?:)?//", ""))
    df = _divided(df, "_u", "#", "_left", "_mark")
    df = _divided(df, "_left", "?", "_base", "_query")
    df = _divided(df, "_base", "/", "_host", "_path")
    df = _divided(df, "_mark", "?", "_route", "_asked")
    host = F.regexp_replace(F.regexp_replace(F.lower("_host"), r"(:(80|443))+$", ""), FACES, "")
    path = F.when(F.col("_path") == "", "").otherwise(F.concat(F.lit("/"), "_path"))
    escaped = F.when(path.contains("%"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(path)
    routed = F.col("_mark").startswith("/") | F.col("_mark").startswith("!/")
    df = df.withColumns(
        {
            "_host": host,
            "_path": F.rtrim(escaped, F.lit("/")),
            "_query": _selecting(F.col("_query")),
            "_route": F.when(routed, F.rtrim("_route", F.lit("/"))).otherwise(""),
            "_asked": F.when(routed, _selecting(F.col("_asked"))).otherwise(""),
        }
    )
    marked = lambda sign, part: F.when(F.col(part) == "", "").otherwise(F.concat(F.lit(sign), part))
    route = F.when((F.col("_route") == "") & (F.col("_asked") == ""), "").otherwise(F.concat(F.lit("#"), "_route", marked("?", "_asked")))
    return df.select(*kept, F.when(F.col("_host") != "", F.concat("_host", "_path", marked("?", "_query"), route)).alias(into))


def identities(items: DataFrame, short_links: DataFrame) -> DataFrame:
    """Items with their canonical ``bvid, avid, page``, the last only for addresses that name no video."""
    # Written before it is filtered: a filter pushed below the projections would put all their expressions into one.
    links = materialise(with_page(with_page(short_links.select("short_url", "target_url"), "short_url", "short"), "target_url", "target").select("short", "target"), "links")
    links = links.where("short is not null and target is not null").groupBy("short").agg(F.min("target").alias("target"))
    own = items.select(
        F.col("item_id").cast("bigint").alias("item_id"),
        F.coalesce(F.col("batch_no").cast("int"), F.lit(LAST_BATCH)).alias("batch_no"),
        (F.coalesce(F.col("status"), F.lit("")) == "converted").alias("accepted"),
        tidy(F.col("bvid")).alias("b"),
        tidy(F.col("avid")).alias("a"),
        F.col("source_url").alias("url"),
        *[_short(F.nullif(F.lower(F.trim(f)), F.lit(""))).alias(f) for f in DESCRIBING],
    )
    alone = F.concat(F.lit("-"), F.col("item_id").cast("string"))  # items without address must not meet in one task
    led = with_page(own, "url", "p").withColumn("short", F.coalesce("p", alone)).join(small(links, BROADCAST_ROWS), "short", "left").withColumn("p", F.coalesce("target", "p"))
    led = led.withColumn("in_path", F.when(F.col("p").contains("/video/") & F.col("p").rlike(r"/video/(?i:bv|av)"), F.col("p")))
    named = lambda c: F.nullif(F.regexp_extract(c, VIDEO, 1), F.lit(""))
    number = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    bvid = F.coalesce(named("b"), named("a"), named("in_path"))
    avid = F.coalesce(number("a", r"^(?i:av)?0*(\d+)$"), number("b", r"^(?i:av)0*(\d+)$"), number("in_path", r"/video/(?i:av)0*(\d+)"))
    return led.select("item_id", "batch_no", "accepted", bvid.alias("bvid"), avid.alias("avid"), F.when(F.col("in_path").isNull(), F.col("p")).alias("page"), *DESCRIBING)


def _keys(own: DataFrame) -> DataFrame:
    """One row per item and key; what is only compared becomes a hash."""
    keys = F.array_compact(F.array(F.concat(F.lit("b:"), "bvid"), F.concat(F.lit("a:"), "avid"), F.concat(F.lit("p:"), "page")))
    return own.select("item_id", "batch_no", F.col("accepted"), *[_short(F.col(f)).alias(f) if f in NAMING else F.col(f) for f in FIELDS], F.explode(keys).alias("key"))


def learn_weights(candidates: DataFrame, items: DataFrame, rounds: int = 30) -> dict[str, tuple[float, float]]:
    """Log2 weights of agreement and disagreement per field, by expectation maximisation over patterns of agreement.

    ``candidates`` has a column ``v_<field>`` (1 agrees, 0 differs, null unknown) per field. A describing field agrees by
    accident as often as two items drawn at random do, the sum of squared value shares over all ``items``; a naming one once
    in 2^20 (``ACCIDENT``), however often its sources return. A describing field counts at most ``MOST_AGAINST`` bits
    against a link, so all of them together can't outweigh an identity that no other identity contradicts. Only counts leave
    the cluster: at most 3^6 patterns, and two numbers per field.
    """
    patterns = candidates.groupBy(*[f"v_{f}" for f in FIELDS]).count().collect()
    long = items.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in DESCRIBING])).alias("x")).where("x.value is not null")
    shares = long.groupBy("x.field", "x.value").count().groupBy("field").agg(F.sum(F.col("count").cast("double") ** 2).alias("s"), F.sum("count").alias("n")).collect()
    chance = dict.fromkeys(NAMING, ACCIDENT) | dict.fromkeys(DESCRIBING, 1e-6) | {r["field"]: min(0.5, max(1e-9, r["s"] / r["n"] ** 2)) for r in shares}
    match, prior = dict.fromkeys(FIELDS, 0.9), 0.5
    for _ in range(rounds):
        sums, known, total, weight = dict.fromkeys(FIELDS, 0.0), dict.fromkeys(FIELDS, 0.0), 0, 0.0
        for p in patterns:
            odds = prior / (1 - prior)
            for f in FIELDS:
                v = p[f"v_{f}"]
                odds *= 1 if v is None else match[f] / chance[f] if v else (1 - match[f]) / (1 - chance[f])
            q = odds / (1 + odds) * p["count"]
            total, weight = total + p["count"], weight + q
            for f in FIELDS:
                if p[f"v_{f}"] is not None:
                    known[f] += q
                    sums[f] += q * p[f"v_{f}"]
        prior = min(0.999, max(0.001, weight / total)) if total else prior
        match = {f: min(0.9999, max(0.01, (sums[f] + 9.5) / (known[f] + 10))) for f in FIELDS}
    against = {f: math.log2((1 - match[f]) / (1 - chance[f])) for f in FIELDS}
    return {f: (math.log2(match[f] / chance[f]), max(-MOST_AGAINST, against[f]) if f in DESCRIBING else against[f]) for f in FIELDS}


def _is_star(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is a ``u``, so that ``v`` is the root of ``u`` already."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("key"), F.lit(1).alias("below")), F.struct(F.col("v").alias("key"), F.lit(0).alias("below")))).alias("x")).select("x.*")
    return not ends.groupBy("key").agg(F.sum("below").alias("ways"), F.min("below").alias("low")).where("ways > 1 or (ways = 1 and low = 0)").limit(1).count()


def _clusters(edges: DataFrame) -> DataFrame:
    """Connected components of ``u, v``: rows ``key, root`` with the smallest key as root, for every key in an edge.

    Large-star and small-star steps alternate, each written to the shared folder, until the edges form stars. Edges are
    between distinct keys, so a much named source adds one edge, not one per item.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    while not _is_star(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        star = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = materialise(star.select("u", F.col("m").alias("v")).unionByName(star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "star")
    roots = edges.select(F.col("v").alias("key")).distinct().withColumn("root", F.col("key"))
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(roots)


class History:
    """The persisted state. ``link(batch)`` adds a batch and gives its items, each new or a repeat of an earlier one.

    ``segments`` lists the key table's parts, the oldest first; ``costs`` what each link read and wrote, in rows. The
    list is written, beside the segments, as the last act of a link: a link that fails leaves the state as it was, and
    ``History(spark, path)`` in another process goes on from it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, block_keys: int = BLOCK_KEYS, threshold: float = 0.0):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
        self.block_keys, self.threshold = block_keys, threshold
        self.schema = StructType.fromDDL(_ROW)
        self.segments: list[dict] = []
        self.weights: dict[str, tuple[float, float]] | None = None
        self.seq = 0
        self.costs: list[dict] = []
        self._open()

    def _open(self) -> None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(root)) if not n.startswith(("_", "."))) if fs.exists(root) else []
        if done:
            kept = json.loads(self.spark.read.text(f"{self.path}/state/{done[-1]}").first()[0])
            self.segments, self.seq = [s | {"held": {int(b): n for b, n in s["held"].items()}} for s in kept["segments"]], kept["seq"]
            self.weights = {f: tuple(w) for f, w in kept["weights"].items()} if kept["weights"] else None

    def _close(self) -> None:
        path = lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/{name}")
        fs = path("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(path(f"_{self.seq:09d}"), True)
        out.write(bytearray(json.dumps({"segments": self.segments, "seq": self.seq, "weights": self.weights}).encode()))
        out.close()
        fs.rename(path(f"_{self.seq:09d}"), path(f"{self.seq:09d}"))

    def _blocks(self, segment: dict, blocks: list[int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{segment['path']}/block={b}" for b in blocks])

    def _probe(self, wanted: DataFrame, cost: dict) -> DataFrame:
        """The youngest row of each wanted ``key`` that is known, from the blocks that these keys fall into."""
        if not self.segments:
            return self.spark.createDataFrame([], self.schema)
        places = [F.struct(F.lit(i).alias("s"), F.pmod(F.xxhash64("key"), F.lit(s["blocks"])).cast("int").alias("b")) for i, s in enumerate(self.segments)]
        hit: dict[int, list[int]] = {}
        for r in wanted.select(F.explode(F.array(*places)).alias("x")).select("x.s", "x.b").distinct().collect():  # at most one per block
            if r["b"] in self.segments[r["s"]]["held"]:
                hit.setdefault(r["s"], []).append(r["b"])
        if not hit:
            return self.spark.createDataFrame([], self.schema)
        cost["blocks"] += sum(map(len, hit.values()))
        cost["rows_read"] += sum(self.segments[s]["held"][b] for s, blocks in hit.items() for b in blocks)
        rows = reduce(DataFrame.unionByName, [self._blocks(self.segments[s], sorted(blocks)) for s, blocks in sorted(hit.items())]).join(wanted.select("key"), "key", "left_semi")
        if len(hit) == 1:
            return rows.select(*self.schema.names)
        top = rows.groupBy("key").agg(F.max(F.struct(*self.schema.names[1:])).alias("x"))
        return top.select("key", *[F.col(f"x.{n}").alias(n) for n in self.schema.names[1:]])

    def _append(self, rows: DataFrame, most: int) -> dict | None:
        """Write a segment of at most ``most`` rows, one file a block; none if there are no rows."""
        blocks, path = max(1, -(-most // self.block_keys)), f"{self.path}/keys-{uuid.uuid4().hex}"
        placed = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        placed.repartition(min(blocks, max(8, self.spark.sparkContext.defaultParallelism * 4)), "block").write.option("compression", "zstd").partitionBy("block").parquet(path)
        held = {r["block"]: r["count"] for r in self.spark.read.schema(StructType.fromDDL(f"{_ROW}, block int")).parquet(path).groupBy("block").count().collect()}
        return {"path": path, "blocks": blocks, "rows": sum(held.values()), "held": held} if held else None

    def _merge(self, cost: dict) -> None:
        """Join the youngest segments while the last but one is not larger than the last: sizes at least double backwards."""
        take = 1
        while len(self.segments) > take and self.segments[-take - 1]["rows"] <= sum(s["rows"] for s in self.segments[-take:]):
            take += 1
        if take == 1:
            return
        rows = reduce(DataFrame.unionByName, [self._blocks(s, sorted(s["held"])) for s in self.segments[-take:]])
        top = rows.groupBy("key").agg(F.max(F.struct(*self.schema.names[1:])).alias("x")).select("key", *[F.col(f"x.{n}").alias(n) for n in self.schema.names[1:]])
        most = sum(s["rows"] for s in self.segments[-take:])
        cost["rows_merged"] += most
        self.segments[-take:] = [self._append(top, most)]

    def link(self, own: DataFrame) -> DataFrame:
        """Add a batch of ``identities``: ``item_id, batch_no, first_item_id, score`` of every item.

        ``first_item_id`` is the first accepted item of the source, null if the item is new; ``score`` is the best score of
        the item against the keys it is linked by, null where it is the first of them all. The result rests on evidence up
        to the item's own batch: where rows of several ``batch_no`` are given and a later one of them would change an earlier
        one's result, they are halved by ``batch_no`` and added in turn.
        """
        return reduce(DataFrame.unionByName, self._halves(own))

    def _halves(self, own: DataFrame) -> list[DataFrame]:
        done = self._step(own)
        if done is not None:
            return [done]
        low, high = own.agg(F.min("batch_no"), F.max("batch_no")).first()
        cut = (low + high) // 2
        return self._halves(own.where(F.col("batch_no") <= cut)) + self._halves(own.where(F.col("batch_no") > cut))

    def _step(self, own: DataFrame) -> DataFrame | None:
        cost = {"blocks": 0, "rows_read": 0, "rows_written": 0, "rows_merged": 0}
        keyed = _keys(own)
        best = lambda f: F.min_by(f, "item_id").alias(f)
        fresh = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"), *[best(f) for f in FIELDS]), "fresh")
        total, top, distinct = fresh.agg(F.sum("n"), F.max("n"), F.count("*")).first()
        if total is None:
            return own.select("item_id", "batch_no", F.lit(None).cast("bigint").alias("first_item_id"), F.lit(None).cast("double").alias("score"))
        hot = fresh.where(F.col("n") >= F.lit(total * HOT_SHARE)).select("key") if top >= max(2, total * HOT_SHARE) else None

        # What is known of the batch's keys, and of their parents up to the roots.
        found = known = materialise(self._probe(fresh.select("key"), cost), "known")
        while self.segments:
            ask = found.where("root <> key").select(F.col("root").alias("key")).distinct().join(known.select("key"), "key", "left_anti")
            if not ask.limit(1).count():
                break
            found = materialise(self._probe(ask, cost), "known")
            known = known.unionByName(found)

        # Score every item against the first item of each key it names.
        old = known.select("key", F.col("first_item").alias("o_first"), *[F.col(f).alias(f"o_{f}") for f in FIELDS])
        either = lambda f: F.when(F.col("o_first").isNull(), F.col(f)).otherwise(F.col(f"o_{f}")).alias(f"t_{f}")
        them = fresh.join(old, "key", "left").select("key", F.coalesce("o_first", "first_item").alias("t_first"), *[either(f) for f in FIELDS])
        agrees = lambda f: F.when(F.col(f).isNotNull() & F.col(f"t_{f}").isNotNull(), (F.col(f) == F.col(f"t_{f}")).cast("int")).alias(f"v_{f}")
        compared = self._meet(keyed, them, hot).select("item_id", "batch_no", "accepted", "key", "t_first", *[agrees(f) for f in FIELDS])
        if self.weights is None:
            self.weights = learn_weights(compared.where("item_id <> t_first"), own)
        score = reduce(lambda a, b: a + b, [F.when(F.col(f"v_{f}") == 1, F.lit(w)).when(F.col(f"v_{f}") == 0, F.lit(d)).otherwise(0.0) for f, (w, d) in self.weights.items()])
        scored = compared.withColumn("score", F.when(F.col("item_id") != F.col("t_first"), score))
        linked = materialise(scored.where(F.col("score").isNull() | (F.col("score") >= self.threshold)).select("item_id", "batch_no", "accepted", "key", "score"), "linked")

        # Union-find: an item joins the keys it is linked by; known keys hang on their parents already.
        joint = linked.groupBy("item_id").agg(F.min("key").alias("v"), F.collect_set("key").alias("all"), F.min("batch_no").alias("since")).where(F.size("all") > 1)
        made = materialise(joint.select(F.explode("all").alias("u"), "v", "since").where("u <> v").groupBy("u", "v").agg(F.min("since").alias("since")), "made")
        pointers = known.where("root <> key").select(F.col("key").alias("u"), F.col("root").alias("v"))
        clusters = _clusters(made.select("u", "v").unionByName(pointers) if self.segments else made.select("u", "v"))
        rooted = lambda df: df.join(clusters.select("key", F.col("root").alias("top")), "key", "left").withColumn("top", F.coalesce("top", "key"))
        taken = linked.where("accepted").groupBy("key").agg(F.min("item_id").alias("taken"))
        parents = known.select(F.col("key").alias("parent"), F.col("accepted").alias("p_accepted"))
        held = known.select("key", F.col("root").alias("parent"), F.col("accepted").alias("k_accepted")).join(parents, "parent", "left").select("key", F.least("k_accepted", "p_accepted").alias("before"))
        every = fresh.select("key").unionByName(known.select("key")).distinct().join(taken, "key", "left").join(held, "key", "left")
        every = rooted(every).withColumn("direct", F.least("taken", "before"))
        since = made.select(F.col("u").alias("key"), "since").join(clusters, "key").groupBy(F.col("root").alias("top")).agg(F.max("since").alias("since"))
        tops = every.groupBy("top").agg(F.min("direct").alias("whole")).join(since, "top", "left")
        places = materialise(every.join(tops, "top").select("key", "top", "direct", "whole", "since"), "places")

        earlier = lambda c: F.min(F.when(F.col(c) < F.col("item_id"), F.col(c)))
        met = self._meet(linked, places, hot).groupBy("item_id").agg(earlier("whole").alias("first_item_id"), earlier("direct").alias("direct"), F.max("since").alias("since"), F.max("score").alias("score"))
        result = materialise(own.select("item_id", "batch_no").distinct().join(met, "item_id", "left"), "result")
        late = result.agg(F.max((F.col("since") > F.col("batch_no")) & ~F.col("first_item_id").eqNullSafe(F.col("direct"))), F.min("batch_no") < F.max("batch_no")).first()
        if all(late):
            return None

        # Only rows that are new or changed are written.
        self.seq += 1
        mine = fresh.select("key", "first_item", *FIELDS).join(known.select("key"), "key", "left_anti")
        kept = known.select("key", F.col("root").alias("was"), F.col("accepted").alias("had"), "first_item", *FIELDS)
        rows = kept.unionByName(mine.select("key", F.lit(None).cast("string").alias("was"), F.lit(None).cast("bigint").alias("had"), "first_item", *FIELDS)).join(places.select("key", "top", "whole"), "key")
        changed = F.col("was").isNull() | (F.col("was") != F.col("top")) | ((F.col("key") == F.col("top")) & ~F.col("had").eqNullSafe(F.col("whole")))
        delta = rows.where(changed).select("key", F.lit(self.seq).alias("seq"), F.col("top").alias("root"), F.when(F.col("key") == F.col("top"), F.col("whole")).alias("accepted"), "first_item", *FIELDS)
        if segment := self._append(delta, distinct):
            cost["rows_written"] = segment["rows"]
            self.segments.append(segment)
            self._merge(cost)
        self.costs.append(cost)
        self._close()
        return result.select("item_id", "batch_no", "first_item_id", "score")

    @staticmethod
    def _meet(items: DataFrame, side: DataFrame, hot: DataFrame | None) -> DataFrame:
        """Join on ``key``, of which ``side`` has each once. Hot keys, at most 1 / ``HOT_SHARE``, meet their rows where they lie."""
        if hot is None:
            return items.join(side, "key")
        few = F.broadcast(side.join(F.broadcast(hot), "key", "left_semi"))
        return items.join(few, "key").unionByName(items.join(F.broadcast(hot), "key", "left_anti").join(side, "key"))


def split_batches(items: DataFrame, short_links: DataFrame, steps: int = 3, history: History | None = None) -> DataFrame:
    """Every item, new or repeat: ``item_id, batch_no, first_item_id, score``, as ``History.link`` gives them.

    A whole table is added in ``steps`` calls of whole batches, in order of ``batch_no``; the result is that of one call a
    batch. Every item of any status may repeat; only accepted ones (status ``converted``) can be repeated. Items that name
    no video and no address, nulls and blanks included, repeat nothing. Rows of equal ``item_id`` count as one item. A null
    ``batch_no`` counts as the last batch. An empty table gives no rows; other columns take no part.
    """
    own = materialise(identities(items, short_links), "identities")
    history = history or History(items.sparkSession)
    bounds = own.selectExpr(f"percentile_approx(batch_no, array({', '.join(str(i / steps) for i in range(1, steps + 1))}), 1000) as b").first()["b"] or []
    out, low = [], None
    for high in sorted(set(bounds)):
        part = own.where(F.col("batch_no") <= high)
        out.append(history.link(part if low is None else part.where(F.col("batch_no") > low)))
        low = high
    return reduce(DataFrame.unionByName, out) if out else own.select("item_id", "batch_no", F.lit(None).cast("bigint").alias("first_item_id"), F.lit(None).cast("double").alias("score"))


def link_items(items: DataFrame, short_links: DataFrame, steps: int = 3) -> DataFrame:
    """The repeats of ``split_batches``: ``first_item_id, item_id``."""
    return split_batches(items, short_links, steps).where("first_item_id is not null").select("first_item_id", "item_id")
