"""Queries over manifests, collections, transcripts and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notefold.functions import markdown as M
from notefold.functions import text as T
from notefold.operators import frames, manifest
from notefold.sources.files import cue_text, last_structured, scanned_entries
from notefold.session import spread, table

STATUSES = ["converted", "failed", "skipped"]


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "collection_entries")
    seconds = T.duration_seconds(F.col("duration"))
    return c.select("collection_id", "avid", "bvid", "duration", seconds.alias("seconds"), T.duration_text(seconds.cast("string")).alias("text"), T.clock_text(seconds).alias("clock"))


def published_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "collection_entries")
    return c.select("collection_id", "avid", T.iso_seconds(F.col("pubtime")).alias("at"), T.unset_or_positive(F.col("pubtime")).alias("coerced"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "manifest_items").where("source_url is not null")
    u = F.col("source_url")
    return m.select("item_id", T.video_id(u).alias("video"), T.part_number(u).alias("part"), T.is_remote(u).alias("is_remote"), T.https(u).alias("https"))


def new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection entries of which no note is known by either id."""
    n, c = table(spark, sf_dir, "notes"), table(spark, sf_dir, "collection_entries")
    in_name, in_avid = manifest.known_ids(n)
    bvid = in_name.unionByName(n.select("bvid")).where("bvid <> ''")
    avid = in_avid.unionByName(n.select("avid")).where("avid <> ''")
    return manifest.not_known(c, {"bvid": bvid, "avid": avid}).select("collection_type", "collection_id", "avid", "bvid", "title")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, sf_dir, "manifest_items").select("item_id", "batch_no", "source_path", "source_url", "output_path", "status", "title")
    return m.where("batch_no % 2 = 0").drop("batch_no"), m.where("batch_no % 2 = 1").drop("batch_no")


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd batches merged into even ones by path or address."""
    old, new = _halves(spark, sf_dir)
    return manifest.upsert_any(old, new, ["source_path", "source_url"], "item_id")


def manifest_upsert_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by path, address or output."""
    old, new = _halves(spark, sf_dir)
    return manifest.upsert_any(old, new, ["source_url", "source_path", "output_path"], "item_id")


def manifest_upsert_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest item per address and status of the odd batches merged into those of the even ones."""
    old, new = (manifest.latest(h.select("source_url", "status", "title", "item_id"), ["source_url", "status"], "item_id") for h in _halves(spark, sf_dir))
    return manifest.upsert_all(old, new, ["source_url", "status"])


def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "manifest_items")
    return manifest.status_rollup(m, "source_type", F.col("status"), STATUSES)


def manifest_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten batches of which the most items failed; ``manifest_attention_all`` has every batch."""
    m = table(spark, sf_dir, "manifest_items").groupBy("batch_no").agg(F.count_if(F.col("status") == "failed").alias("attention"), F.count("*").alias("items"))
    return m.orderBy(F.desc("attention"), F.asc("batch_no")).limit(10)


def manifest_attention_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches by how many of their items failed or have to be built again, the most first."""
    m = table(spark, sf_dir, "manifest_items").groupBy("batch_no").agg(F.count_if(F.col("status").isin("failed", "rebuild")).alias("attention"), F.count("*").alias("items"))
    return m.orderBy(F.desc("attention"), F.asc_nulls_last("batch_no"))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "manifest_items")
    return m.groupBy("batch_no").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.sum(F.coalesce(F.length("error"), F.lit(0))).alias("error_signs"),
        (F.max("loaded_at") - F.min("converted_at") > F.expr("interval 1 day")).alias("is_late"),
    )


def not_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are in the manifest but were never converted."""
    m = table(spark, sf_dir, "manifest_items").where("source_path is not null")
    return manifest.not_done(m.select("source_path").distinct(), m.where("status = 'converted'"), "source_path")


def best_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per address the best note: with original text, with prefix in its name, saved last."""
    n = table(spark, sf_dir, "notes").where("source_url is not null and source_url <> ''")
    has = F.coalesce(F.col("body").rlike(rf"{M.LINE}##\s+原文抽取\s*(?:\n|\z)"), F.lit(False))
    named = F.coalesce(F.substring_index("path", "/", -1).rlike("^[A-Z]+-"), F.lit(False))
    rank = F.struct(has, named, F.col("saved_at"), F.col("note_id"))
    return n.groupBy("source_url").agg(F.max_by("note_id", rank).alias("note_id"), F.count("*").alias("candidates"))


def drafts_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organised notes joined with the last draft of their address."""
    n = table(spark, sf_dir, "notes").where("source_url <> ''")
    drafts = manifest.latest(n.where("status = 'draft'").select("source_url", F.col("note_id").alias("draft_id")), ["source_url"], "draft_id")
    return n.where("status = 'organized'").select("note_id", "source_url").join(drafts, "source_url", "left")


def drafts_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items not organised whose address has an organised item."""
    i = table(spark, sf_dir, "manifest_items").where("source_url <> ''")
    done = i.where("organized_status = 'organized'").select("source_url").distinct()
    return i.where("coalesce(organized_status, '') <> 'organized'").join(done, "source_url", "left_semi").select("item_id", "source_url")


def transcript_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "transcripts")
    return t.groupBy(F.lower(F.trim(F.coalesce("transcript_source", F.lit("")))).alias("source")).agg(F.count("*").alias("transcripts")).orderBy(F.desc("transcripts"), "source")


def chosen_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per note the transcript of the best language, subtitles before recognition, then the first."""
    t = table(spark, sf_dir, "transcripts").where("note_id is not null")
    rank = F.coalesce(F.nullif(F.array_position(F.array(F.lit("zh"), F.lit("en")), F.col("lang")), F.lit(0)), F.lit(9))
    recognised = F.lower(F.coalesce("transcript_source", F.lit(""))).rlike("asr|whisper")
    return t.groupBy("note_id").agg(F.min_by("transcript_id", F.struct(rank, recognised, F.col("transcript_id"))).alias("transcript_id"))


def cue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken lines of transcripts kept as numbered subtitles."""
    t = table(spark, sf_dir, "transcripts").where("transcript_text like '%-->%'")
    lines = cue_text(F.split(F.regexp_replace("transcript_text", "\r\n?", "\n"), "\n"))
    return t.select("transcript_id", F.size(lines).alias("lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("text_hash"))


def scanner_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as a scanner's listing and read back."""
    c = table(spark, sf_dir, "collection_entries")
    line = lambda mark, name, col: F.concat(F.lit(f"{mark}{name}:"), F.coalesce(F.regexp_replace(col, "[\r\n]+", " "), F.lit("")), F.lit("\n"))
    text = F.concat(line("  - ", "AVID", "avid"), line("    ", "BVID", "bvid"), line("    ", "TITLE", "title"))
    read = c.select("collection_id", F.element_at(scanned_entries(text), 1).alias("e"))
    return read.select("collection_id", F.col("e")["avid"].alias("avid"), F.col("e")["bvid"].alias("bvid"), F.col("e")["title"].alias("title"))


def last_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last structured line of each user's log."""
    e = table(spark, sf_dir, "events")
    lines = e.select("user_id", "event_id", F.concat(F.lit("RESULT_JSON:"), "props").alias("value"))
    return last_structured(lines, "RESULT_JSON:", "event_id", ["user_id"], "k string").select("user_id", F.col("result.k").alias("k"))


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, of those the hundred most recent, the history's length."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return manifest.bounded_history(e, "user_id", "event_id", 100)


def merged_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of an event over defaults, one key left out."""
    e = table(spark, sf_dir, "events")
    own = F.from_json("props", "map<string,string>")
    both = T.merged(F.create_map(F.lit("k"), F.lit("0"), F.lit("mode"), F.lit("full"), F.lit("token"), F.lit("x")), own)
    kept = F.map_filter(both, lambda k, v: k != "token")
    return e.select("event_id", F.size(kept).alias("n"), F.element_at(kept, "k").alias("k"), F.element_at(kept, "mode").alias("mode"))


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that changed between two snapshots."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return manifest.changed(o.where("o_orderkey % 5 <> 0"), after, "o_orderkey", ["o_orderstatus", "o_totalprice"])


def grid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region as a Markdown table."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return j.groupBy("r_name").agg(M.table(F.concat(F.array(F.array(F.lit("key"), F.lit("name|"))), rows)).alias("markdown"))


def sheet_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", T.sheet_column(F.substring("n_name", 1, 2)).alias("at"), T.human_bytes(F.pow(F.lit(7.0), F.col("n_nationkey") % 12)).alias("size"))


def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(frames.mean_of(F.col("embedding")), 6).alias("mean"), F.round(frames.deviation_of(F.col("embedding")), 6).alias("deviation"))


def frames_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable vectors unlike each other within a recording, for which a label's run of a hundred ids stands; frames of different
    recordings are never compared."""
    e = table(spark, sf_dir, "embeddings").withColumn("stretch", F.floor(F.col("vec_id") / 100))
    listed = F.array_sort(F.collect_list(F.struct(F.col("vec_id").cast("double").alias("t"), F.col("embedding").alias("f"))))
    chosen = e.groupBy("label", "stretch").agg(frames.usable_frames(listed, 5, 64, -1.0, 1.0, 0.01, 0.05, 1.0).alias("times"))
    return chosen.select("label", "stretch", F.explode("times").alias("vec_id")).withColumn("vec_id", F.col("vec_id").cast("bigint"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-scored blocks of each document with the heading above."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id").where("text is not null")
    points = d.select("doc_id", frames.scored_blocks(F.col("text")).alias("p"), F.size(M.blocks(frames.visible_part(F.col("text")))).alias("n"))
    best = points.select("doc_id", F.explode(frames.spaced_best(F.col("p"), F.col("n"), 5)).alias("p"))
    return best.select("doc_id", "p.idx", F.round("p.score", 4).alias("score"), "p.heading")


def thinned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day, events at least a minute apart, 15 at most, and the nearest to noon."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    second = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")
    times = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(second)).alias("all"))
    return times.select("user_id", "day", F.size(frames.thinned(F.col("all"), 60.0, 15)).alias("kept"), frames.nearest(F.lit(43200.0), F.col("all"), F.lit(7200.0)).alias("noon"))


def running_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the largest gap between events in seconds."""
    e = table(spark, sf_dir, "events")
    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.timestamp_diff("SECOND", last, F.col("ts"))
    return e.withColumn("gap", gap).groupBy("user_id").agg(F.max("gap").alias("largest_gap"), F.count("*").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        durations, published_iso, url_parts, new_entries, manifest_upsert, manifest_upsert_three, manifest_upsert_keyed, manifest_status, manifest_attention, manifest_attention_all,
        batch_summary, not_converted, best_output, drafts_backfilled, drafts_archived, transcript_sources, chosen_transcripts, cue_lines, scanner_entries,
        last_results, recent_history, merged_options, snapshot_changes, grid_table, sheet_columns, frame_stats, frames_chosen, moments, thinned_times, running_jumps,
    )
}

W = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_N = "coalesce(TRY_CAST(nullif(regexp_extract(duration, '{p}', {i}), '') AS BIGINT), 0)"
_WORDS, _CLOCK = rf"^{W}*(?:(\d+)\s*小时)?\s*(?:(\d+)\s*分钟?)?\s*(?:(\d+)\s*秒)?{W}*$", rf"^{W}*(?:(\d+):)?(\d{{1,3}}):(\d{{2}}){W}*$"
_T = lambda p: " + ".join(f"{_N.format(p=p, i=i)} * {m}" for i, m in ((1, 3600), (2, 60), (3, 1)))
_STRIP = lambda x: rf"regexp_replace({x}, '^{W}+|{W}+\z', '', 'g')"
_SECONDS = rf"""CASE WHEN {_STRIP('duration')} = '' THEN NULL WHEN regexp_matches(duration, '{_WORDS}') THEN {_T(_WORDS)} WHEN regexp_matches(duration, '{_CLOCK}') THEN {_T(_CLOCK)}
    ELSE CAST(floor(TRY_CAST({_STRIP('duration')} AS DOUBLE) + 0.5) AS BIGINT) END"""


def _upsert_sql(keys: list[str]) -> str:
    links = " UNION ALL ".join(f"SELECT n.item_id AS n, o.o FROM new n JOIN (SELECT {k} AS k, min(item_id) AS o FROM old WHERE {k} <> '' GROUP BY {k}) o ON n.{k} = o.k" for k in keys)
    cols = ["source_path", "source_url", "output_path", "status", "title"]
    return f"""WITH m AS (SELECT item_id, batch_no, source_path, source_url, output_path, status, title FROM manifest_items), old AS (SELECT * FROM m WHERE batch_no % 2 = 0), new AS (SELECT * FROM m WHERE batch_no % 2 = 1),
        matched AS (SELECT n, min(o) AS o FROM ({links}) GROUP BY n), winner AS (SELECT o, max(n) AS n FROM matched GROUP BY o)
        SELECT old.item_id, {', '.join(f'coalesce(u.{c}, old.{c}) AS {c}' for c in cols)} FROM old LEFT JOIN (SELECT w.o, new.* FROM winner w JOIN new ON new.item_id = w.n) u ON u.o = old.item_id
        UNION ALL SELECT item_id, {', '.join(cols)} FROM new WHERE item_id NOT IN (SELECT n FROM matched)"""


SQL = {
    "durations": f"""SELECT collection_id, avid, bvid, duration, s AS seconds, coalesce(CASE WHEN s >= 3600 THEN (s // 3600) || '小时' ELSE '' END || ((s // 60) % 60) || '分' || (s % 60) || '秒', '') AS text,
        CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) ELSE printf('%02d:%02d', (s // 60) % 60, s % 60) END AS clock FROM (SELECT *, {_SECONDS} AS s FROM collection_entries)""",
    "published_iso": f"""SELECT collection_id, avid, coalesce(strftime(make_timestamp(TRY_CAST(pubtime AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S'), '') AS at,
        CASE WHEN {_STRIP("coalesce(pubtime, '')")} = '' THEN -1 ELSE greatest(0, coalesce(TRY_CAST({_STRIP('pubtime')} AS INTEGER), 0)) END AS coerced FROM collection_entries""",
    "url_parts": r"""SELECT item_id, nullif(regexp_extract(source_url, '(?:^|[^0-9A-Za-z])(BV[0-9A-Za-z]+)', 1), '') AS video, greatest(1, coalesce(TRY_CAST(nullif(regexp_extract(source_url, '[?&]p=(\d+)', 1), '') AS INTEGER), 1)) AS part,
        regexp_matches(source_url, '^(?i:https?://)') AS is_remote, CASE WHEN starts_with(source_url, '//') THEN 'https:' || source_url WHEN starts_with(source_url, 'http://') THEN 'https://' || substring(source_url, 8) ELSE source_url END AS https
        FROM manifest_items WHERE source_url IS NOT NULL""",
    "new_entries": r"""WITH s AS (SELECT regexp_extract(regexp_replace(path, '\.[^./]*$', ''), '[^_]*$') AS k FROM notes),
        b AS (SELECT k AS x FROM s WHERE starts_with(k, 'BV') UNION SELECT unnest(regexp_extract_all(substring(body, 1, 4096), 'BV[0-9A-Za-z]{10}')) FROM notes UNION SELECT bvid FROM notes WHERE bvid <> ''),
        a AS (SELECT k AS x FROM s WHERE regexp_matches(k, '^[0-9]+$') UNION SELECT avid FROM notes WHERE avid <> '')
        SELECT collection_type, collection_id, avid, bvid, title FROM collection_entries c WHERE NOT EXISTS (SELECT 1 FROM b WHERE x = c.bvid) AND NOT EXISTS (SELECT 1 FROM a WHERE x = c.avid)""",
    "manifest_upsert": _upsert_sql(["source_path", "source_url"]),
    "manifest_upsert_three": _upsert_sql(["source_url", "source_path", "output_path"]),
    "manifest_upsert_keyed": """WITH l AS (SELECT batch_no % 2 AS h, source_url, status, arg_max(title, item_id) FILTER (true) AS t, max(item_id) AS item_id FROM manifest_items GROUP BY 1, 2, 3),
        x AS (SELECT l.h, l.source_url, l.status, m.title, l.item_id FROM l JOIN manifest_items m USING (item_id)), o AS (SELECT * FROM x WHERE h = 0), n AS (SELECT * FROM x WHERE h = 1)
        SELECT coalesce(n.source_url, o.source_url) AS source_url, coalesce(n.status, o.status) AS status, coalesce(n.title, o.title) AS title, coalesce(n.item_id, o.item_id) AS item_id
        FROM o FULL JOIN n ON o.source_url IS NOT DISTINCT FROM n.source_url AND o.status IS NOT DISTINCT FROM n.status""",
    "manifest_status": """SELECT source_type, grouping(source_type) = 1 AS is_total, count(*) AS items, count(*) FILTER (status = 'converted') AS converted, count(*) FILTER (status = 'failed') AS failed,
        count(*) FILTER (status = 'skipped') AS skipped FROM manifest_items GROUP BY ROLLUP (source_type)""",
    "manifest_attention": "SELECT batch_no, count(*) FILTER (status = 'failed') AS attention, count(*) AS items FROM manifest_items GROUP BY batch_no ORDER BY attention DESC, batch_no LIMIT 10",
    "manifest_attention_all": "SELECT batch_no, count(*) FILTER (status IN ('failed', 'rebuild')) AS attention, count(*) AS items FROM manifest_items GROUP BY batch_no ORDER BY attention DESC, batch_no",
    "batch_summary": """SELECT batch_no, count(*) AS total, count(*) FILTER (status = 'converted') AS converted, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
        sum(coalesce(length(error), 0)) AS error_signs, max(loaded_at) - min(converted_at) > INTERVAL 1 DAY AS is_late FROM manifest_items GROUP BY batch_no""",
    "not_converted": "SELECT DISTINCT source_path FROM manifest_items WHERE source_path IS NOT NULL AND source_path NOT IN (SELECT source_path FROM manifest_items WHERE status = 'converted' AND source_path IS NOT NULL)",
    "best_output": rf"""SELECT source_url, note_id, candidates FROM (SELECT source_url, note_id, count(*) OVER (PARTITION BY source_url) AS candidates, row_number() OVER (PARTITION BY source_url ORDER BY
        coalesce(regexp_matches(body, '(?:^|\n)##\s+原文抽取\s*(?:\n|\z)'), false) DESC, coalesce(regexp_matches(regexp_extract(path, '[^/]*$'), '^[A-Z]+-'), false) DESC, saved_at DESC NULLS LAST, note_id DESC) AS r
        FROM notes WHERE source_url <> '') WHERE r = 1""",
    "drafts_backfilled": """SELECT o.note_id, o.source_url, d.draft_id FROM notes o LEFT JOIN (SELECT source_url, max(note_id) AS draft_id FROM notes WHERE status = 'draft' AND source_url <> '' GROUP BY source_url) d
        ON o.source_url = d.source_url WHERE o.status = 'organized' AND o.source_url <> ''""",
    "frames_chosen": """WITH RECURSIVE f AS (SELECT label, CAST(floor(vec_id / 100) AS BIGINT) AS stretch, list(CAST(vec_id AS DOUBLE) ORDER BY vec_id) AS t, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS v FROM embeddings GROUP BY ALL),
        c AS (SELECT *, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS kept FROM f UNION ALL SELECT label, stretch, t, v, nxt, list_append(kept, nxt) FROM (
            SELECT *, list_min(list_filter(range(pos + 1, len(t) + 1), lambda i: (pos = 0 OR t[i] - t[pos] >= 1) AND len(v[i]) = 64 AND list_avg(v[i]) BETWEEN -1 AND 1 AND list_stddev_pop(v[i]) >= 0.01
                AND len(list_filter(kept, lambda k: list_avg(list_transform(v[i], lambda x, d: abs(x - v[k][d]))) < 0.05)) = 0)) AS nxt FROM c WHERE len(kept) < 5) WHERE nxt IS NOT NULL)
        SELECT label, stretch, CAST(t[pos] AS BIGINT) AS vec_id FROM c WHERE pos > 0""",
    "thinned_times": """WITH RECURSIVE g AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE))) AS l FROM events GROUP BY ALL),
        k AS (SELECT *, l[1] AS s, 1 AS n FROM g UNION ALL SELECT user_id, day, l, list_min(list_filter(l, lambda x: x >= s + 60)), n + 1 FROM k WHERE n < 15 AND list_max(l) >= s + 60)
        SELECT user_id, day, max(n) AS kept, any_value(round(CASE WHEN list_min(list_transform(l, lambda x: abs(x - 43200))) <= 7200
            THEN list_filter(l, lambda x: abs(x - 43200) = list_min(list_transform(l, lambda y: abs(y - 43200))))[1] ELSE 43200 END, 2)) AS noon FROM k GROUP BY user_id, day""",
    "drafts_archived": "SELECT item_id, source_url FROM manifest_items WHERE coalesce(organized_status, '') <> 'organized' AND source_url <> '' AND source_url IN (SELECT source_url FROM manifest_items WHERE organized_status = 'organized')",
    "transcript_sources": "SELECT lower(trim(coalesce(transcript_source, ''))) AS source, count(*) AS transcripts FROM transcripts GROUP BY 1",
    "chosen_transcripts": """SELECT note_id, transcript_id FROM transcripts WHERE note_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY CASE lang WHEN 'zh' THEN 1 WHEN 'en' THEN 2 ELSE 9 END,
        regexp_matches(lower(coalesce(transcript_source, '')), 'asr|whisper'), transcript_id) = 1""",
    "cue_lines": rf"""SELECT transcript_id, len(l) AS lines, sha256(array_to_string(l, chr(10))) AS text_hash FROM (SELECT transcript_id, list_filter(list_transform(string_split(regexp_replace(transcript_text, '\r\n?', chr(10), 'g'), chr(10)),
        lambda x: {_STRIP('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^\d+$') AND NOT contains(x, '-->')) AS l FROM transcripts WHERE transcript_text LIKE '%-->%')""",
    "scanner_entries": rf"""SELECT collection_id, {_STRIP("coalesce(avid, '')")} AS avid, {_STRIP("coalesce(bvid, '')")} AS bvid, {_STRIP(r"regexp_replace(coalesce(title, ''), '[\r\n]+', ' ', 'g')")} AS title FROM collection_entries""",
    "last_results": "SELECT user_id, json_extract_string(arg_max(props, event_id), '$.k') AS k FROM events GROUP BY user_id",
    "recent_history": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id ORDER BY 2 DESC LIMIT 100",
    "merged_options": "SELECT event_id, 2 AS n, coalesce(json_extract_string(props, '$.k'), '0') AS k, 'full' AS mode FROM events",
    "snapshot_changes": """WITH a AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders)
        SELECT a.* FROM a LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) o ON o.o_orderkey = a.o_orderkey
        WHERE o.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM a.o_orderstatus OR o.o_totalprice IS DISTINCT FROM a.o_totalprice""",
    "grid_table": r"""SELECT r_name, '| key | name\| |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\|') || ' |', chr(10) ORDER BY n_nationkey) AS markdown
        FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "sheet_columns": """SELECT n_nationkey, (ascii(substring(upper(n_name), 1, 1)) - 64) * 26 + ascii(substring(upper(n_name), 2, 1)) - 64 - 1 AS at,
        CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f KB', b / 1024) END AS size FROM (SELECT *, pow(7.0, n_nationkey % 12) AS b FROM nation)""",
    "frame_stats": "SELECT vec_id, round(list_avg(CAST(embedding AS DOUBLE[])), 6) AS mean, round(list_stddev_pop(CAST(embedding AS DOUBLE[])), 6) AS deviation FROM embeddings",
    "running_jumps": """SELECT user_id, max(g) AS largest_gap, count(*) AS events FROM (SELECT user_id, CAST(floor(epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS g FROM events) GROUP BY user_id""",
}
