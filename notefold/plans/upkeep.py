"""Queries of upkeep: normalised notes, lookups, views, recovery, and what is written and read back; with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notefold.functions import markdown as M
from notefold.functions import records as R
from notefold.functions import text as T
from notefold.operators import upkeep as U
from notefold.plans import notes as N
from notefold.session import shared_dir, table
from notefold.sources import files, sinks

#: Origins of a transcript in order of preference, as patterns of their labels.
CHAIN = [("网页|CC", "web"), ("(?i)ai字幕", "machine"), ("(?i)srt", "file"), ("(?i)asr|whisper", "recogniser")]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def notes_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note with its lacking fields set, and whether that changed it."""
    n = U.normalised(table(spark, sf_dir, "notes"), N.TODAY)
    return n.select("note_id", "title", "source_type", "note_type", "created", F.array_join("tags", ",").alias("tags"), "source_hash", "was_changed")


def drafts_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item that names a path as its output or as its source."""
    items = table(spark, sf_dir, "manifest_items")
    paths = items.select(F.col("output_path").alias("path")).unionByName(items.select(F.col("source_path").alias("path"))).where("path is not null")
    return U.looked_up(paths, items.select("item_id", "output_path", "source_path"), "path", ["output_path", "source_path"], "item_id")


def notes_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organised notes that need nothing more, ``webpage`` notes only with their original section."""
    n = table(spark, sf_dir, "notes")
    kind = F.when(F.col("source_type") == "webpage", "opus").otherwise(F.coalesce("source_type", F.lit("")))
    return n.where(U.organised_complete(F.col("status"), kind, F.col("body"))).select("note_id")


def attention_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that call for attention."""
    i = table(spark, sf_dir, "manifest_items")
    return U.viewed(i, F.coalesce("manual_status", "status"), "attention").select("item_id", "batch_no")


def state_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of exactly one state, without one entry."""
    i = table(spark, sf_dir, "manifest_items").withColumn("id", F.col("item_id").cast("string"))
    return U.without_entry(U.viewed(i, F.col("status"), "skipped"), "id", "17").select("item_id")


def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much lies in every folder of notes, with all below it."""
    return U.folder_sizes(table(spark, sf_dir, "notes"), "path", F.length(F.coalesce("body", F.lit(""))))


def newest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of each machine from the newest on."""
    place = F.row_number().over(Window.partitionBy("machine").orderBy(F.desc("saved_at"), "path", "note_id"))
    return table(spark, sf_dir, "notes").select("note_id", place.alias("place"))


def source_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of notes and items, repeated ones as often as they stand there."""
    both = [table(spark, sf_dir, name).select("source_path").where("source_path is not null") for name in ("notes", "manifest_items")]
    return both[0].unionByName(both[1])


def sources_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line and rest of every transcript."""
    t = table(spark, sf_dir, "transcripts").where("transcript_text is not null").withColumn("x", U.split_source(F.col("transcript_text")))
    return t.select("transcript_id", F.sha2("x.source", 256).alias("source_hash"), F.length("x.text").alias("size"))


def transcripts_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note's transcript by preference of origin."""
    t = table(spark, sf_dir, "transcripts").where("note_id is not null")
    return U.transcript_chain(t, "note_id", "transcript_source", "transcript_text", CHAIN, "transcript_id")


def pdf_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "notes")
    title = F.when(F.col("note_id") % 5 == 0, "Untitled").when(F.col("note_id") % 7 == 0, " ").otherwise(F.col("title"))
    return n.select("note_id", U.pdf_title(title).alias("title"))


def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's name from its two spellings in JSON."""
    n = table(spark, sf_dir, "notes").where("model is not null")
    raw = F.when(F.col("note_id") % 2 == 0, F.to_json(F.struct(F.col("model").alias("identifier")))).otherwise(F.concat(F.lit('"'), "model", F.lit('"')))
    return n.select("note_id", U.model_label(raw).alias("label"))


def titles_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "notes").where("title is not null")
    return n.select("note_id", U.escaped(F.concat(F.lit("<b>\"'&"), "title")).alias("escaped"), U.output_name(F.when(F.col("note_id") % 3 == 0, F.concat(F.lit("a/"), "title")).otherwise(F.col("title"))).alias("file_name"))


def assets_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under which the linked files of each note would be stored."""
    n = table(spark, sf_dir, "notes").where("body is not null")
    return U.asset_names(n.select("note_id", F.posexplode(M.links(F.col("body"))).alias("at", "target")), "note_id", "at", "target")


def roots_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search folders, each once."""
    n = table(spark, sf_dir, "notes")
    roots = U.search_roots(F.concat_ws(":", "path", F.lit(" "), "source_path", "path"), F.lit("out"))
    return n.select("note_id", F.array_join(roots, "|").alias("roots"), F.size(U.unique_appended(roots, F.col("path"))).alias("n"))


def paths_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the outputs named by items are notes."""
    i, n = table(spark, sf_dir, "manifest_items"), table(spark, sf_dir, "notes")
    path = F.when(F.col("note_id") % 2 == 0, F.concat(F.lit("file://"), F.replace("path", F.lit("/"), F.lit("%2F")))).otherwise(F.col("path"))
    named = i.select("output_path").unionByName(n.select(path.alias("output_path"))).where("output_path is not null")
    return U.existing_paths(named, "output_path", n, "path")


def stages_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each item goes on after a failure, and how long it waits."""
    i = table(spark, sf_dir, "manifest_items")
    stage = F.when(F.col("item_id") % 2 == 0, "qwen").otherwise("download")
    return i.select("item_id", U.resume_stage(F.coalesce("status", F.lit("")), stage, F.col("output_path").isNotNull() | F.col("bvid").isNotNull()).alias("stage"), U.network_failure(F.col("error")).alias("is_network"), U.backoff(F.col("item_id") % 9 + 1, 2, 60).alias("seconds"))


def drafts_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed items with the output of an earlier item of the same source and title."""
    i = table(spark, sf_dir, "manifest_items")
    staged = i.where("status = 'converted' and title is not null and output_path is not null").select("title", "source_type", "output_path")
    return U.recovered(i.where("status = 'failed'").select("item_id", "title", "source_type"), staged, ["title", "source_type"], "output_path").select("item_id", "output_path")


def summaries_to_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a batch over freshly written video notes."""
    n = table(spark, sf_dir, "notes").where("note_type = 'video-note'")
    fresh = sinks.video_note(F.coalesce("title", F.lit("")), F.coalesce("source_url", F.lit("")), F.coalesce("author", F.lit("")), F.coalesce("duration", F.lit("")), F.coalesce("body", F.lit("")), ["视频摘要"])
    return U.summary_counts(n.withColumn("text", F.when(F.col("note_id") % 3 > 0, fresh).otherwise(F.col("body"))), "text", F.col("status") == "failed")


def ids_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed ids, appended in two runs and read back."""
    i, target = table(spark, sf_dir, "manifest_items"), _folder(spark, "ids")
    U.append_lines(i.where("status = 'converted'").select("bvid"), target)
    U.append_lines(i.where("status = 'skipped'").select("bvid"), target)
    return files.processed_ids(spark, target)


def failures_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed items, written as failure lists of each kind of source and read back."""
    i, target = table(spark, sf_dir, "manifest_items"), _folder(spark, "failures")
    U.write_failures(i, "source_type", target, "2024-01-01T00:00:00Z")
    return U.read_failures(spark, target, "source_type").where("item_id is not null")


def report_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as CSV and read as a table."""
    i, target = table(spark, sf_dir, "manifest_items"), _folder(spark, "report")
    sinks.report_csv(i.groupBy("batch_no").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "failed").alias("failed")), target)
    return spark.read.option("header", "true").schema("batch_no int, items bigint, failed bigint").csv(target)


def manifest_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest committed twice; readers see the second version."""
    i, target = table(spark, sf_dir, "manifest_items").select("item_id", "status"), _folder(spark, "manifest")
    sinks.commit_version(i.where("status = 'failed'"), target)
    sinks.commit_version(i.where("status = 'skipped'"), target)
    return sinks.current_version(spark, target)


def notes_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes stored by kind and read back by one of them."""
    n, target = table(spark, sf_dir, "notes").select("note_id", "title", "source_type"), _folder(spark, "notes")
    sinks.write_notes(n, target)
    return spark.read.parquet(target).where("source_type = 'pdf'").select("note_id", "title")


def texts_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to the length of a request."""
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("x", R.truncated(F.col("text"), 500))
    return d.select("doc_id", "x.used", "x.total", "x.cut", F.sha2("x.text", 256).alias("text_hash"))


def retryable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of one kind of source that weren't settled by hand."""
    i = table(spark, sf_dir, "manifest_items").where("status = 'failed'").withColumns({"collection_type": F.col("source_type"), "collection_id": (F.col("batch_no") % 2).cast("string")})
    return R.retryable(i, "bilibili", "1").select("item_id")


def durations_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose missing author is taken from the list of videos."""
    n = table(spark, sf_dir, "notes").where("bvid is not null").withColumn("author", F.when(F.col("note_id") % 2 == 0, F.lit("未知")).otherwise(F.col("author")))
    probed = table(spark, sf_dir, "collection_entries").where("bvid <> ''").groupBy("bvid").agg(F.min("upper").alias("author"))
    return R.repaired(n, "author", probed, "bvid").select("note_id", "author", "was_repaired")


def extras_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of items by those of other items of the same output."""
    n = table(spark, sf_dir, "notes").select("note_id", "title", "author")
    extras = n.where("note_id % 3 = 0").select("note_id", F.when(F.col("note_id") % 2 == 0, "").otherwise(F.upper("title")).alias("title"))
    return R.with_extras(n, extras, "note_id")


def history_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a history: unknown states failed, running ones interrupted."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 5 == 0, "running").when(F.col("event_id") % 5 == 1, "success").otherwise(F.col("event_type"))
    raw = e.select(F.when(F.col("event_id") % 11 > 0, F.col("event_id").cast("string")).alias("id"), status.alias("status"), F.lit(None).cast("string").alias("log"), F.lit(None).cast("array<string>").alias("outputs"))
    return R.loaded_history(raw).select("id", "status", "log", F.size("outputs").alias("outputs"))


def addresses_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ending and date of what notes refer to."""
    n = table(spark, sf_dir, "notes").where("source_url is not null")
    tails = F.array(F.lit("/pic.JPG"), F.lit("/pic.jpeg?x=1"), F.lit("/pic?wx_fmt=png"))
    address = F.concat(F.lit("https://a.example/"), "note_id", F.element_at(tails, (F.col("note_id") % 3 + 1).cast("int")))
    return n.select("note_id", T.asset_extension(address, F.lit("")).alias("ending"), T.dashed_date(F.regexp_replace(F.coalesce("created", F.lit("")), "-", "")).alias("day"), T.retryable((F.col("note_id") % 100 + 400).cast("int")).alias("is_retryable"))


QUERIES = {
    f.__name__: f
    for f in (
        notes_normalised, drafts_found, notes_complete, attention_view, state_view, folder_sizes, newest_notes, source_bag, sources_split, transcripts_chained, pdf_titles,
        model_labels, titles_escaped, assets_named, roots_listed, paths_checked, stages_resumed, drafts_recovered, summaries_to_fill, ids_appended, failures_listed,
        report_read_back, manifest_read_back, notes_stored, texts_cut, retryable_items, durations_repaired, extras_merged, history_loaded, addresses_told,
    )
}

_strip, _LINKS = N._strip, N._LINKS
_TAGS = f"""coalesce(array_to_string(list_filter(t, lambda x, i: x <> '' AND NOT list_contains(list_slice(t, 1, i - 1), x)), ','), '')"""
_ESCAPED = "'<b>\"''&' || title"
for _sign, _name in U.ESCAPES:
    _ESCAPED = f"replace({_ESCAPED}, '{_sign.replace(chr(39), chr(39) * 2)}', '{_name}')"
_OWN = _strip("CASE WHEN note_id % 3 = 0 THEN 'a/' || title ELSE title END")
_PLACE = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(transcript_source, ''), '{p}') THEN {k}" for k, (p, _) in enumerate(CHAIN)) + f" ELSE {len(CHAIN)} END"
_NETWORK = " OR ".join(f"contains(lower(coalesce(error, '')), '{n}')" for n in U.NETWORK)

SQL = {
    "notes_normalised": f"""SELECT note_id, title, source_type, note_type, created, tags, source_hash, NOT (title IS NOT DISTINCT FROM o_title AND source_type IS NOT DISTINCT FROM o_source_type AND note_type IS NOT DISTINCT FROM o_note_type AND created IS NOT DISTINCT FROM o_created
            AND tags_list IS NOT DISTINCT FROM o_tags AND source_hash IS NOT DISTINCT FROM o_hash AND new_path IS NOT DISTINCT FROM o_path AND new_url IS NOT DISTINCT FROM o_url) AS was_changed FROM (
        SELECT i.note_id, i.title, j.source_type, j.note_type, j.created_day AS created, n.tags AS o_tags, n.title AS o_title, n.source_type AS o_source_type, n.note_type AS o_note_type, n.created AS o_created,
            n.source_hash AS o_hash, n.source_path AS o_path, n.source_url AS o_url, coalesce(nullif(n.source_hash, ''), substring(sha256(coalesce(n.body, '')), 1, 16)) AS source_hash,
            coalesce(nullif(n.source_path, ''), CASE WHEN starts_with(coalesce(n.source_url, ''), 'file://') THEN substring(n.source_url, 8) END) AS new_path,
            CASE WHEN NOT starts_with(coalesce(n.source_url, ''), 'file://') THEN n.source_url END AS new_url,
            list_concat(list_transform(coalesce(n.tags, []), lambda x: {_strip('x')}), CASE WHEN j.note_type = 'video-note' THEN ['video'] WHEN j.note_type = 'course-note' THEN ['course'] ELSE [] END,
                CASE WHEN j.source_type = 'wechat-article' THEN ['source/web', 'source/wechat'] WHEN j.source_type NOT IN ('', 'markdown') THEN ['source/' || j.source_type] ELSE [] END,
                CASE WHEN coalesce(n.status, '') <> '' THEN ['status/' || n.status] ELSE [] END) AS t,
            list_filter(t, lambda x, i: x <> '' AND NOT list_contains(list_slice(t, 1, i - 1), x)) AS tags_list, {_TAGS} AS tags
        FROM ({N._INDEX}) i JOIN ({N.SQL["inferred_types"]}) j USING (note_id) JOIN notes n USING (note_id))""",
    "drafts_found": "SELECT path, min(item_id) AS item_id FROM (SELECT output_path AS path, item_id FROM manifest_items UNION ALL SELECT source_path, item_id FROM manifest_items) WHERE path IS NOT NULL GROUP BY path",
    "notes_complete": rf"SELECT note_id FROM notes WHERE status = 'organized' AND (coalesce(source_type, '') <> 'webpage' OR regexp_matches(coalesce(body, ''), '(?m)^{U.ORIGINAL}[^\S\n]*$'))",
    "attention_view": "SELECT item_id, batch_no FROM manifest_items WHERE coalesce(manual_status, status) IN ('failed', 'rebuild')",
    "state_view": "SELECT item_id FROM manifest_items WHERE status = 'skipped' AND item_id <> 17",
    "folder_sizes": """SELECT folder, count(*) AS files, sum(size) AS size FROM (SELECT length(coalesce(body, '')) AS size, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(list_slice(string_split(path, '/'), 1, n), '/'))) AS folder
        FROM notes WHERE contains(path, '/')) GROUP BY folder""",
    "newest_notes": "SELECT note_id, row_number() OVER (PARTITION BY machine ORDER BY saved_at DESC NULLS LAST, path NULLS FIRST, note_id) AS place FROM notes",
    "source_bag": "SELECT source_path FROM notes WHERE source_path IS NOT NULL UNION ALL SELECT source_path FROM manifest_items WHERE source_path IS NOT NULL",
    "sources_split": f"""SELECT transcript_id, sha256({_strip("split_part(transcript_text, chr(10), 1)")}) AS source_hash, CASE WHEN contains(transcript_text, chr(10)) THEN length(transcript_text) - length(split_part(transcript_text, chr(10), 1)) - 1 ELSE 0 END AS size
        FROM transcripts WHERE transcript_text IS NOT NULL""",
    "transcripts_chained": f"""SELECT note_id, transcript_id, list_extract({[label for _, label in CHAIN]}, p + 1) AS label FROM (SELECT *, {_PLACE} AS p FROM transcripts WHERE note_id IS NOT NULL AND {_strip("coalesce(transcript_text, '')")} <> '')
        WHERE p < {len(CHAIN)} QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY p, transcript_id) = 1""",
    "pdf_titles": f"SELECT note_id, CASE WHEN t <> '' AND lower(t) NOT IN ('untitled', 'none') THEN t END AS title FROM (SELECT note_id, {_strip("coalesce(CASE WHEN note_id % 5 = 0 THEN 'Untitled' WHEN note_id % 7 = 0 THEN ' ' ELSE title END, '')")} AS t FROM notes)",
    "model_labels": "SELECT note_id, nullif(model, '') AS label FROM notes WHERE model IS NOT NULL",
    "titles_escaped": rf"SELECT note_id, {_ESCAPED} AS escaped, CASE WHEN {_OWN} <> '' AND NOT regexp_matches({_OWN}, '[/\\]') AND {_OWN} NOT IN ('.', '..') THEN CASE WHEN ends_with(lower({_OWN}), '.md') THEN {_OWN} ELSE {_OWN} || '.md' END END AS file_name FROM notes WHERE title IS NOT NULL",
    "assets_named": rf"""SELECT note_id, target, printf('image-%03d-%s%s', row_number() OVER (PARTITION BY note_id ORDER BY target), substring(sha256(target), 1, 12), coalesce(nullif(lower(regexp_extract(regexp_replace(target, '[?#].*$', ''), '[^/.](\.[A-Za-z0-9]{{2,6}})$', 1)), ''), '.bin')) AS name
        FROM (SELECT DISTINCT note_id, unnest({_LINKS.replace("@b@", "body")}) AS target FROM notes WHERE body IS NOT NULL)""",
    "roots_listed": f"""SELECT note_id, array_to_string(r, '|') AS roots, len(r) + CASE WHEN {_strip("coalesce(path, '')")} = '' OR list_contains(r, path) THEN 0 ELSE 1 END AS n FROM (SELECT note_id, path, list_filter(l, lambda x, i: NOT list_contains(list_slice(l, 1, i - 1), x)) AS r FROM (
        SELECT note_id, path, list_append(list_filter(list_transform(string_split(concat_ws(':', path, ' ', source_path, path), ':'), lambda x: {_strip('x')}), lambda x: x <> ''), 'out') AS l FROM notes))""",
    "paths_checked": """SELECT DISTINCT output_path, coalesce(p IN (SELECT path FROM notes WHERE path IS NOT NULL), false) AS exists FROM (SELECT output_path, nullif(trim(CASE WHEN starts_with(output_path, 'file://') THEN url_decode(substring(output_path, 8)) ELSE output_path END), '') AS p FROM
        (SELECT output_path FROM manifest_items UNION ALL SELECT CASE WHEN note_id % 2 = 0 THEN 'file://' || replace(path, '/', '%2F') ELSE path END FROM notes) WHERE output_path IS NOT NULL)""",
    "stages_resumed": f"""SELECT item_id, CASE WHEN coalesce(status, '') <> 'failed' THEN 'done' WHEN item_id % 2 = 0 AND (output_path IS NOT NULL OR bvid IS NOT NULL) THEN 'organise' ELSE 'transcribe' END AS stage, {_NETWORK} AS is_network,
        least(60.0, 2.0 * pow(2.0, item_id % 9))::DOUBLE AS seconds FROM manifest_items""",
    "drafts_recovered": """SELECT i.item_id, s.output_path FROM manifest_items i LEFT JOIN (SELECT title, source_type, min(output_path) AS output_path FROM manifest_items WHERE status = 'converted' AND title IS NOT NULL AND output_path IS NOT NULL GROUP BY ALL) s
        ON i.title = s.title AND i.source_type = s.source_type WHERE i.status = 'failed'""",
    "summaries_to_fill": """SELECT count(*) FILTER (o AND NOT b) AS to_fill, count(*) FILTER (NOT o AND NOT b) AS skipped, count(*) FILTER (b) AS failed FROM (SELECT note_id % 3 > 0 OR contains(coalesce(body, ''), '【AI待处理') AS o, coalesce(status = 'failed', false) AS b
        FROM notes WHERE note_type = 'video-note')""",
    "ids_appended": f"SELECT DISTINCT {_strip('bvid')} AS id FROM manifest_items WHERE status IN ('converted', 'skipped') AND {_strip('bvid')} <> ''",
    "failures_listed": "SELECT source_type, item_id, error FROM manifest_items WHERE status = 'failed'",
    "report_read_back": "SELECT batch_no, count(*) AS items, count(*) FILTER (status = 'failed') AS failed FROM manifest_items GROUP BY batch_no",
    "manifest_read_back": "SELECT item_id, status FROM manifest_items WHERE status = 'skipped'",
    "notes_stored": "SELECT note_id, title FROM notes WHERE source_type = 'pdf'",
    "texts_cut": rf"""SELECT doc_id, length(x) AS used, length(text) AS total, length(text) > 500 AS cut, sha256(x) AS text_hash FROM (SELECT doc_id, text, CASE WHEN length(text) > 500 THEN regexp_replace(substring(text, 1, 500), '{N.W}+\z', '') ELSE text END AS x FROM documents WHERE text IS NOT NULL)""",
    "retryable_items": "SELECT item_id FROM manifest_items WHERE status = 'failed' AND source_type = 'bilibili' AND batch_no % 2 = 1 AND coalesce(manual_status, 'failed') IN ('failed', 'rebuild')",
    "durations_repaired": f"""SELECT note_id, CASE WHEN u THEN new ELSE author END AS author, u AS was_repaired FROM (SELECT n.note_id, n.author, p.author AS new, (n.author IS NULL OR {_strip("coalesce(n.author, '')")} IN ('', '未知', 'unknown')) AND coalesce(p.author, '') <> '' AS u
        FROM (SELECT note_id, bvid, CASE WHEN note_id % 2 = 0 THEN '未知' ELSE author END AS author FROM notes WHERE bvid IS NOT NULL) n LEFT JOIN (SELECT bvid, min(upper) AS author FROM collection_entries WHERE bvid <> '' GROUP BY bvid) p USING (bvid))""",
    "extras_merged": f"SELECT note_id, CASE WHEN note_id % 3 = 0 AND note_id % 2 <> 0 AND {_strip("coalesce(title, '')")} <> '' THEN upper(title) ELSE title END AS title, author FROM notes",
    "history_loaded": """SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 5 = 0 THEN 'interrupted' WHEN event_id % 5 = 1 THEN 'success' WHEN event_type IN ('success', 'failed', 'cancelled', 'interrupted') THEN event_type ELSE 'failed' END AS status, '' AS log, 0 AS outputs
        FROM events WHERE event_id % 11 > 0""",
    "addresses_told": r"""SELECT note_id, CASE WHEN note_id % 3 = 2 THEN '.png' ELSE '.jpg' END AS ending, regexp_replace(replace(coalesce(created, ''), '-', ''), '^(\d{4})(\d{2})(\d{2})$', '\1-\2-\3') AS day,
        note_id % 100 IN (8, 9, 25, 29) AS is_retryable FROM notes WHERE source_url IS NOT NULL""",
}
