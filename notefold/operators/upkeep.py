"""Upkeep of notes, drafts and batches: normalising, lookups, views, recovery, and small columns around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions import markdown as M
from notefold.functions import text as T
from notefold.functions.text import blank_as_null, first_filled, strip

# States that call for attention, words of an unset PDF title, signs of a failed connection, tokens of HTML.
ATTENTION = ("failed", "rebuild")
UNTITLED = ("untitled", "none")
NETWORK = ("timed out", "timeout", "connection", "network", "proxy", "ssl", "temporary failure", "name resolution", "unreachable", "reset by peer", "refused", "dns")
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
OPEN_PLACE = "【AI待处理"
ORIGINAL = "## 原文抽取"


def normalised(notes: DataFrame, today: str, course_folder: str = "/courses/") -> DataFrame:
    """``notes`` with every lacking field set: title, source and note type, created day, tags, content hash; ``was_changed``
    tells whether any differs from what stood there. What is filled stays. A file's address moves from ``source_url`` to
    ``source_path``."""
    url, body = F.coalesce("source_url", F.lit("")), F.coalesce("body", F.lit(""))
    local = url.startswith("file://")
    kind = M.source_type(F.col("source_type"), F.col("source_url"), F.col("path"), F.col("body"), course_folder)
    note = M.note_type(F.col("note_type"), kind, F.col("body"))
    made = {
        "title": M.title_of(F.col("title"), body, F.col("path")),
        "source_type": kind,
        "note_type": note,
        "created": M.created_date(F.col("created"), F.col("published"), F.col("path"), today),
        "tags": T.inferred_tags(F.coalesce("tags", F.array().cast("array<string>")), note, kind, F.coalesce("status", F.lit(""))),
        "source_hash": first_filled(F.col("source_hash"), F.substring(F.sha2(body, 256), 1, 16)),
        "source_path": first_filled(F.col("source_path"), F.when(local, F.substring("source_url", 8, 1 << 30))),
        "source_url": F.when(~local, F.col("source_url")),
    }
    changed = reduce(Column.__or__, [~F.col(c).eqNullSafe(v) for c, v in made.items()])
    return notes.withColumns(made | {"was_changed": changed})


def looked_up(paths: DataFrame, items: DataFrame, path: str, places: list[str], order: str) -> DataFrame:
    """``path`` and the first item, in ``order``, that has it in any of ``places``: one equal join a place, no or-join."""
    hits = [paths.select(path).distinct().join(items.select(F.col(p).alias(path), F.col(order)), path) for p in places]
    return reduce(DataFrame.unionByName, hits).groupBy(path).agg(F.min(order).alias(order))


def organised_complete(status: Column, kind: Column, text: Column) -> Column:
    """Whether a note needs no organising any more; one of an ``opus`` only with its original section."""
    return (status == "organized") & ((kind != "opus") | F.coalesce(text, F.lit("")).rlike(rf"(?m)^{ORIGINAL}[^\S\n]*$"))


def viewed(rows: DataFrame, state: Column, view: str) -> DataFrame:
    """Rows of a view: ``all``, ``attention`` (failed or to be rebuilt), or of exactly one state."""
    return rows if view == "all" else rows.where(state.isin(*ATTENTION) if view == "attention" else state == view)


def without_entry(history: DataFrame, id_col: str, gone: str) -> DataFrame:
    """A history without one entry; entries of null id stay."""
    return history.where(~F.col(id_col).eqNullSafe(F.lit(gone)))


def folder_sizes(files: DataFrame, path: str, size: Column) -> DataFrame:
    """``folder, files, size`` of every folder with all below it; a file counts in each folder above it."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.where(F.col(path).contains("/")).select(F.explode(above).alias("folder"), size.alias("size")).groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def split_source(text: Column) -> Column:
    """``STRUCT<source, text>`` of a recogniser's answer: the first line names the source, the rest is the text."""
    cut = F.instr(text, "\n")
    return F.struct(strip(F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text)).alias("source"), F.when(cut > 0, F.substring(text, cut + 1, F.length(text))).otherwise("").alias("text"))


def transcript_chain(found: DataFrame, key: str, origin: str, text: str, chain: list[tuple[str, str]], order: str) -> DataFrame:
    """Per key the first filled text along a chain of origins (``(pattern, label)``, tried in order) and the origin's label.

    Of several texts of one origin the first in ``order`` counts. Backends only have to put what they found into one table.
    """
    place = reduce(lambda rest, step: F.when(F.coalesce(origin, F.lit("")).rlike(step[1][0]), step[0]).otherwise(rest), reversed(list(enumerate(chain))), F.lit(len(chain)))
    ranked = found.withColumn("__place", place).where((F.col("__place") < len(chain)) & blank_as_null(strip(F.col(text))).isNotNull())
    best = F.min_by(F.struct(F.col("__place").alias("p"), F.col(order).alias("o")), F.struct("__place", order))
    labels = F.array(*[F.lit(label) for _, label in chain])
    return ranked.groupBy(key).agg(best.alias("b")).select(key, F.col("b.o").alias(order), F.element_at(labels, F.col("b.p") + 1).alias("label"))


def pdf_title(title: Column) -> Column:
    """A PDF's own title; null where it is none."""
    own = strip(F.coalesce(title, F.lit("")))
    return F.when((own != "") & ~F.lower(own).isin(*UNTITLED), own)


def model_label(raw: Column) -> Column:
    """A model's name from JSON: a string itself, else its identifier as indexed, else its identifier."""
    return first_filled(F.get_json_object(raw, "$.indexedModelIdentifier"), F.get_json_object(raw, "$.identifier"), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"])


def escaped(text: Column) -> Column:
    """Text for HTML."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def output_name(name: Column) -> Column:
    """A custom name of one output, ending in ``.md``; null where it is blank or leads out of its folder."""
    own = strip(F.coalesce(name, F.lit("")))
    return F.when((own != "") & ~own.rlike(r"[/\\]") & ~own.isin(".", ".."), F.when(F.lower(own).endswith(".md"), own).otherwise(F.concat(own, F.lit(".md"))))


def asset_names(targets: DataFrame, note: str, at: str, target: str) -> DataFrame:
    """``note, target, name``: each address of a note once, numbered by its first place, named by number and hash."""
    first = targets.groupBy(note, target).agg(F.min(at).alias(at))
    listed = first.groupBy(note).agg(F.array_sort(F.collect_list(F.struct(at, target))).alias("x")).select(note, F.posexplode("x").alias("n", "x"))
    name = F.format_string("image-%03d-%s%s", F.col("n") + 1, F.substring(F.sha2(F.col(f"x.{target}"), 256), 1, 12), T.asset_extension(F.col(f"x.{target}"), F.lit("")))
    return listed.select(note, F.col(f"x.{target}").alias(target), name.alias("name"))


def unique_appended(paths: Column, more: Column) -> Column:
    """A list of paths with another at its end, unless it is there already or blank."""
    return F.when(blank_as_null(more).isNull() | F.array_contains(paths, more), paths).otherwise(F.concat(paths, F.array(more)))


def search_roots(setting: Column, output: Column) -> Column:
    """Folders of a setting separated by colons, and the output folder, each once in order."""
    return F.array_distinct(F.concat(F.filter(F.transform(F.split(F.coalesce(setting, F.lit("")), ":"), strip), lambda p: p != ""), F.array(output)))


def existing_paths(paths: DataFrame, path: str, files: DataFrame, file: str) -> DataFrame:
    """``path, exists`` of stored paths: blank ones don't, ``file://`` addresses are decoded, others are as listed."""
    plain = F.when(F.col(path).startswith("file://"), F.try_url_decode(F.replace(F.substring(path, 8, 1 << 30), F.lit("+"), F.lit("%2B")))).otherwise(F.col(path))
    keyed = paths.select(path).distinct().withColumn("__file", blank_as_null(plain))
    listed = files.select(F.col(file).alias("__file"), F.lit(True).alias("there")).distinct()
    return keyed.join(listed, "__file", "left").select(path, F.coalesce("there", F.lit(False)).alias("exists"))


def resume_stage(status: Column, stage: Column, has_text: Column) -> Column:
    """Where a failed item goes on: what comes after the transcript needs no new one, if the text is still there."""
    return F.when(status != "failed", "done").when(stage.isin("qwen", "organize") & has_text, "organise").otherwise("transcribe")


def network_failure(error: Column) -> Column:
    """Whether an error reads like a failed connection."""
    return reduce(Column.__or__, [F.lower(F.coalesce(error, F.lit(""))).contains(n) for n in NETWORK])


def backoff(attempt: Column, delay: float, most: float) -> Column:
    """Seconds to wait after an attempt, doubled from one to the next."""
    return F.least(F.lit(float(most)), F.lit(float(delay)) * F.pow(F.lit(2.0), attempt - 1))


def recovered(sources: DataFrame, staged: DataFrame, key: list[str], draft: str) -> DataFrame:
    """Sources with the draft staged for them in an earlier run (null: convert anew); of several the first in order counts."""
    return sources.join(staged.groupBy(*key).agg(F.min(draft).alias(draft)), key, "left")


def summary_counts(notes: DataFrame, text: str, failed: Column) -> DataFrame:
    """``to_fill, skipped, failed`` of a batch that only fills open places: notes without one are skipped."""
    open_ = F.coalesce(F.col(text), F.lit("")).contains(OPEN_PLACE)
    bad = F.coalesce(failed, F.lit(False))
    return notes.agg(F.count_if(open_ & ~bad).alias("to_fill"), F.count_if(~open_ & ~bad).alias("skipped"), F.count_if(bad).alias("failed"))


def append_lines(ids: DataFrame, target: str) -> None:
    """Append ids, one a line, blank ones left out; reading takes each once (``sources.files.processed_ids``)."""
    ids.select(blank_as_null(strip(F.col(ids.columns[0]).cast("string"))).alias("value")).where("value is not null").write.mode("append").text(target)


def write_failures(items: DataFrame, collection: str, target: str, updated_at: str) -> None:
    """Failed items of each collection as JSON lines: ``collection, failures, updated_at``. A collection's failures are
    listed in parts of ten thousand, so that no line grows with it."""
    failed = items.where("status = 'failed'").withColumn("part", F.floor(F.col("item_id") / 10_000))
    listed = F.array_sort(F.collect_list(F.struct("item_id", "error")))
    failed.groupBy(collection, "part").agg(listed.alias("failures")).withColumn("updated_at", F.lit(updated_at)).write.mode("overwrite").json(target)


def read_failures(spark: SparkSession, target: str, collection: str, kind: str = "string") -> DataFrame:
    """``collection, item_id, error`` of a failure list."""
    schema = f"{collection} {kind}, failures array<struct<item_id:bigint,error:string>>"
    return spark.read.schema(schema).json(target).select(collection, F.explode("failures").alias("x")).select(collection, "x.item_id", "x.error")
