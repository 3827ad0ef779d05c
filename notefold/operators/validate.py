"""Checks of written notes as a table of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions.markdown import LINE, asset_path, image_targets, rest_from


def violations(notes: DataFrame, id_col: str, text_col: str, kind: Column, keep_subtitles: bool = True) -> DataFrame:
    """``id, rule`` for each rule a note breaks. ``kind`` is video, source, paper or anything else."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    subtitle = t.rlike(rf"{LINE}(?:##\s+原始字幕|<summary>📄\s*原始字幕</summary>)")
    rules = {
        "draft path": t.rlike(rf"{LINE}draft_path:\s*"),
        "no source": ~t.rlike(rf"{LINE}(?:source_path|source_url):[ \t]*\S") & ~t.contains("## 来源追溯"),
        "subtitle missing": (kind == "video") & F.lit(keep_subtitles) & ~subtitle,
        "subtitle left": (kind == "video") & F.lit(not keep_subtitles) & subtitle,
        "not organised": (kind == "source") & ~t.rlike(rf"{LINE}status:\s*organized\s*(?:\n|\z)"),
        "original missing": (kind == "source") & (rest_from(t, "原文抽取") == ""),
        "translation missing": (kind == "paper") & (rest_from(t, "全文翻译") == ""),
    }
    broken = F.array_compact(F.array(*(F.when(test, F.lit(rule)) for rule, test in rules.items())))
    return notes.select(F.col(id_col).alias("id"), F.explode(broken).alias("rule"))


def missing_images(notes: DataFrame, id_col: str, path_col: str, text_col: str, files: DataFrame) -> DataFrame:
    """``id, target, path`` of images beside the note that aren't among ``files`` (column ``path``); ``..`` is resolved."""
    targets = notes.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.regexp_replace(path_col, r"/[^/]*$", "").alias("folder"), F.explode(image_targets(F.col(text_col))).alias("target"))
    own = targets.withColumn("file", asset_path(F.col("target"))).where(~F.col("file").rlike(r"^(?i:https?:|data:|//)") & (F.col("file") != ""))
    whole = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat("folder", F.lit("/"), "file"))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    resolved = F.concat(F.when(whole.startswith("/"), "/").otherwise(""), F.array_join(up, "/"))
    return own.select("id", "target", resolved.alias("path")).join(files.select("path").distinct(), "path", "left_anti").select("id", "target", "path")
