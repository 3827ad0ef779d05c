"""Sinks: notes as files by kind, manifests as versions with a pointer, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notefold.functions.markdown import render_frontmatter


def note_text(fields: list[tuple[str, Column]], title: Column, source: Column, text: Column) -> Column:
    """A draft note: frontmatter, title, where it comes from, the extracted text."""
    return F.concat(render_frontmatter(fields), F.lit("\n\n# "), title, F.lit("\n\n## 来源信息\n\n- 来源："), source, F.lit("\n\n## 原文抽取\n\n"), text, F.lit("\n"))


def video_note(title: Column, url: Column, author: Column, duration: Column, subtitle: Column, sections: list[str], folded: bool = True) -> Column:
    """A video note: its data as a quote, sections still to be filled, the subtitle folded or as a section."""
    data = F.concat(F.lit("> **链接**："), url, F.lit("\n> **作者**："), author, F.lit("\n> **时长**："), duration)
    open_sections = "\n\n".join(f"## {s}\n\n【AI待处理：{s}】" for s in sections)
    raw = F.concat(F.lit("<details>\n<summary>📄 原始字幕</summary>\n\n"), subtitle, F.lit("\n\n</details>\n")) if folded else F.concat(F.lit("## 原始字幕\n\n"), subtitle, F.lit("\n"))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), data, F.lit(f"\n\n{open_sections}\n\n---\n"), raw)


def write_notes(notes: DataFrame, target: str, kind: str = "source_type") -> None:
    """Notes as one table partitioned by kind, the form that scales."""
    notes.write.mode("overwrite").option("compression", "zstd").partitionBy(kind).parquet(target)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def commit_version(df: DataFrame, target: str) -> str:
    """Write a table beside the current one, then swap the pointer; readers see the old or the new table, never a mixture."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{target}/{version}")
    fs, temp = _fs(spark, f"{target}/_current.{version}")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    _, pointer = _fs(spark, f"{target}/_current")
    _replace(spark, temp, pointer)
    return version


def _replace(spark: SparkSession, source, target) -> None:
    """Rename over an existing file in one step, so that a reader at no time finds none."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    uri = target.getFileSystem(conf).makeQualified(target).toUri()
    hadoop.FileContext.getFileContext(uri, conf).rename(source, target, overwrite)


def current_version(spark: SparkSession, target: str) -> DataFrame | None:
    """The committed table, or None where none was committed."""
    fs, pointer = _fs(spark, f"{target}/_current")
    if not fs.exists(pointer):
        return None
    return spark.read.parquet(f"{target}/{json.loads(_read(fs, pointer))['version']}")


def _read(fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def report_csv(df: DataFrame, target: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(target)


def index_json(notes: DataFrame, assets: DataFrame, target: str) -> dict[str, int]:
    """Note and asset indexes as JSON lines, and their counts."""
    notes.write.mode("overwrite").json(f"{target}/notes")
    assets.write.mode("overwrite").json(f"{target}/assets")
    totals = assets.agg(F.count("*").alias("assets"), F.count_if(~F.col("exists")).alias("missing")).first()
    return {"note_count": notes.count(), "asset_count": totals["assets"], "missing_count": totals["missing"]}


def book(notes: DataFrame, by: str, order: str, text: str, run: int = 1000) -> DataFrame:
    """Notes of a group in order as parts of a book, ``run`` notes a part, so that no part outgrows a task."""
    numbered = notes.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).withColumn("part", F.floor(F.col("__n") / run))
    listed = F.array_sort(F.collect_list(F.struct("__n", text)))
    return numbered.groupBy(by, "part").agg(F.array_join(F.transform(listed, lambda x: x[text]), "\n\n---\n\n").alias("text"))


def structured_line(prefix: str, fields: Column) -> Column:
    """One line of a log that a reader finds by its prefix."""
    return F.concat(F.lit(prefix), F.to_json(fields))
