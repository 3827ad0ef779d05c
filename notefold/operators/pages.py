"""Pages of scanned files: amounts of text per source, the need of recognition, replacement of sparse pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions.text import WS

#: Signs below which a page is sparse and below which a source has too little text.
SPARSE, TOO_LITTLE = 30, 160


def signs(text: Column) -> Column:
    """Code points that aren't white space; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(text, WS, "")), F.lit(0))


def amounts(pages: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """``by..., n_pages, n_signs, n_sparse, needs_ocr``."""
    n = signs(F.col(text))
    counted = pages.groupBy(*by).agg(F.count("*").alias("n_pages"), F.sum(n).alias("n_signs"), F.count_if(n < SPARSE).alias("n_sparse"))
    sparse = F.col("n_sparse") >= F.greatest(F.lit(1.0), F.col("n_pages") / 2)
    return counted.withColumn("needs_ocr", (F.col("n_signs") < TOO_LITTLE) | sparse)


def replaced(pages: DataFrame, recognised: DataFrame, on: list[str], text: str = "text") -> DataFrame:
    """Pages whose sparse texts are replaced by recognised ones that aren't; ``was_replaced`` tells which."""
    other = recognised.groupBy(*on).agg(F.max_by(text, signs(F.col(text))).alias("__text"))
    use = (signs(F.col(text)) < SPARSE) & (signs(F.col("__text")) >= SPARSE)
    return pages.join(other, on, "left").withColumn("was_replaced", use).withColumn(text, F.when(use, F.col("__text")).otherwise(F.col(text))).drop("__text")


def missing(total: DataFrame, done: DataFrame, by: list[str], page: str = "page") -> DataFrame:
    """Pages of ``total`` (columns ``by`` and ``total``) that a checkpoint of recognised pages lacks."""
    every = total.select(*by, F.explode(F.sequence(F.lit(1), F.greatest(F.col("total"), F.lit(1)))).alias(page), "total").where(F.col(page) <= F.col("total")).drop("total")
    return every.join(done.where("text is not null").select(*by, page).distinct(), [*by, page], "left_anti")
