"""Queries of the core's training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notefold.operators.instants import to_instants
from notefold.session import table

TIME_FIELDS = ["published", "transcribed_at", "created"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time value of a note that names an instant, as an epoch second."""
    return p4_instants(spark, sf_dir).where("utc_second is not null")


def p4_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time field of every note, null where it names no instant."""
    return to_instants(table(spark, sf_dir, "notes"), table(spark, sf_dir, "capture_machines"), TIME_FIELDS)


QUERIES = {"p4_found": p4_found, "p4_instants": p4_instants}
