"""All queries of the core and their SQL."""

from __future__ import annotations

from notefold.plans import notes, problems, records, upkeep


def queries() -> dict:
    return notes.QUERIES | records.QUERIES | problems.QUERIES | upkeep.QUERIES


def oracle_sql() -> dict:
    return notes.SQL | records.SQL | upkeep.SQL
