"""Every core query with SQL against DuckDB on the smallest test tables, where those are present."""

import math
import os

import pytest

from notefold.plans import catalogue

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return int(v) if isinstance(v, bool) else v if isinstance(v, (int, str, type(None))) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr([plain(v) for v in row]) for row in found.fetchall())
    assert sorted(repr([plain(v) for v in row]) for row in df.select(*columns).collect()) == want
