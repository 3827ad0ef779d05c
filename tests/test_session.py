import os

from notefold.session import bounded_batches, forget, materialise, shared_dir, small


def test_tables_are_written_and_forgotten(spark):
    forget(spark)
    df = materialise(spark.range(5), "five")
    assert df.count() == 5 and shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    names = [n for n in os.listdir(shared_dir(spark).removeprefix("file://")) if n.startswith("five-")]
    assert len(names) == 1 and forget(spark) == 1 and forget(spark) == 0


def test_small_hints_only_within_the_bound(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small(spark.range(3), 3)).lower() and "broadcast" not in plan(small(spark.range(4), 3)).lower()


def test_small_hints_only_within_the_bytes(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString().lower()
    wide = spark.range(100).selectExpr("id", "repeat('x', 1000) as t", "array(repeat('y', 1000)) as a")
    assert "broadcast" in plan(small(wide, 100)) and "broadcast" not in plan(small(wide, 100, 150_000))
    joined = spark.range(100).join(small(wide, 100, 1), "id")
    assert joined.count() == 100


def test_batches_are_bounded_by_bytes_alike_for_all(spark):
    bounded_batches(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    bounded_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
