from pyspark.sql import functions as F

from notefold.operators import upkeep as U


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_small_columns(spark):
    c = F.col("c")
    assert [one(spark, U.output_name(c), c=v) for v in ("a", "a.MD", "a/b", "..", " ", "x\\y")] == ["a.md", "a.MD", None, None, None, None]
    assert [one(spark, U.pdf_title(c), c=v) for v in ("Untitled", " none ", "", "A paper")] == [None, None, None, "A paper"]
    assert [one(spark, U.model_label(c), c=v) for v in ('"m"', '{"identifier": "i"}', '{"indexedModelIdentifier": "n", "identifier": "i"}', "{}")] == ["m", "i", "n", "{}"]
    assert one(spark, U.escaped(c), c="<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"
    assert one(spark, U.split_source(c), c="asr\nline\n") == ("asr", "line\n") and one(spark, U.split_source(c), c="asr") == ("asr", "")
    assert one(spark, U.network_failure(c), c="Connection reset by peer") and not one(spark, U.network_failure(c), c="blocked")
    assert [one(spark, U.backoff(c, 2, 10), c=v) for v in (1, 2, 9)] == [2.0, 4.0, 10.0]


def test_nulls_and_empty_tables(spark):
    notes = spark.createDataFrame(
        [(1, None, None, None, None, None, None, None, None, None, None, None, "file:///a%20b.pdf")],
        "note_id int, path string, title string, source_type string, note_type string, created string, published string, tags array<string>, status string, body string, source_hash string, source_path string, source_url string",
    )
    row = U.normalised(notes, "2024-01-01").first()
    assert row["was_changed"] and row["created"] == "2024-01-01" and row["source_path"] == "/a%20b.pdf" and row["source_url"] is None and row["source_type"] == "local-video"
    assert U.normalised(notes.limit(0), "2024-01-01").count() == 0
    chain = U.transcript_chain(spark.createDataFrame([(1, "CC", " ", 1), (1, None, "x", 2), (1, "SRT", "a", 4), (1, "srt", "b", 3)], "k int, o string, t string, n int"), "k", "o", "t", [("CC", "web"), ("(?i)srt", "file")], "n")
    assert [tuple(r) for r in chain.collect()] == [(1, 3, "file")]
    files = spark.createDataFrame([("a/b/x", 1), ("a/y", 2), ("z", 4), (None, 8)], "path string, n int")
    assert {tuple(r) for r in U.folder_sizes(files, "path", F.col("n")).collect()} == {("a", 2, 3), ("a/b", 1, 1)}


def test_ids_and_failures_survive_a_round_trip(spark, tmp_path):
    from notefold.sources.files import processed_ids

    target = f"file://{tmp_path}/ids"
    U.append_lines(spark.createDataFrame([("a",), (" ",), (None,)], "id string"), target)
    U.append_lines(spark.createDataFrame([("a",), ("b",)], "id string"), target)
    assert {r[0] for r in processed_ids(spark, target).collect()} == {"a", "b"}
    items = spark.createDataFrame([(i, "c", "failed" if i % 2 else "converted", f"e{i}") for i in range(25_000)], "item_id bigint, collection string, status string, error string")
    U.write_failures(items, "collection", f"file://{tmp_path}/failures", "now")
    back = U.read_failures(spark, f"file://{tmp_path}/failures", "collection")
    assert back.count() == 12_500 and back.where("error <> concat('e', item_id)").count() == 0
