from notefold.plans import catalogue


def test_every_batch_is_listed_in_order(spark, tmp_path):
    rows = [(b, "failed" if i < b % 6 else "rebuild" if i == 8 and b == 5 else "converted") for b in range(25) for i in range(9)] + [(None, "skipped")]
    spark.createDataFrame(rows, "batch_no int, status string").repartition(3).write.parquet(f"{tmp_path}/manifest_items.parquet")
    got = [tuple(r) for r in catalogue.queries()["manifest_attention_all"](spark, str(tmp_path)).collect()]
    amounts = {b: b % 6 + (b == 5) for b in range(25)}
    assert got == [(b, amounts[b], 9) for b in sorted(amounts, key=lambda b: (-amounts[b], b)) if amounts[b]] + [(b, 0, 9) for b in range(0, 25, 6)] + [(None, 0, 1)]
