import hashlib
import random

from pyspark.sql import functions as F

from notefold.functions import markdown as M
from notefold.functions import python_text as P
from notefold.plans import catalogue, notes


def test_sections_merged_leaves_out_no_body(spark, tmp_path):
    long = "intro\n\n" + "".join(f"## {i}\nbody {i} {'x' * 500}\n\n" for i in range(2_000))
    assert len(long) >= 1_000_000
    rows = [(1, "## A\n1"), (2, long), (3, None), (4, ""), (5, "y" * notes.LONG_BODY)]
    spark.createDataFrame(rows, "note_id bigint, body string").write.parquet(f"{tmp_path}/notes.parquet")
    got = {r["note_id"]: (r["merged_hash"], r["size"]) for r in catalogue.queries()["sections_merged"](spark, str(tmp_path)).collect()}
    # The second copy's intro stands behind the first copy's last section, whose text so differs from its repeat.
    last = f"body 1999 {'x' * 500}"
    want = "intro\n\n" + "\n\n".join(f"## {i}\n\nbody {i} {'x' * 500}" for i in range(2_000)) + f"\n\nintro\n\n{last}"
    assert set(got) == {1, 2, 4, 5}
    assert got[2] == (hashlib.sha256(want.encode()).hexdigest(), len(want))


def test_long_and_short_sections_merge_alike(spark):
    r = random.Random(7)
    parts = ["## A", "## B ", "##C", "### D", "\n", "\n\n\n", "\r\n", "\r", "text", " ", "　", "\x85", "\x1f", "​", "中文", "## "]
    rows = [(i, "".join(r.choice(parts) + r.choice(["", "\n"]) for _ in range(r.randint(0, 25)))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", "t", M.merged_sections(F.col("t")).alias("jvm"), P.long_merged_sections("t").alias("py"))
    assert [(x["t"], x["jvm"]) for x in df.collect()] == [(x["t"], x["py"]) for x in df.collect()]
