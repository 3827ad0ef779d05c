import random

from pyspark.sql import functions as F

from notefold.llm.dedup import History, identities, link_items, split_batches, with_page

ITEM = "item_id bigint, batch_no int, source_url string, bvid string, avid string, title string, author string, mid string, status string, source_path string, root string, key int"


def run(spark, rows, links=(), steps=3):
    full = [(i, b, u, bv, av, t, None, None, s, None, "r", 1) for i, b, u, bv, av, t, s in rows]
    short = spark.createDataFrame(list(links), "short_url string, target_url string")
    return {(r["first_item_id"], r["item_id"]) for r in link_items(spark.createDataFrame(full, ITEM), short, steps).collect()}


def test_page_keys(spark):
    same = [
        "https://www.site-1.example/read?id=7&utm_source=x", "http://m.site-1.example:80/read/?from=a&id=7#top", "//SITE-1.example/read?id=7", "<site-1.example/read?id=7> ",
        "https://www.site-1.example:443:443/read?ref=1&id=7#comments",
    ]
    other = ["https://www.site-1.example/read?id=8", "https://www.site-1.example/Read?id=7", "https://www.site-1.example/read?id=7#/note/1", "https://www.site-2.example/read?id=7"]
    df = spark.createDataFrame([(u,) for u in same + other], "u string").coalesce(1)
    keys = [r[0] for r in with_page(df, "u", "k").select("k").collect()]
    assert len(set(keys[:5])) == 1 and len(set(keys)) == 5
    pair = spark.createDataFrame([("https://a.example/专栏/x-1",), ("https://a.example/%E4%B8%93%E6%A0%8F/x-1//",)], "u string")
    assert len({r["k"] for r in with_page(pair, "u", "k").collect()}) == 1


BV = ["BV9aaaaaaaa" + c for c in "ABC"]


def test_cases(spark):
    v = "https://www.hub.example/video/"
    rows = [
        (1, 1, v + BV[0], BV[0], "11", "t", "converted"),
        (2, 1, None, None, None, None, "converted"),
        (3, 1, None, "", " ", "", "converted"),
        (4, 2, v + BV[0] + "?p=2#reply3", None, None, "other", "failed"),
        (5, 2, v + "av11", None, None, None, "converted"),
        (6, 2, v + BV[0].lower().replace("bv", "BV"), None, None, "t", "converted"),
        (7, 2, None, None, "22", None, "failed"),
        (8, 3, None, None, "22", None, "converted"),
        (9, 3, None, None, "22", None, "skipped"),
        (10, 4, "https://t.example/abc", None, None, None, "converted"),
        (11, 4, "https://w.example/p/1", None, None, None, "converted"),
        (12, 5, "t.example/abc?from=x", None, None, "t", "failed"),
        (13, 6, None, "ＢＶ９ａａａａａａａａＢ", None, None, "converted"),
        (14, 7, None, None, "33", None, "converted"),
        (15, 8, None, BV[1], "33", None, "converted"),
    ]
    links = [("https://t.example/abc", "https://www.w.example/p/1?utm_medium=feed"), (None, "x")]
    # That 13 and 14 are one video is told by 15 only, in a later batch.
    want = {(1, 4), (1, 5), (8, 9), (10, 11), (10, 12), (13, 15)}
    for n in (1, 4):
        assert run(spark, rows, links, n) == want
    assert run(spark, [], links) == set()


def test_hot_source_and_random_ids(spark):
    r = random.Random(5)
    rows = []
    for i in range(1, 300):
        k = 0 if r.random() < 0.35 else r.randrange(40)
        bv, av = f"BV9{k:09d}"[:12], str(1000 + k)
        shape = r.randrange(3)
        rows.append((i, i // 10, f"https://x.example/video/{bv}" if shape == 0 else None, bv if shape == 1 else None, av if shape == 2 or r.random() < 0.3 else None, None, r.choice(["converted", "failed"])))
    parent, first, want = {}, {}, set()

    def find(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for no in sorted({x[1] for x in rows}):
        own = [(i, [k for k in (u or bv and "b" + bv, av and "a" + av) if k], status) for i, b, u, bv, av, _, status in rows if b == no]
        own = [(i, [k.replace("https://x.example/video/", "b") for k in keys], status) for i, keys, status in own]
        for _, keys, _ in own:
            for k in keys[1:]:
                a, b = find(keys[0]), find(k)
                if a != b:
                    parent[b] = a
                    first[a] = min(first.get(a, 10**9), first.pop(b, 10**9))
        for i, keys, status in own:
            if keys and status == "converted":
                first[find(keys[0])] = min(first.get(find(keys[0]), 10**9), i)
        want |= {(first[find(keys[0])], i) for i, keys, _ in own if keys and first.get(find(keys[0]), 10**9) < i}
    assert run(spark, rows) == want


def batch(spark, rows):
    """``(item_id, batch_no, bvid, avid, title, author, mid)``, all accepted."""
    full = [(i, b, None, bv, av, t, au, m, "converted", None, "r", 1) for i, b, bv, av, t, au, m in rows]
    return identities(spark.createDataFrame(full, ITEM), spark.createDataFrame([], "short_url string, target_url string"))


def bv(k):
    return f"BV9{k:09d}"


def test_a_link_reads_and_writes_as_much_however_long_the_history_is(spark):
    def cost(size):
        history = History(spark, block_keys=20)
        history.link(batch(spark, [(i, 1, bv(i), str(i), None, None, None) for i in range(1, size + 1)]))
        got = {r["item_id"]: r["first_item_id"] for r in history.link(batch(spark, [(10**6 + i, 2, bv(i * 7), None, None, None, None) for i in range(1, 5)])).collect()}
        assert got == {10**6 + i: i * 7 for i in range(1, 5)}
        return history.costs[-1]

    small, large = cost(400), cost(4000)
    assert small["rows_read"] <= 8 * 40 and large["rows_read"] <= 1.6 * small["rows_read"] and large["rows_read"] < 8000 / 20
    assert large["rows_written"] == small["rows_written"] == 0 and large["rows_merged"] == 0


def test_the_score_decides_whether_a_shared_key_links(spark):
    rows = [(i, 1, bv(i % 150), str(i % 150), f"t{i % 150}", f"w{i % 150}", str(i % 150)) for i in range(1, 301)]
    planted = [
        (1001, 2, bv(901), "7", "other", "someone", "888"),  # an id typed wrong: all else differs
        (1002, 2, bv(902), "8", "t8", "w8", "8"),  # one id differs, but title, author and uploader agree
        (1003, 2, None, "9", "other", "someone", "888"),  # nothing contradicts the id
    ]
    history = History(spark)
    history.link(batch(spark, rows))
    got = {r["item_id"]: (r["first_item_id"], r["score"]) for r in history.link(batch(spark, planted)).collect()}
    assert got[1001][0] is None and got[1002][0] == 8 and got[1003][0] == 9 and got[1002][1] > 0 and got[1003][1] > 0
    loose = History(spark, threshold=-1e9)
    loose.link(batch(spark, rows))
    assert {r["item_id"]: r["first_item_id"] for r in loose.link(batch(spark, planted)).collect()} == {1001: 7, 1002: 8, 1003: 9}
    flat = History(spark)
    flat.weights = dict.fromkeys(history.weights, (1.0, 1.0))
    flat.link(batch(spark, rows))
    assert {r["item_id"]: r["first_item_id"] for r in flat.link(batch(spark, planted)).collect()}[1001] == 7


LATE = [(1, 1, bv(1), None, None, None, None), (2, 2, None, "1", None, None, None), (3, 3, bv(1), "1", None, None, None), (4, 4, None, "1", None, None, None), (5, 4, bv(2), None, None, None, None)]


def test_a_result_rests_on_evidence_up_to_its_own_batch(spark):
    one = History(spark)
    apart = {r["item_id"]: r["first_item_id"] for n in range(1, 5) for r in one.link(batch(spark, [x for x in LATE if x[1] == n])).collect()}
    together = {r["item_id"]: r["first_item_id"] for r in History(spark).link(batch(spark, LATE)).collect()}
    assert apart == together == {1: None, 2: None, 3: 1, 4: 1, 5: None}


def test_another_process_goes_on_from_the_written_state(spark):
    first = History(spark)
    first.link(batch(spark, LATE[:3]))
    again = History(spark, first.path)
    assert again.seq == first.seq and again.segments == first.segments and again.weights == first.weights
    assert {r["item_id"]: r["first_item_id"] for r in again.link(batch(spark, LATE[3:])).collect()} == {4: 1, 5: None}


def test_every_item_comes_out_once(spark):
    rows = [(i, i // 5, None if i % 4 else f"https://w.example/{i % 6}", None, None, None, None, None, "converted", None, "r", 1) for i in range(40)] + [(50, None, None, bv(1), None, None, None, None, "failed", None, "r", 1)]
    out = split_batches(spark.createDataFrame(rows, ITEM), spark.createDataFrame([], "short_url string, target_url string"))
    assert out.count() == 41 and out.where(F.col("first_item_id").isNotNull()).count() == 7
