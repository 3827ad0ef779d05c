import collections

import numpy as np

from notefold.llm.mix import mix_sources, pivot
from notefold.llm.pack import SumOfSquares, fill_report, pack_texts


def slow_place(counts, size, capacity):
    """Growth of the sum of squares for every level, by recounting."""
    best = None
    for level in [h for h in range(capacity - 1, 0, -1) if counts[h] and h + size <= capacity] + [0]:
        c = counts.copy()
        if level:
            c[level] -= 1
        if level + size < capacity:
            c[level + size] += 1
        cost = (c[1:capacity] ** 2).sum() - (counts[1:capacity] ** 2).sum()
        if best is None or cost < best[0]:
            best = (cost, level)
    return best


def test_rule_against_recounting():
    rng = np.random.default_rng(3)
    packer, fills = SumOfSquares(50), collections.Counter()
    for size in rng.integers(1, 51, 400):
        cost, _ = slow_place(packer.counts, int(size), 50)
        before = (packer.counts[1:50] ** 2).sum()
        fills[packer.place(int(size))] += int(size)
        assert (packer.counts[1:50] ** 2).sum() - before == cost
    assert max(fills.values()) <= 50
    assert collections.Counter(v for v in fills.values() if v < 50) == {h: n for h, n in enumerate(packer.counts) if n}


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, bin int, size string").repartition(5)


def test_packing(spark):
    rows = [(i, "word " * (1 + i * 7 % 90), "a", 1, "x") for i in range(400)] + [(1000, "long " * 1000, "a", 1, "x"), (1001, None, "a", 1, "x"), (1002, "", "a", 1, "x")]
    got = pack_texts(docs(spark, rows), 128).collect()
    fills, tokens = collections.Counter(), collections.Counter()
    for r in got:
        tokens[r["doc_id"]] += r["n_tokens"]
        if r["container"] is not None:
            fills[r["container"]] += r["n_tokens"]
    assert len({(r["doc_id"], r["piece_no"]) for r in got}) == len(got) and {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert max(fills.values()) <= 128 and sum(fills.values()) == sum(tokens.values())
    assert {r["doc_id"] for r in got if r["n_pieces"] > 1} == {1000}
    assert [r["container"] for r in got if r["doc_id"] in (1001, 1002)] == [None, None]
    report = fill_report(pack_texts(docs(spark, rows), 1024), 1024).first()
    assert report["n_containers"] <= -(-report["n_tokens"] // 1024) + 1
    assert pack_texts(docs(spark, []), 128).count() == 0


def test_pivot_keeps_mass():
    for seed in range(50):
        a, b = (1, 30, 0.3), (2, 50, 0.6)
        settled, left = pivot(a, b, seed)
        sizes, shares = {1: 30, 2: 50}, dict(settled)
        if left:
            shares[left[0]] = left[2]
        assert abs(sum(sizes[d] * s for d, s in shares.items()) - (9 + 30)) < 1e-6 and len(settled) >= 1


def test_mix(spark):
    rows = [(i, "word " * (5 + i % 40), "a" if i % 3 else "b", 1, "x") for i in range(900)] + [(5000, "tiny", "c", 1, "x"), (5001, None, None, 1, "x"), (5002, None, "a", 1, "x")]
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.4, 3), ("c", 0.2, 2), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix_sources(docs(spark, rows), targets)
    got = {r["source"]: r for r in report.collect()}
    assert {s for s, r in got.items() if not r["reachable"]} == {"c", "none"}
    for s in ("a", "b"):
        assert abs(got[s]["mixed_tokens"] - got[s]["wanted_tokens"]) < 60
    picked = mixed.collect()
    most = {"a": 2, "b": 3, "c": 2}
    assert all(1 <= r["copies"] <= most[r["source"]] for r in picked) and len({r["doc_id"] for r in picked}) == len(picked)
    total = collections.Counter()
    for r in picked:
        total[r["source"]] += r["copies"] * r["n_tokens"]
    assert total == {s: r["mixed_tokens"] for s, r in got.items() if r["mixed_tokens"]}
    empty, report = mix_sources(docs(spark, []), targets)
    assert empty.count() == 0 and report.where("reachable").count() == 0


def test_the_result_does_not_depend_on_how_the_table_is_stored(spark, monkeypatch):
    import notefold.llm.mix as mix
    import notefold.llm.pack as pack

    monkeypatch.setattr(pack, "TEXTS_PER_TASK", 100)
    monkeypatch.setattr(mix, "RECORDS_PER_TASK", 100)
    df = spark.createDataFrame([(i, "word " * (i * 37 % 90 + 1), "ab"[i % 2]) for i in range(400)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 2)], "source string, target_share double, max_repeats int")
    stored = [df.coalesce(1), df.repartition(7, "text")]
    a, b = ({(r["doc_id"], r["piece_no"]): r["container"] for r in pack.pack_texts(d, 64).collect()} for d in stored)
    assert a == b
    a, b = ({r["doc_id"]: r["copies"] for r in mix.mix_sources(d, targets)[0].collect()} for d in stored)
    assert a == b
