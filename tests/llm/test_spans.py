import random

import numpy as np
import pytest

from notefold.llm import spans as S
from notefold.llm.fmindex import FMIndex, WaveletMatrix


def test_wavelet_rank_against_counting():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 23, 500)
    m = WaveletMatrix(s, 23)
    c, i = rng.integers(0, 23, 300), rng.integers(0, 501, 300)
    assert list(m.rank(c, i)) == [int((s[:b] == a).sum()) for a, b in zip(c, i)]


@pytest.mark.parametrize("depth", [3, 7, 8, 13])
def test_matching_statistics_against_windows(depth):
    for seed in range(6):
        r = random.Random(depth * 10 + seed)
        texts = [np.array([r.randrange(2 + seed % 3) for _ in range(r.randrange(1, 40))], np.uint32) for _ in range(12)]
        record = np.arange(12) // 2
        index = FMIndex.load(FMIndex.build(texts, record, record, depth).dump())
        holders = {}
        for i, t in enumerate(texts):
            for k in range(len(t) - depth + 1):
                holders.setdefault(tuple(t[k : k + depth]), set()).add(i)
        found = list(zip(*index.statistics(texts)))
        want = {(i, k) for i, t in enumerate(texts) for k in range(len(t) - depth + 1) if len({record[j] for j in holders[tuple(t[k : k + depth])]}) > 1}
        assert {(t, s) for t, s, _, _ in found} == want
        assert all(set(index.text_of[a:b]) == holders[tuple(texts[t][s : s + depth])] for t, s, a, b in found)
        others = [np.array([r.randrange(5) for _ in range(40)], np.uint32), np.concatenate((texts[0][:depth], [9], texts[5]))]  # 9 is no symbol of the index
        got = {(t, s) for t, s, _, _ in zip(*index.statistics(others, foreign=True))}
        assert got == {(i, k) for i, t in enumerate(others) for k in range(len(t) - depth + 1) if tuple(t[k : k + depth]) in holders}


def brute(rows, least):
    windows = {}
    for doc, t in rows:
        for i in range(len(t or "") - least + 1):
            windows.setdefault(t[i : i + least], set()).add(doc)
    pairs = {(a, b) for docs in windows.values() for a in docs for b in docs if a < b}
    shared = {}
    for doc, t in rows:
        hit = set()
        for i in range(len(t or "") - least + 1):
            if len(windows[t[i : i + least]]) > 1:
                hit |= set(range(i, i + least))
        shared[doc] = len(hit)
    return pairs, shared


def corpus(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdefgh 字词。😀") for _ in range(n))
    common = [word(r.randrange(20, 60)) for _ in range(4)] + ["ab" * 40, "z" * 70]
    rows = []
    for i in range(40):
        parts = [word(r.randrange(0, 50)) for _ in range(3)]
        for c in r.sample(common, r.randrange(0, 3)):
            a = r.randrange(len(c) // 2)
            parts.insert(r.randrange(len(parts)), c[a : a + r.randrange(15, 60)])
        rows.append((i, "".join(parts)))
    return [*rows, (100, rows[3][1]), (101, rows[3][1]), (102, ""), (103, None), (104, "short"), (105, common[0] * 3)]


@pytest.mark.parametrize("seed,shard", [(1, 1_000_000), (2, 4000), (3, 200)])
def test_against_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(S, "PAIR_MEMBERS", 2 if seed == 3 else 500)
    monkeypatch.setattr(S, "SHARD_SYMBOLS", shard)  # a small shard sends hot n-grams through their single windows
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, h string, place int").repartition(3)
    found = S.SharedSpans(df, 20)
    pairs, shared = brute(rows, 20)
    assert {(r[0], r[1]) for r in found.pairs().collect()} == pairs
    amounts = {r["doc_id"]: r["shared_chars"] for r in found.amounts().collect()}
    assert amounts == {d: n for d, n in shared.items() if len(dict(rows)[d] or "") >= 20}


def test_long_texts_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 300)
    r = random.Random(9)
    a, b = ("".join(r.choice("abcdef") for _ in range(2000)) for _ in range(2))
    rows = [(1, a + "Q" * 5 + b[1000:1030]), (2, b), (3, a[700:900])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(x[0], x[1]) for x in S.SharedSpans(df, 20).pairs().collect()} == brute(rows, 20)[0] == {(1, 2), (1, 3)}


def test_empty(spark):
    found = S.SharedSpans(spark.createDataFrame([], "doc_id bigint, text string"), 20)
    assert found.pairs().count() == 0 and found.spans().count() == 0 and found.amounts().count() == 0
