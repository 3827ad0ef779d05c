import random

import pytest

from notefold.llm.split import pieces, split_texts


def text(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(["word ", "句子。", "End. ", "\n", "\n\n", "\n# Head\n", "x", "😀", "\r\n"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(12))
def test_pieces_cover_the_text_within_the_limit(seed):
    t = text(400, seed)
    spans = pieces(t, 200, 40)
    assert all(b - a <= 200 for a, _, b in spans)
    assert "".join(t[own:b] for _, own, b in spans) == t
    for (_, _, end), (start, own, _) in zip(spans, spans[1:]):
        assert own == end and start == end - 40


def test_strongest_boundary_wins():
    t = "a" * 90 + "\n\n" + "b. " * 3 + "c" * 40 + "\n# H\n" + "d" * 60
    spans = pieces(t, 150, 10)
    assert any(t[own:].startswith("# H") for _, own, _ in spans)


def test_limits_are_checked():
    with pytest.raises(ValueError):
        pieces("x", 10, 5)


def test_cases(spark):
    rows = [("note", 1, "x" * 500), ("note", 1, "x" * 500), ("note", 2, ""), ("note", 3, None), ("other", 4, "y" * 500), (None, 5, "z")]
    items = spark.createDataFrame([(*r, 9) for r in rows], "item_kind string, item_id bigint, text string, size_limit int")
    limits = spark.createDataFrame([("note", 200, 40)], "item_kind string, size_limit bigint, overlap bigint")
    got = split_texts(items.select("item_kind", "item_id", "text"), limits).collect()
    by = {}
    for r in got:
        by.setdefault(r["item_id"], []).append(r)
    assert len(by[1]) % 2 == 0 and len(by[1]) > 2 and 3 not in by
    assert [r["text"] for r in by[2]] == [""] and len(by[4]) == 1 and len(by[5]) == 1
    assert split_texts(items.limit(0).select("item_kind", "item_id", "text"), limits).count() == 0


def test_more_kinds_than_a_broadcast_takes(spark, monkeypatch):
    import notefold.llm.split as split

    kinds = [(f"k{i}", 8, 2) for i in range(1500)]
    items = spark.createDataFrame([(k, i, "x" * 20) for i, (k, _, _) in enumerate(kinds)], "item_kind string, item_id bigint, text string")
    limits = spark.createDataFrame(kinds, "item_kind string, size_limit bigint, overlap bigint")
    assert split.split_texts(items, limits).where("n_pieces = 1").count() == 0
    monkeypatch.setattr(split, "small", lambda df, rows: df)  # the shuffled join gives the same
    assert split.split_texts(items, limits).where("n_pieces = 1").count() == 0
