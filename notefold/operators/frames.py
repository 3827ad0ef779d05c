"""Choice of frames and moments: scoring of text blocks, spacing, nearest scene, usable fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notefold.functions.markdown import blocks
from notefold.functions.text import blank_as_null, strip

# Fixed value: words that mark a block as a point worth showing.
POINT = "核心|结论|原因|关键|风险|步骤|方法|对比|因此|意味着|建议|首先|其次|最后"
DEFAULT_HEADING = "内容要点"

_POINT = "array<struct<score:double,idx:int,heading:string,text:string>>"


def visible_part(markdown: Column) -> Column:
    """Without frontmatter, the frame section, and everything from the raw text on."""
    head = F.element_at(F.split(markdown, r"(?m)^##[^\S\n]+(?:原始字幕|完整原文|原文抽取)[^\S\n]*$|<details>", 2), 1)
    head = F.regexp_replace(head, r"(?s)\A---\n.*?\n---\n", "")
    return F.regexp_replace(head, r"(?s)(?:^|(?<=\n))##[^\S\n]+关键帧图文笔记[^\S\n]*(?=\n|\z).*?(?=\n##\s|\z)", "")


def scored_blocks(markdown: Column) -> Column:
    """Blocks of 18 signs or more with score, number and the heading above: ``ARRAY<STRUCT<score, idx, heading, text>>``."""
    plain = lambda b: strip(F.regexp_replace(F.regexp_replace(b, r"[`>*_\[\]()]", ""), r"\s+", " "))
    numbered = F.transform(blocks(visible_part(markdown)), lambda b, i: F.struct(i.alias("idx"), b.alias("b"), plain(b).alias("plain")))
    start = F.struct(F.lit(DEFAULT_HEADING).alias("heading"), F.array().cast(_POINT).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        is_heading, text = x["b"].startswith("#"), x["plain"]
        named = F.coalesce(blank_as_null(strip(F.regexp_replace(x["b"], r"^#+\s*", ""))), acc["heading"])
        score = F.least(F.length(text), F.lit(240)) / F.lit(80.0) + F.when(text.rlike(POINT), 2.0).otherwise(0.0) + F.when(text.rlike(r"\d|：|:"), 1.0).otherwise(0.0)
        point = F.struct(score.alias("score"), x["idx"].cast("int").alias("idx"), acc["heading"].alias("heading"), F.substring(text, 1, 110).alias("text"))
        out = F.when(is_heading | (F.length(text) < 18), acc["out"]).otherwise(F.concat(acc["out"], F.array(point)))
        return F.struct(F.when(is_heading, named).otherwise(acc["heading"]).alias("heading"), out.alias("out"))

    return F.aggregate(numbered, start, step, lambda acc: acc["out"])


def spaced_best(points: Column, n_blocks: Column, k: int) -> Column:
    """The ``k`` best points no two of which are closer than ``max(2, blocks / 2k)``, taken greedily, in order of place."""
    gap = F.greatest(F.lit(2), F.floor(n_blocks / F.lit(max(2 * k, 1))).cast("int"))
    ranked = F.reverse(F.array_sort(points))
    free = lambda acc, p: ~F.exists(acc, lambda q: F.abs(q["idx"] - p["idx"]) < gap)
    taken = F.aggregate(ranked, F.array().cast(_POINT), lambda acc, p: F.when((F.size(acc) < k) & free(acc, p), F.concat(acc, F.array(p))).otherwise(acc))
    return F.transform(F.array_sort(F.transform(taken, lambda p: F.struct(p["idx"].alias("idx"), p.alias("p")))), lambda x: x["p"])


def thinned(times: Column, gap: float, most: int) -> Column:
    """Ascending times, each kept if ``gap`` after the last one kept, ``most`` at most."""
    none = F.array().cast("array<double>")
    ok = lambda acc, t: (F.size(acc) < most) & F.coalesce(t - F.try_element_at(acc, F.lit(-1)) >= gap, F.lit(True))
    return F.aggregate(F.array_sort(times), none, lambda acc, t: F.when(ok(acc, t), F.concat(acc, F.array(t))).otherwise(acc))


def even_grid(duration: Column, k: int) -> Column:
    """``k`` times that divide the duration evenly; none for no duration."""
    step = duration / F.lit(float(k + 1))
    return F.when((duration > 0) & F.lit(k > 0), F.transform(F.sequence(F.lit(1), F.lit(max(k, 1))), lambda i: F.round(step * i, 2))).otherwise(F.array().cast("array<double>"))


def chosen_times(duration: Column, candidates: Column, k: int) -> Column:
    """At most ``k`` times, clear of both ends and well apart, filled up from an even grid."""
    gap = F.greatest(F.lit(8.0), duration / F.lit(float(max(k + 1, 2))) * 0.6)
    inside = F.filter(candidates, lambda t: (t >= 3.0) & (t <= F.greatest(F.lit(3.0), duration - 3.0)))
    none = F.array().cast("array<double>")
    ok = lambda acc, t: (F.size(acc) < k) & F.coalesce(t - F.try_element_at(acc, F.lit(-1)) >= gap, F.lit(True))
    first = F.aggregate(inside, none, lambda acc, t: F.when(ok(acc, t), F.concat(acc, F.array(F.round(t, 2)))).otherwise(acc))
    apart = lambda acc, t: (F.size(acc) < k) & ~F.exists(acc, lambda o: F.abs(t - o) < gap)
    full = F.aggregate(even_grid(duration, k), first, lambda acc, t: F.when(apart(acc, t), F.concat(acc, F.array(t))).otherwise(acc))
    return F.when(duration > 0, F.array_sort(full)).otherwise(none)


def nearest(target: Column, times: Column, reach: Column) -> Column:
    """The time nearest to ``target`` (the first of equals) if within ``reach``, else ``target``."""
    near = F.array_min(F.transform(times, lambda t, i: F.struct(F.abs(t - target).alias("d"), i.alias("i"), t.alias("t"))))
    return F.round(F.when(near["d"] <= reach, near["t"]).otherwise(target), 2)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"), lambda a: a / F.size(values))


def deviation_of(values: Column) -> Column:
    """Standard deviation of the population."""
    mean = mean_of(values)
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") - mean, 2.0), lambda a: a / F.size(values)))


def mean_delta(a: Column, b: Column) -> Column:
    """Mean absolute difference of two fingerprints."""
    return mean_of(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def usable_frames(frames: Column, k: int, size: int, dark: float, bright: float, least_deviation: float, least_delta: float, gap: float) -> Column:
    """Greedy choice over ``ARRAY<STRUCT<t DOUBLE, f ARRAY<...>>>`` in order of time: of full size, neither dark nor bright nor
    flat, unlike every frame kept, ``gap`` after the last; ``k`` at most. Returns the times."""
    none = F.slice(frames, 1, 0)
    fine = lambda f: (F.size(f) == size) & mean_of(f).between(dark, bright) & (deviation_of(f) >= least_deviation)

    def step(acc: Column, x: Column) -> Column:
        late = F.coalesce(x["t"] - F.try_element_at(acc, F.lit(-1))["t"] >= gap, F.lit(True))
        unlike = ~F.exists(acc, lambda o: mean_delta(o["f"], x["f"]) < least_delta)
        return F.when((F.size(acc) < k) & late & fine(x["f"]) & unlike, F.concat(acc, F.array(x))).otherwise(acc)

    return F.transform(F.aggregate(frames, none, step), lambda x: x["t"])
