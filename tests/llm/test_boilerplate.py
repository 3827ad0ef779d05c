import json
import random
from collections import Counter

import numpy as np
import pandas as pd

from notefold.llm.boilerplate import Page, _fit, _shown, decode, fit_trees, strip_boilerplate
from notefold.llm.trees import BoostedTrees

PARAGRAPHS = [
    "The second harbour was built when the first one had filled with sand, and it was twice as deep. Few ships used it at first.",
    "Nobody expected the survey to matter. Its authors had measured the wrong river; the figures were right all the same.",
    "浏览器的历史比多数人想的要长。最早的几个版本只能显示文字，图片要另外打开。后来的事大家都知道。",
    "这座桥在冬天关闭，因为风太大。村民只好绕路，多走两个小时。春天一到，桥又开放了。",
]
FURNITURE = ["Home | News | Jobs | Sign in", "[首页](/) · [专题](/t) · [登录](/l)", "312 views · 4 comments", "(c) 2024 Site-9. All rights reserved.", "This site uses cookies to remember your choices. [OK](#)", "扫码关注我们，领取资料包", "Back to top"]


def page(i):
    mark = "".join("abcdefghij"[int(c)] for c in str(i)) * 2
    body = [(f"In {mark} it was so: " if p[0].isascii() else f"{chr(0x5000 + 13 * i)}{chr(0x6000 + 7 * i)}记，") + p for p in (PARAGRAPHS[(i + k) % 4] for k in range(3))]  # articles differ
    related = "## Related reading\n1 On the Narrow Bridge\n2 The Quiet Harbour\n3 Why Rivers Move"
    return "\n\n".join(["# Title", FURNITURE[i % 7], *body[:2], "```text\nx = 1\n```", body[2], FURNITURE[(i + 3) % 7], related, FURNITURE[(i + 4) % 7]])


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = BoostedTrees(trees=30).fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0) == y[2000:]).mean() > 0.93
    assert np.allclose(BoostedTrees.load(model.dump()).score(x), model.score(x))


def test_decoding_has_no_contradiction():
    p = Page("# Title\n\na line\nb line\n\nc line")
    drop = decode(p, np.array([-1.0, 5.0, -0.1, -3.0]), np.array([0.0, 9.0, -9.0]))
    assert list(drop) == [False, True, True, False]
    kept = decode(p, np.array([-1.0, 2.0, 1.0, 2.0]), np.array([0.0, -9.0, -9.0]))
    assert list(kept) == [False, True, False, False]  # a kept block keeps a line


def test_decoding_keeps_something_at_every_level():
    p = Page("## One\n\na line\nb line\n\n## Two\n\nc line")
    lines = np.array([-0.5, 3.0, 4.0, -1.0, 2.0])
    assert p.sections == [[0, 1], [2, 3]]
    gone = decode(p, lines, np.zeros(4), np.array([9.0, 0.0]))
    assert list(gone) == [True, True, True, False, True]  # a dropped section takes its heading along
    kept = decode(p, lines, np.array([0.0, -9.0, 0.0, 0.0]), np.array([-9.0, 0.0]))
    assert list(kept) == [False, False, True, False, True]  # a kept block keeps the line that is least furniture


def test_trees_know_more_than_the_labels_they_are_fitted_on():
    """Held out: furniture that no page of the sample shows in this form."""
    r = random.Random(3)
    nonsense = ["".join(r.choice(c) for c in ("bdfgklm", "aeiou", "nrst", "aeiou", "lmnr")) for _ in range(300)]
    labels = ["Home", "News", "Jobs", "Forum", "Members", "Live", "About", "Enter"]
    fixed = [" | ".join(r.sample(labels, 5)) for _ in range(6)]
    said = lambda n: " ".join(r.choice(nonsense) for _ in range(n))
    sentences = lambda: f"{said(9).capitalize()}. {said(12).capitalize()}."

    def made(known):
        top = r.choice(fixed) if known else " | ".join(r.sample(labels, 6))
        notice = f"We store cookies for {r.choice(labels) if known else said(2)} and our partners; see our privacy page."
        related = [r.choice(["More to read", "Further on"])] if known else ["More on " + said(1)]
        related += [f"{said(3).title()} 2024-01-{r.randrange(10, 28)}" for _ in range(3)]
        junk = {top, notice, *related}
        return junk, "\n\n".join(["# " + said(3).title(), top, sentences(), "### " + said(3).title(), sentences(), notice, sentences(), "\n".join(related)])

    sample = [made(True)[1] for _ in range(150)]
    fitted = json.loads(_fit(pd.DataFrame({"text": sample}))["model"][0])
    shown = Counter(s for t in sample for s in {_shown(line) for line in Page(t).lines})
    trees, alone, forest, total = BoostedTrees.load(fitted), 0, 0, 0
    for _ in range(60):
        junk, text = made(False)
        p = Page(text)
        s, n = trees.score(p.features(fitted["weights"])), len(p.lines)
        drop, rule = decode(p, s[:n], s[n : n + len(p.blocks)], s[n + len(p.blocks) :]), p.weak(shown)
        for line, d, known in zip(p.lines, drop, rule):
            total, alone, forest = total + 1, alone + ((line in junk) == (known == 1)), forest + ((line in junk) == d)
    assert forest / total > 0.93 and forest > 1.2 * alone, (forest, alone, total)


def test_copies_of_a_page_are_no_repetition():
    text = page(1)
    fitted = _fit(pd.DataFrame({"text": [text] * 60 + [page(i) for i in range(2, 60)]}))
    trees, p = BoostedTrees.load(json.loads(fitted["model"][0])), Page(text)
    s, n = trees.score(p.features(json.loads(fitted["model"][0])["weights"])), len(p.lines)
    drop = decode(p, s[:n], s[n : n + len(p.blocks)], s[n + len(p.blocks) :])
    assert not any(d for line, d in zip(p.lines, drop) if len(line) > 60 or "年" in line) and drop.sum() >= 5


def test_pages(spark):
    rows = [(i, page(i), "x") for i in range(80)] + [(900, None, "x"), (901, " \n ", "x"), (902, PARAGRAPHS[0] * 400, "x")]
    df = spark.createDataFrame(rows, "note_id bigint, body string, line string")
    found = {}
    for r in strip_boilerplate(df).collect():
        found.setdefault(r["id"], set()).add(r["line"])
    right = wrong = 0
    for i in range(80):
        for line in page(i).split("\n"):
            if line.strip():
                junk = line in FURNITURE or line[:2] in ("1 ", "2 ", "3 ") or "Related" in line
                right, wrong = right + (junk == (line in found.get(i, ()))), wrong + (junk != (line in found.get(i, ())))
    assert right / (right + wrong) > 0.98
    assert not {900, 901, 902} & set(found)
    assert strip_boilerplate(df.limit(0)).count() == 0 and fit_trees(df.select("note_id", "body").toDF("id", "text").limit(0)) is None
