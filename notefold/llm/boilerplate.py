"""Main content of web pages without their boilerplate.

A page that was turned into Markdown is read back as a tree: page, sections (from one heading to the next), blocks (runs of
lines without a blank one), lines. Every section, block and line is a node with features of its text, markup and links, of
its subtree's density and depth, its place and its siblings. Boosted trees score the nodes. A decoding over the whole tree
then picks the best labels without contradiction: what lies in a dropped node is dropped, a kept node keeps something.

There are no labelled pages. The trees are fitted on a sample of at most ``SAMPLE_PAGES`` pages with weak labels that know no
vocabulary: a line that other pages of the sample show too is furniture, and so are bare lists under one and blocks of nothing
but links; prose that no other page shows, code and quotes are content; the rest has no label. What words tell is learned
from those labels, for each half of the sample from the other one. Neither the repetition nor the labels are features, so
what the trees know they apply to lines that no other page shows. Fitting apart, every page is read once, by itself.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.llm.trees import BoostedTrees
from notefold.session import bounded_batches, spread

#: Pages that the trees are fitted on at most, code points read of each of them, and pages of the sample from which on a line repeats.
SAMPLE_PAGES, SAMPLE_POINTS, REPEATS = 800, 200_000, 3

_OWN = re.compile(r"^\s*(?:#\s|##\s*原文抽取\s*$)")
_LINK = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")
_ENDS = re.compile(r"(?<![.…])[。！？.!?；;：:][\"'”’」』)）*_]*$")
_SENTENCE = re.compile(r"[。！？；]|[.!?;](?:\s|$)")
_SEPARATED = re.compile(r"\s[|/·>»•]\s|\s{2,}|[,，、]\s*|\s#")
_ITEM = re.compile(r"^(?:[-*+]\s+|\d{1,3}[.)、]?\s+)")
_DATED = re.compile(r"\d{4}-\d{1,2}-\d{1,2}$")
_WORD = re.compile(r"[A-Za-z][A-Za-z'-]*|[一-鿿]")
_FIGURED = re.compile(r"[A-Za-z]*-?\d[A-Za-z0-9_-]*")
_PIECE = re.compile(r"[a-z][a-z']+|[一-鿿]+|[^\w\s]")
KINDS = ("text", "heading", "bold", "bullet", "number", "quote", "fence", "code", "table")


def _pieces(line: str) -> set[str]:
    """What a line says, as a set: words, pairs of Chinese signs, punctuation."""
    out = set()
    for m in _PIECE.findall(line.lower()):
        out |= {m[i : i + 2] for i in range(len(m) - 1)} if "一" <= m[0] <= "鿿" and len(m) > 1 else {m}
    return out


def _shown(line: str) -> str:
    """A line as other pages may show it too: without markup, addresses and whatever has a figure."""
    return _FIGURED.sub("0", _ITEM.sub("", _LINK.sub(r"\1", line)).strip("#>* ").lower())


class Page:
    """Lines, blocks, sections and node features of a page's Markdown."""

    def __init__(self, text: str):
        self.lines, self.number = [], []
        for i, line in enumerate(text.split("\n"), 1):
            if line.strip():
                self.lines.append(line.strip())
                self.number.append(i)
        self.kind, self.block = [], []
        code, block, last = False, -1, -2
        for line, no in zip(self.lines, self.number):
            if no != last + 1 and not code or block < 0:
                block += 1
            last = no
            self.block.append(block)
            if line.startswith(("```", "~~~")):
                self.kind.append("fence")
                code = not code
            elif code:
                self.kind.append("code")
            elif line.startswith("#") and re.match(r"#{1,6}\s", line):
                self.kind.append("heading")
            elif line.startswith(">"):
                self.kind.append("quote")
            elif re.fullmatch(r"\*\*[^*]+\*\*", line):
                self.kind.append("bold")
            elif re.match(r"[-*+]\s", line):
                self.kind.append("bullet")
            elif re.match(r"\d{1,3}[.)、]?\s", line):
                self.kind.append("number")
            elif line.startswith("|"):
                self.kind.append("table")
            else:
                self.kind.append("text")
        self.blocks = [[] for _ in range(block + 1)]
        for i, b in enumerate(self.block):
            self.blocks[b].append(i)
        self.sections: list[list[int]] = []  # blocks of each
        for k, members in enumerate(self.blocks):
            if not self.sections or self.kind[members[0]] in ("heading", "bold"):
                self.sections.append([])
            self.sections[-1].append(k)

    def own(self, i: int) -> bool:
        """A heading of the note itself, which is never part of the page."""
        return self.number[i] <= 8 and self.kind[i] == "heading" and bool(_OWN.match(self.lines[i]))

    def features(self, weights: dict[str, float]) -> np.ndarray:
        """Features of the lines, then of the blocks, then of the sections; ``weights`` is what each piece of a line tells."""
        n, own = len(self.lines), 26 + len(KINDS)
        base = np.zeros((n, own))
        for i, (line, kind) in enumerate(zip(self.lines, self.kind)):
            links = _LINK.findall(line)
            shown = _LINK.sub(r"\1", line) if links else line
            bare = _ITEM.sub("", shown.strip("#> *"))
            size = len(bare)
            words = _WORD.findall(bare)
            latin = [w for w in words if w[0].isascii()]
            told = sorted(weights.get(p, 0.0) for p in _pieces(shown)) or [0.0]
            base[i, :26] = (
                size,
                len(words),
                len(links),
                sum(len(t) for t, _ in links) / max(1, size),
                sum(u.startswith(("/", "#")) for _, u in links),
                max((u.count("/") for _, u in links), default=0),
                bool(_ENDS.search(line)),
                len(_SENTENCE.findall(bare)),
                len(_SEPARATED.findall(shown)),
                sum(c.isdigit() for c in bare) / max(1, size),
                sum(w[0].isupper() for w in latin) / max(1, len(latin)),
                bool(latin) and latin[0][0].isupper(),
                bool(_DATED.search(bare)),
                line.count("#"),
                len(line) - len(line.lstrip("#")),
                size / max(1, len(words)),
                bool(re.search(r"[：:]", bare)),
                line.endswith((">>", "…", "......", "……")),
                line[:1] in "【[(（",
                self.number[i] - (self.number[i - 1] if i else 0),
                told[-1],
                told[0],
                sum(told) / len(told),
                sum(told),
                sum(t > 1 for t in told) / len(told),
                len(self.blocks[self.block[i]]),
            )
            base[i, 26 + KINDS.index(kind)] = 1
        if not n:
            return np.zeros((0, 2 * own + 20))
        groups = [*self.blocks, *([i for k in ks for i in self.blocks[k]] for ks in self.sections)]
        mean = np.array([base[g].mean(0) for g in groups])
        blocks, sections = mean[: len(self.blocks)], mean[len(self.blocks) :]
        look = [0, 3, 6, 7, 20, 22]  # size, links, endings, sentences, what words tell

        def around(rows: np.ndarray) -> np.ndarray:
            edge = np.zeros((1, len(look)))
            return np.hstack((np.vstack((edge, rows[:-1, look])), np.vstack((rows[1:, look], edge))))

        def placed(rows: np.ndarray, level: int, parent: np.ndarray) -> np.ndarray:
            at = np.arange(len(rows))
            place = np.stack((at / len(rows), np.minimum(at, 30), np.minimum(len(rows) - 1 - at, 30)), 1)
            inside = np.array([parent.tolist().index(p) for p in parent]) if len(parent) < 2 else at - np.maximum.accumulate(np.where(np.append(True, parent[1:] != parent[:-1]), at, 0))
            kinds = np.tile(np.eye(3)[level], (len(rows), 1))
            return np.hstack((around(rows), place, inside[:, None], kinds, np.full((len(rows), 1), len(self.sections))))

        of_block = np.array([self.block[i] for i in range(n)])
        of_section = np.array([k for k, ks in enumerate(self.sections) for _ in ks])
        return np.vstack(
            (
                np.hstack((base, blocks[of_block], placed(base, 0, of_block))),
                np.hstack((blocks, sections[of_section], placed(blocks, 1, of_section))),
                np.hstack((sections, np.tile(base.mean(0), (len(sections), 1)), placed(sections, 2, np.zeros(len(sections), int)))),
            )
        )

    def weak(self, pages: Counter) -> np.ndarray:
        """Labels of the lines: 1 furniture, 0 content, -1 unknown. ``pages`` counts the pages of the sample that show a line."""
        out = np.full(len(self.lines), -1)
        seen = [pages[_shown(line)] for line in self.lines]
        fixed = [self.kind[i] in ("fence", "code", "quote") or self.own(i) for i in range(len(self.lines))]
        ends = [bool(_ENDS.search(line)) for line in self.lines]
        size = [len(_LINK.sub(r"\1", line)) for line in self.lines]
        linked = [sum(len(t) for t, _ in _LINK.findall(line)) > 0.7 * len(_ITEM.sub("", _LINK.sub(r"\1", line))) for line in self.lines]
        said = [len(_WORD.findall(line)) for line in self.lines]
        bare = [not e and k in ("text", "bullet", "number") and z < 60 for e, k, z in zip(ends, self.kind, size)]
        for k, members in enumerate(self.blocks):
            again = [i for i in members if seen[i] >= REPEATS and not fixed[i]]
            following = self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
            for at, i in enumerate(members):
                if fixed[i]:
                    out[i] = 0
                elif seen[i] >= REPEATS:
                    out[i] = 1
                elif bare[i] and (members[0] in again and at or len(again) * 2 >= len(members)):
                    out[i] = 1
                elif linked[i] and len(members) > 1 and all(linked[j] or bare[j] for j in members):
                    out[i] = 1
                elif ends[i] and not again and said[i] >= 4 and self.kind[i] in ("text", "bullet", "number"):
                    out[i] = 0
                elif self.kind[i] in ("heading", "bold") and len(members) == 1 and following is not None and ends[following] and said[following] >= 4 and seen[following] < REPEATS:
                    out[i] = 0
        return out


def decode(page: Page, line_score: np.ndarray, block_score: np.ndarray, section_score: np.ndarray | None = None) -> np.ndarray:
    """Lines to drop: the labels of the tree that agree best with the scores (log odds of furniture).

    From the leaves up, each node gets the best sum of a subtree that is dropped whole and of one that is kept with at least
    one child; from the root down the better of both is taken. The note's own headings are kept and stand outside the tree.
    """
    section_score = np.zeros(len(page.sections)) if section_score is None else section_score

    def kept(own: float, parts: list[tuple[float, float]]) -> tuple[float, list[bool]]:
        """Best value with a child kept, and which children are dropped; each child has its values ``(dropped, kept)``."""
        out = [d > k for d, k in parts]
        value = -own + sum(max(d, k) for d, k in parts)
        if all(out):
            least = min(range(len(parts)), key=lambda c: parts[c][0] - parts[c][1])
            out[least] = False
            value -= parts[least][0] - parts[least][1]
        return value, out

    drop = np.zeros(len(page.lines), bool)
    for section, ks in enumerate(page.sections):
        inner = []
        for k in ks:
            members = [i for i in page.blocks[k] if not page.own(i)]
            if members:
                value, out = kept(block_score[k], [(line_score[i], -line_score[i]) for i in members])
                inner.append((members, block_score[k] + sum(line_score[i] for i in members), value, out))
        if not inner:
            continue
        value, gone = kept(section_score[section], [(d, k) for _, d, k, _ in inner])
        whole = section_score[section] + sum(d for _, d, _, _ in inner) >= value
        for (members, _, _, out), dropped in zip(inner, gone):
            drop[members] = whole or dropped or np.array(out)
    return drop


def _weights(pages: list[Page], labels: list[np.ndarray]) -> dict[str, float]:
    """Log odds of furniture of each piece that stands in labelled lines of three pages at least."""
    counts, held, total = (Counter(), Counter()), Counter(), [0, 0]
    for page, label in zip(pages, labels):
        on_page = set()
        for i in np.flatnonzero(label >= 0):
            pieces = _pieces(_LINK.sub(r"\1", page.lines[i]))
            counts[label[i]].update(pieces)
            total[label[i]] += 1
            on_page |= pieces
        held.update(on_page)
    return {p: round(math.log((counts[1][p] + 0.5) / (total[1] + 1)) - math.log((counts[0][p] + 0.5) / (total[0] + 1)), 3) for p in sorted(held) if held[p] >= 3}


def _repetition(pages: list[Page]) -> Counter:
    """How many articles a line stands beside; pages with the same longest line are copies of one article."""
    beside: dict[str, set[str]] = {}
    for p in pages:
        article = max(p.lines, key=len)
        for line in p.lines:
            beside.setdefault(_shown(line), set()).add(article)
    return Counter({line: len(articles) for line, articles in beside.items()})


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    pages = [p for p in map(Page, rows["text"]) if p.lines]
    shown = _repetition(pages)
    labels = [p.weak(shown) for p in pages]
    halves = [_weights(pages[k::2], labels[k::2]) for k in (1, 0)]  # of the other half
    xs, ys = [], []
    for at, (page, y) in enumerate(zip(pages, labels)):
        x, n = page.features(halves[at % 2]), len(page.lines)
        groups = [*page.blocks, *([i for k in ks for i in page.blocks[k]] for ks in page.sections)]
        share = np.array([y[g].mean() if (y[g] >= 0).all() else -1 for g in groups])
        whole = np.flatnonzero((share == 0) | (share == 1))
        xs += [x[:n][y >= 0], x[n:][whole]]
        ys += [y[y >= 0], share[whole]]
    if not xs or not sum(map(len, ys)):
        return pd.DataFrame({"model": pd.Series([], dtype=str)})
    model = BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))
    return pd.DataFrame({"model": [json.dumps(model.dump() | {"weights": _weights(pages, labels)})]})


def fit_trees(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict | None:
    """Trees fitted in one task on at most ``sample`` pages, those whose ids hash lowest, of which ``SAMPLE_POINTS`` code points
    are looked at; null where no page has text."""
    chosen = pages.where("text is not null and trim(text) <> ''").orderBy(F.xxhash64("id"), "id").limit(sample).select(F.substring("text", 1, SAMPLE_POINTS).alias("text"), F.lit(0).alias("one"))
    rows = chosen.groupBy("one").applyInPandas(_fit, "model string").collect()
    return json.loads(rows[0][0]) if rows else None


def strip_boilerplate(pages: DataFrame, id_col: str = "note_id", text_col: str = "body", model: dict | None = None, keep: str = "boilerplate") -> DataFrame:
    """Lines of pages: ``id, line_no, line`` of what is boilerplate, or with ``keep="content"`` of what is not.

    Lines are counted from 1 between line feeds, blank ones included; blank ones are never returned. Null and blank pages
    have no lines; repeated rows give repeated lines; other columns are left out.
    """
    bounded_batches(pages.sparkSession)
    own = spread(pages, id_col).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    model = model or fit_trees(own)
    if model is None:
        return own.sparkSession.createDataFrame([], "id bigint, line_no int, line string")
    wanted = keep == "boilerplate"
    shared = own.sparkSession.sparkContext.broadcast(json.dumps(model))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = json.loads(shared.value)
        trees, weights = BoostedTrees.load(fitted), fitted["weights"]
        for batch in batches:
            read = [(i, Page(t)) for i, t in zip(batch["id"], batch["text"])]
            read = [(i, p) for i, p in read if p.lines]
            if not read:
                continue
            parts = [p.features(weights) for _, p in read]
            scores = np.split(trees.score(np.concatenate(parts)), np.cumsum([len(x) for x in parts])[:-1])
            rows = []
            for (i, page), s in zip(read, scores):
                n, m = len(page.lines), len(page.lines) + len(page.blocks)
                rows += [(i, no, line) for no, line, out in zip(page.number, page.lines, decode(page, s[:n], s[n:m], s[m:])) if out == wanted]
            yield pd.DataFrame(rows, columns=["id", "line_no", "line"])

    return own.where("text is not null").mapInPandas(label, "id bigint, line_no int, line string")
