"""Repair of text recognised from scanned pages.

Three passes. (1) JVM only: the outermost lines of every page are compared over all pages of their source; what returns on
other pages or repeats a chapter's title is a running head, numbers that keep their distance to the page are page numbers.
(2) Counts of word pairs and of character confusions over all pages, pre-aggregated in each batch. (3) Noisy channel: words
the lexicon lacks become candidate words, weighed by confusion probability times pair likelihood and decoded by Viterbi per
line (English) or clause (Chinese, which has no spaces, over a lattice of lexicon words). Words cut at a line's end are
joined with the next body line, also over the page's edge: pages get their neighbours' edge lines by an equal join on
(source, backend, page), so no task ever holds a whole source.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notefold.session import bounded_batches, materialise, small, spread

#: Outermost lines of a page that are looked at; rows up to which a side table is broadcast; words a lexicon may have.
EDGE, BROADCAST_ROWS, MAX_WORDS = 3, 100_000, 20_000

#: What it costs more to doubt a word of the lexicon than one outside it, and the channel cost beyond which it isn't doubted.
DOUBT, MOST_DOUBT = 2.0, 12.0

#: The pairs and confusions, the most frequent ones, that a model holds at most, and pages of a paragraph put into one row.
MAX_PAIRS, MAX_CONFUSIONS, PART_PAGES = 2_000_000, 200_000, 64

# Signs that cut a word at a line's end, and shapes that printing and recognition confuse (for comparing
# running heads only; the channel's confusions are learned).
CUTS = "-¬­‐–‑"
STOPS = "，。、；：！？"
SHAPES = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("1", "l"), ("i", "l"), ("0", "o"), ("a", "o"), ("5", "s"), ("9", "g"), ("f", "t"), ("c", "e"), ("b", "h"))

_DIGIT = "[0-9OolISsBZgqi|]"
_NUMBER = rf"(?:[0-9]{_DIGIT}{{0,4}}|{_DIGIT}{{1,3}}[0-9]{_DIGIT}{{0,2}}|[ivxlcIVXLC1|]{{1,7}}|[OolI|]{{2,4}})"
PAGE_NO = rf"^\s*(?:([\[(（—·\-–~<]+\s*)?({_NUMBER})(\s*[\])）—·\-–~>]+)?(?:\s*/\s*{_NUMBER})?|(?:[Pp](?:age|\.)|PAGE|[Pp].{{2,3}})\s*{_NUMBER}|第\s*{_NUMBER}\s*[页頁])\s*$"
HAN_CHAPTER = r"^\s*第\s*\S{1,4}?\s*章"
NUMBERED = r"^\s*(\S+)\s+\S{1,4}\s+\S"
#: A heading's first word, and by how many edits it may be misread.
CHAPTER_WORD, CHAPTER_EDITS = "chapter", 2
_CJK = re.compile(r"[一-鿿]")
_TOKEN = re.compile(rf"[^\s.,;:!?()\[\]\"“”。，；：！？（）%/·—]+")


def is_chapter(line: Column) -> Column:
    """Whether a line is the heading where a chapter starts."""
    word = F.lower(F.regexp_extract(line, NUMBERED, 1))
    return line.rlike(HAN_CHAPTER) | ((word != "") & (F.levenshtein(word, F.lit(CHAPTER_WORD)) <= CHAPTER_EDITS))


@lru_cache(10_000)
def _like_chapter(word: str) -> bool:
    return abs(len(word) - len(CHAPTER_WORD)) <= CHAPTER_EDITS and len(_edits(word, CHAPTER_WORD)) <= CHAPTER_EDITS


def starts_chapter(line: str) -> bool:
    """``is_chapter`` of one line."""
    m = re.match(NUMBERED, line)
    return bool(m and _like_chapter(m.group(1).lower())) or re.match(HAN_CHAPTER, line) is not None


def _skeleton(line: Column) -> Column:
    """What is left of a line when its page number, spaces and confusable shapes are evened out."""
    bare = F.regexp_replace(F.regexp_replace(line, rf"^\s*{_NUMBER}\s{{2,}}", ""), rf"\s{{2,}}{_NUMBER}\s*$", "")
    bare = F.regexp_replace(F.lower(bare), r"[\s\p{Punct}，。：；·—]+", "")
    for seen, meant in SHAPES:
        bare = F.regexp_replace(bare, seen, meant)
    return bare


def page_edges(pages: DataFrame) -> DataFrame:
    """The outermost non-blank lines of every page, with ``kind`` header, page_no or null for body lines."""
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
    full = F.filter(numbered, lambda x: F.trim(F.regexp_replace(x["line"], r"[\s　]+", " ")) != "")
    wide = F.array_max(F.transform(full, lambda x: F.length(F.trim(x["line"]))))
    n = F.size("full")
    edges = pages.withColumn("full", full).withColumn("wide", wide).where(n > 0).select(
        "page_id", "source", "backend", "page", "wide", n.alias("n"), F.posexplode("full").alias("at", "x")
    ).where((F.col("at") < EDGE) | (F.col("at") >= F.col("n") - EDGE))
    edges = edges.select(
        "page_id", "source", "backend", "page", "wide", "n", "at", "x.line_no", "x.line",
        F.least("at", F.col("n") - 1 - F.col("at")).alias("depth"),
        _skeleton(F.col("x.line")).alias("skeleton"),
        F.col("x.line").rlike(PAGE_NO).alias("number"),
        is_chapter(F.col("x.line")).alias("chapter"),
    )
    digits = F.regexp_extract("line", rf"({_NUMBER})", 1)
    style = F.regexp_replace("line", rf"{_NUMBER}|\s+", "")
    value = F.translate(digits, "OolISsBZgqi|", "001155829911").try_cast("int")
    edges = materialise(
        edges.withColumn("style", F.when(F.col("number"), style)).withColumn("offset", F.when(F.col("number") & F.lower(digits).rlike("[0-9]"), value - F.col("page"))), "edges"
    )
    titles = edges.where("chapter").select("source", F.regexp_replace(F.col("line"), r"^\s*(?:\S+\s+\S{1,4}\s+|第\s*\S{1,4}?\s*章\s*)", "").alias("title"))
    titles = titles.select("source", _skeleton(F.col("title")).alias("skeleton")).where("length(skeleton) > 3").distinct().withColumn("titled", F.lit(True))
    again = edges.where("not number and depth < 2 and length(skeleton) > 3").groupBy("source", "skeleton").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.max("chapter").alias("any_chapter")
    )
    offsets = edges.where("number and depth < 2 and offset is not null").groupBy("source", "style", "offset").agg((F.min("page") < F.max("page")).alias("steady"))
    styles = edges.where("number and depth < 2").groupBy("source").agg(F.max(F.length("style")).alias("decorated"))
    told = (
        edges.join(small(titles, BROADCAST_ROWS), ["source", "skeleton"], "left")
        .join(small(materialise(again.where("first_page < last_page"), "again"), BROADCAST_ROWS), ["source", "skeleton"], "left")
        .join(small(materialise(offsets.where("steady"), "offsets"), BROADCAST_ROWS), ["source", "style", "offset"], "left")
        .join(small(materialise(styles, "styles"), BROADCAST_ROWS), "source", "left")
    )
    roman = F.col("line").rlike(r"^\s*[\[(]?[ivxlcIVXLC1|]+[\])]?\s*$") & F.col("line").rlike("[ivxlIVXL|]")
    plain = F.col("style") == ""
    is_no = F.col("number") & (F.col("depth") < 2) & (F.col("steady") | roman | ~plain | ((F.col("depth") == 0) & (F.col("decorated") == 0) & ~F.col("line").rlike("[.,%]")))
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", rf"^\s*{_NUMBER}\s{{2,}}", ""), rf"\s{{2,}}{_NUMBER}\s*$", ""))
    words, capital = F.regexp_count(bare, F.lit(r"[A-Za-z][A-Za-z\-]*")), F.regexp_count(bare, F.lit(r"(?<![A-Za-z\-])[A-Z0-9]"))
    open_end = ~bare.rlike(r"[.。,，;；!！?？:：、]$") & ~bare.rlike(rf"[{CUTS}]\s*$")
    numbered_line = bare != F.trim(F.col("line"))
    latin = (words >= 3) & (capital >= 0.5 * words) & ~bare.rlike(r"\. ")
    chinese = bare.rlike("[一-鿿]") & (F.length(bare) < 0.75 * F.col("wide")) & (F.length(bare) >= 4) & ~bare.rlike("[，。！？]")
    shaped = open_end & (latin | chinese)
    unbroken = bare.rlike("[一-鿿]") & ~bare.rlike("[，。！？]")
    repeated = F.col("last_page").isNotNull() & open_end & (latin | unbroken | ~bare.rlike("[a-z一-鿿]") | (F.length(bare) < 0.75 * F.col("wide")))
    starts = F.col("chapter") & (F.col("first_page").isNull() | (F.col("page") == F.col("first_page")))
    is_header = ~F.col("number") & (F.col("depth") < 2) & ~starts & (F.coalesce(F.col("titled"), F.lit(False)) | repeated | shaped | (numbered_line & (latin | bare.rlike("[一-鿿]")) & open_end))
    kind = F.when(is_no, "page_no").when(is_header, "header")
    # A second line counts only behind a first one that is a head, foot or number itself.
    told = told.withColumn("kind", kind)
    side = F.when(F.col("at") < EDGE, 0).otherwise(1)
    outer = F.max(F.when((F.col("depth") == 0) & F.col("kind").isNotNull(), 1)).over(Window.partitionBy("page_id", side))
    sure = (F.col("depth") == 0) | (outer == 1) | ((F.col("kind") == "page_no") & ~plain)
    return told.withColumn("kind", F.when(sure, F.col("kind"))).select("page_id", "source", "backend", "page", "n", "at", "line_no", "line", "kind")


class Words:
    """The lexicon with its candidates for what isn't in it, and exact cover of Chinese clauses."""

    def __init__(self, words: list[str]):
        self.all = set(words)
        self.latin = [w for w in words if not _CJK.search(w)]
        self.han = [w for w in words if _CJK.search(w)]
        self.longest = max(map(len, self.han), default=1)
        ordered = sorted(self.han, key=len, reverse=True)
        self.cover = re.compile("(?:" + "|".join(map(re.escape, ordered)) + ")*") if ordered else re.compile("")
        self.word = re.compile("|".join(map(re.escape, ordered))) if ordered else re.compile(r"(?!)")
        self.blurred: dict[str, list[tuple[str, int]]] = {}
        for w in self.han:
            for i in range(len(w)):
                self.blurred.setdefault(w[:i] + "?" + w[i + 1 :], []).append((w, i))
        self.heads, self.tails = {w[:i] for w in words for i in range(1, len(w))}, {w[i:] for w in words for i in range(1, len(w))}
        self.near = lru_cache(50_000)(self._near)
        self.cut: dict[str, set[str]] = {}  # what is left of a word without one or two of its signs
        self.trie: dict = {}
        for w in self.latin:
            for left in _without(w):
                self.cut.setdefault(left, set()).add(w)
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def _near(self, token: str) -> list[tuple[str, tuple[tuple[str, str], ...]]]:
        """Words that confusions turn into ``token``: ``(word, ((seen, meant), ...))``.

        Words a deletion or two away on either side come from the index: those with one or two signs taken for others, or
        with one stretch of up to two signs taken for another. Where there are none, all words are searched along the trie
        for those of the least number of edits, however many, up to half the token's length.
        """
        found, n = [], len(token)
        for w in sorted(set().union(*(self.cut.get(left, ()) for left in _without(token)))):
            m = len(w)
            if m == n:
                wrong = [i for i in range(n) if w[i] != token[i]]
                if len(wrong) <= (1 if n < 4 else 2):
                    found.append((w, tuple((token[i], w[i]) for i in wrong)))
            elif min(m, n) >= 2:
                p = 0
                while p < min(m, n) and w[p] == token[p]:
                    p += 1
                s = 0
                while s < min(m, n) - p and w[m - 1 - s] == token[n - 1 - s]:
                    s += 1
                seen, meant = token[p : n - s], w[p : m - s]
                if max(len(seen), len(meant)) <= 2 or (len(seen) <= 4 and len(meant) == 2 and abs(m - n) == 2):
                    found.append((w, ((seen, meant),)))
        return found or self._far(token)

    def _far(self, token: str) -> list[tuple[str, tuple[tuple[str, str], ...]]]:
        n, most, found = len(token), len(token) // 2, []
        stack = [(self.trie, list(range(n + 1)), "")]
        while stack:
            node, row, prefix = stack.pop()
            for c, below in node.items():
                if c == "":
                    if row[n] <= most:
                        found.append((row[n], below))
                    continue
                after = [row[0] + 1]
                for j in range(1, n + 1):
                    after.append(min(row[j] + 1, after[j - 1] + 1, row[j - 1] + (token[j - 1] != c)))
                if min(after) <= most:
                    stack.append((below, after, prefix + c))
        least = min((k for k, _ in found), default=0)
        return [(w, _edits(token, w)) for k, w in sorted(found) if k == least]


def _without(word: str) -> set[str]:
    """``word`` and what is left of it without one or two of its signs."""
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return {word} | one | {w[:i] + w[i + 1 :] for w in one for i in range(len(w))}


def _edits(seen: str, meant: str) -> tuple[tuple[str, str], ...]:
    """The single signs, or gaps, in which a shortest alignment of two words differs."""
    rows = [list(range(len(meant) + 1))]
    for i, a in enumerate(seen, 1):
        rows.append([i])
        for j, b in enumerate(meant, 1):
            rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a != b)))
    out, i, j = [], len(seen), len(meant)
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (seen[i - 1] != meant[j - 1]):
            out += [(seen[i - 1], meant[j - 1])] if seen[i - 1] != meant[j - 1] else []
            i, j = i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            out.append((seen[i - 1], ""))
            i -= 1
        else:
            out.append(("", meant[j - 1]))
            j -= 1
    return tuple(reversed(out))


class Model:
    """Word pair likelihoods and confusion costs, all in negative log probability."""

    def __init__(self, pairs: dict[tuple[str, str], int], confusions: dict[tuple[str, str], int]):
        self.pairs, self.single, self.follow = pairs, Counter(), Counter()
        for (a, b), n in pairs.items():
            self.single[b] += n
            self.follow[a] += n
        self.total, self.size = sum(self.single.values()) + 1, len(self.single) + 1
        self.costs: dict[tuple[str, str], float] = {}
        self.known: dict[str, list[str]] = {}  # a word's predecessors in counted pairs
        for a, b in pairs:
            self.known.setdefault(b, []).append(a)
        self.options: dict[str, dict[str, float]] = {}
        self.lows: dict[str, float] = {}
        self.rivals: dict[str, list[tuple[str, float]]] = {}
        self.confusions, self.seen = confusions, Counter()
        for (_, meant), n in confusions.items():
            self.seen[meant] += n

    def pair(self, a: str, b: str) -> float:
        cost = self.costs.get((a, b))
        if cost is None:
            smooth = (self.single[b] + 0.5) / (self.total + self.size)
            cost = -math.log((self.pairs.get((a, b), 0) + 4 * smooth) / (self.follow[a] + 4))
            if len(self.costs) < 500_000:
                self.costs[(a, b)] = cost
        return cost

    def least(self, b: str) -> float:
        """The least that ``b`` may cost behind any word."""
        cost = self.lows.get(b)
        if cost is None:
            cost = self.lows[b] = min([self.alone(b) + math.log(4), *(self.pair(a, b) for a in self.known.get(b, ()))])
        return cost

    def lead(self, a: str) -> float:
        """``a``'s part of the cost of an uncounted pair, which is ``lead(a) + alone(b)``."""
        return math.log(self.follow[a] + 4)

    def alone(self, b: str) -> float:
        return -math.log(4 * (self.single[b] + 0.5) / (self.total + self.size))

    def channel(self, wrong: tuple[tuple[str, str], ...]) -> float:
        return sum(5 - math.log((self.confusions.get(p, 0) + 0.1) / (self.seen[p[1]] + 20)) for p in wrong)


def _viterbi(slots: list[list[tuple[str, float]]], model: Model, before: str = "") -> list[str]:
    """The likeliest word of each slot, of ``(word, channel cost)`` candidates, by back-pointers."""
    best, backs = {before: 0.0}, []
    for slot in slots:
        if len(best) == 1 and len(slot) == 1:  # no choice on either side, so the costs so far are common to all that follows
            backs.append({slot[0][0]: next(iter(best))})
            best = {slot[0][0]: 0.0}
            continue
        after: dict[str, float] = {}
        back: dict[str, str] = {}
        for word, cost in slot:
            score, a = min((s + model.pair(a, word), a) for a, s in best.items())
            if word not in after or score + cost < after[word]:
                after[word], back[word] = score + cost, a
        backs.append(back)
        best = after
    if not slots:
        return []
    path = [min(best, key=lambda w: (best[w], w))]
    for back in reversed(backs[1:]):
        path.append(back[path[-1]])
    return path[::-1]


def _sure(slots: list[list[tuple[str, float]]], model: Model, before: str = "") -> list[list[tuple[str, float]]]:
    """``slots`` without rivals that can't win: between two words without a choice, doubting a word saves the costs of its two
    pairs at most. Two passes, as a word freed of its rivals may free its neighbours."""
    out = list(slots)
    for _ in range(2):
        for k, slot in enumerate(out):
            if len(slot) > 1 and slot[0][1] == 0.0 and all(len(x) == 1 for x in (*out[max(0, k - 1) : k], *out[k + 1 : k + 2])):
                saved = model.pair(out[k - 1][0][0] if k else before, slot[0][0]) + (model.pair(slot[0][0], out[k + 1][0][0]) if k + 1 < len(out) else 0.0)
                if saved <= min(cost for _, cost in slot[1:]):
                    out[k] = slot[:1]
    return out


def _han_options(seen: str, words: Words, model: Model) -> dict[str, float]:
    """Lexicon words that ``seen`` may mean, with one confused sign at most, and their channel costs."""
    options = model.options.get(seen)
    if options is None:
        options = {seen: 0.0} if seen in words.all else {}
        for k in range(len(seen)):
            for w, at in words.blurred.get(seen[:k] + "?" + seen[k + 1 :], ()):
                if at == k and w != seen:
                    cost = model.channel(((seen[k], w[k]),)) + (6.0 if len(w) == 1 else 0.0)
                    options[w] = min(options.get(w, 1e9), cost)
        if len(model.options) < 200_000:
            model.options[seen] = options
    return options


def _han_decode(clause: str, words: Words, model: Model, open_start: bool, open_end: bool, cut_start: bool = False, cut_end: bool = False) -> list[tuple[str, str]] | None:
    """Viterbi over the lattice of lexicon words, each with one confused sign at most: ``(seen, meant)`` pieces.

    ``cut_start``, ``cut_end``: a word may be cut there. A sign there that ends or begins a lexicon word is then the rest of
    a cut word rather than a misread word of one sign, unless that confusion is known.

    The cost from each place to the clause's end is bounded from below without regard to the words before (``ahead``). The
    path that bound would take has a cost of its own, and no partial path whose cost and bound exceed it is followed. Of the
    words before, only those counted with a word are tried one by one: a counted pair costs less than it would uncounted,
    and the best of the uncounted is the same for every word that follows. Neither changes the path found.
    """
    n = len(clause)
    edges: list[list[tuple[int, str, dict[str, float]]]] = []
    for i in range(n):
        own = []
        for j in range(i + 1, min(n, i + words.longest) + 1):
            seen = clause[i:j]
            options = _han_options(seen, words, model)
            if j == i + 1 and (i == 0 and cut_start and seen in words.tails or j == n and cut_end and seen in words.heads):
                options = {w: c for w, c in options.items() if w == seen or (seen, w) in model.confusions}
            at_edge = i == 0 and open_start and seen in words.tails or j == n and open_end and seen in words.heads
            if seen not in options and (at_edge or j == i + 1):
                options = options | {seen: 4.0 if at_edge else 25.0}  # an unknown sign stays as it is
            if options:
                own.append((j, seen, options))
        edges.append(own)
    ahead, step = [0.0] * (n + 1), [None] * n
    for i in range(n - 1, -1, -1):
        ahead[i], step[i] = min((cost + model.least(word) + ahead[j], (j, word, cost)) for j, _, options in edges[i] for word, cost in options.items())
    most, i, last = 1e-6, 0, ""
    while i < n:
        j, word, cost = step[i]
        most += model.pair(last, word) + cost
        i, last = j, word
    best: list[dict[str, tuple[float, tuple | None]]] = [{} for _ in range(n + 1)]
    best[0][""] = (0.0, None)
    for i in range(n):
        here = best[i]
        if not here:
            continue
        lowest = min(s for s, _ in here.values())
        least, least_at = min((s + model.lead(a), a) for a, (s, _) in here.items())
        for j, seen, options in edges[i]:
            after, room = best[j], most - ahead[j] - lowest
            for word, cost in options.items():
                if cost + model.least(word) > room:
                    continue
                known = model.known.get(word, ())
                both = (a for a in known if a in here) if len(known) < len(here) else (a for a in here if (a, word) in model.pairs)
                score, at = min([(least + model.alone(word) + cost, least_at), *((here[a][0] + model.pair(a, word) + cost, a) for a in both)])
                if score + ahead[j] <= most and (word not in after or score < after[word][0]):
                    after[word] = (score, (i, at, seen))
    if not best[n]:
        return None
    out, j, word = [], n, min(best[n], key=lambda w: (best[n][w][0], w))
    while j:
        i, at, seen = best[j][word][1]
        out.append((seen, word))
        j, word = i, at
    return out[::-1]


class PageReader:
    """Noise and repaired text of one page, given its head and foot lines and its neighbours' edge lines."""

    def __init__(self, words: Words, model: Model | None = None):
        self.words, self.model = words, model or Model({}, {})
        self.last = ""  # the last word of the line before

    def _rivals(self, word: str) -> list[tuple[str, float]]:
        """Other lexicon words that ``word``, though in the lexicon itself, may be a misreading of."""
        found = self.model.rivals.get(word)
        if found is None:
            if _CJK.search(word):
                options = _han_options(word, self.words, self.model).items()
            else:
                options = [(w, self.model.channel(x)) for w, x in self.words.near(word)]
            found = self.model.rivals[word] = sorted((w, cost + DOUBT) for w, cost in options if w != word and cost <= MOST_DOUBT)
        return found

    def _join(self, a: str, b: str) -> str | None:
        """The word whose pieces ``a`` and ``b`` are, if the lexicon has it."""
        for joined in (a + b, a.rstrip("-") + b):
            if joined in self.words.all:
                return joined
        return None

    def read(self, text: str, marked: dict[int, str], before: str | None, after: str | None) -> tuple[set[tuple[int, str]], list[tuple[bool, str]], list[tuple[int, str]]]:
        """``(noise as (line, kind), paragraphs as (starts anew, text), repaired lines)``.

        ``before`` and ``after``: the last body line of the page before and the first of the page after, None if missing.
        """
        noise = {(no, kind) for no, kind in marked.items()}
        raw = text.split("\n")
        body = [(i, line) for i, line in enumerate(raw, 1) if line.strip() and i not in marked]
        fixed: dict[int, str] = {}
        cut: set[int] = set()
        han = [bool(_CJK.search(line)) for _, line in body]
        if any(han):
            self._read_han([b for b, h in zip(body, han) if h], before, after, noise, fixed)
        # Lines of figures only stand between the two parts of a cut word without being either.
        latin = [b for b, h in zip(body, han) if not h and re.search("[A-Za-z]", b[1])]
        carried = self.last = ""
        if before is not None and before.rstrip()[-1:] in tuple(CUTS) and not _CJK.search(before):
            carried = (before.rstrip()[:-1].split() or [""])[-1]
        for k, (no, line) in enumerate(latin):
            nxt = latin[k + 1][1] if k + 1 < len(latin) else (after if after is not None and not _CJK.search(after) else None)
            first_of_page = k == 0 and bool(body) and body[0][0] == no
            carried = self._read_latin(no, line, nxt, carried, first_of_page and before is None, noise, fixed, cut)
        paragraphs = self._paragraphs(raw, body, fixed, cut, marked)
        return noise, paragraphs, [(no, fixed.get(no, line)) for no, line in body]

    def _read_latin(self, no: int, line: str, nxt: str | None, carried: str, open_start: bool, noise: set, fixed: dict, cut: set) -> str:
        words, right = self.words.all, line.rstrip()
        sign = right[-1:] if right[-1:] in tuple(CUTS) and right[-2:-1].strip() not in ("", *CUTS) or right[-2:-1] == "-" and right[-1:] in tuple(CUTS) else ""
        body = right[:-1] if sign else right
        spans = list(_TOKEN.finditer(body))
        slots: list[list[tuple[str, float]]] = []
        keys: list[tuple[int, int, str, str]] = []  # where, and what of the word stands on another line
        hyphen, ends_at = False, None
        for t, m in enumerate(spans):
            token = m.group().lower()
            if not re.search(r"[a-z]", token) and not (re.search(r"\d", token) and len(token) > 1 and not token.isdigit()):
                continue
            if t == 0 and carried:
                whole, other = carried.lower() + token, carried.lower()
                if self._join(other, token) or other + "-" + token in words:
                    continue
                options = [(w, x) for w, x in self.words.near(whole)]
                # Wrong here if the piece on this line isn't the word's end.
                if options and all(w.endswith(token) for w, _ in options):
                    continue
                if token in words and not options:
                    continue
                if options:
                    slots.append([(w, self.model.channel(x)) for w, x in options])
                    keys.append((m.start(), m.end(), "end", token))
                    if not any(w.endswith(token) for w, _ in options):
                        noise.add((no, "misread"))
                elif token not in self.words.tails:
                    noise.add((no, "misread"))
                continue
            if t == len(spans) - 1 and sign and m.end() == len(body):
                ends_at = m
                rest = _TOKEN.match((nxt or "").strip())
                other = re.split(rf"[{CUTS}]$", rest.group().lower())[0] if rest else None
                kept = token + "-"
                if other is None:
                    hyphen = token in self.words.heads or kept not in self.words.heads
                    if kept in self.words.heads and not any(w.startswith(token) and not w.startswith(kept) for w in words):
                        hyphen = False
                    if token not in self.words.heads and token not in words and kept not in self.words.heads:
                        noise.add((no, "misread"))
                    continue
                if self._join(token, other):
                    hyphen = True
                    continue
                if kept + other in words or (kept in self.words.heads and any(w.startswith(kept) and self._alike(w[len(kept) :], other) for w in self.words.latin)):
                    continue
                hyphen = True
                options = self.words.near(token + other)
                if options and not any(w.startswith(token) for w, _ in options):
                    noise.add((no, "misread"))
                elif not options and token not in self.words.heads and token not in words:
                    noise.add((no, "misread"))
                continue
            if token in words or token.isdigit():
                slots.append([(token, 0.0), *(() if token.isdigit() else self._rivals(token))])
                keys.append((m.start(), m.end(), "", token))
                continue
            if open_start and t == 0 and token in self.words.tails:
                continue
            if re.fullmatch(r"[\d.,%]+", token):
                continue
            options = self.words.near(token)
            slots.append([(w, self.model.channel(x)) for w, x in options] or [(token, 0.0)])
            keys.append((m.start(), m.end(), "" if options else "unknown", token))
        if hyphen:
            noise.add((no, "hyphen"))
        if sign:
            cut.add(no)
        out = body
        slots = _sure(slots, self.model, self.last)
        if any(half == "unknown" for _, _, half, _ in keys) or any(len(slot) > 1 or slot[0][0] != key[3] for slot, key in zip(slots, keys)):
            decoded = _viterbi(slots, self.model, self.last)
            for (a, b, half, token), word in reversed(list(zip(keys, decoded))):
                if word != token or half == "unknown":
                    noise |= {(no, "misread")} if half != "end" else set()
                if word != token and not half:
                    seen = body[a:b]
                    out = out[:a] + (word.upper() if seen.isupper() and len(seen) > 1 else word.capitalize() if seen[:1].isupper() else word) + out[b:]
        self.last = keys[-1][3] if keys and not sign else ""
        fixed[no] = out if not sign or hyphen else out + "-"
        return ends_at.group() if sign and ends_at is not None else ""

    def _alike(self, meant: str, seen: str) -> bool:
        return meant == seen or (len(meant) == len(seen) and sum(a != b for a, b in zip(meant, seen)) <= 1) or (abs(len(meant) - len(seen)) == 1 and (meant[:2] == seen[:2] or meant[-2:] == seen[-2:]))

    def _read_han(self, lines: list[tuple[int, str]], before: str | None, after: str | None, noise: set, fixed: dict) -> None:
        strip = lambda s: s.strip(" \t　\r")
        head = re.search(r"[一-鿿]*$", strip(before)).group() if before and _CJK.search(before) else ""
        tail = re.match(r"[一-鿿]*", strip(after)).group() if after and _CJK.search(after) else ""
        signs, owner = list(head), [0] * len(head)
        for no, line in lines:
            own = strip(line)
            if owner and owner[-1] and starts_chapter(line):
                signs.append("\n"), owner.append(0)
            signs += own
            owner += [no] * len(own)
            if starts_chapter(line):
                signs.append("\n"), owner.append(0)
        signs += tail
        owner += [0] * len(tail)
        stream = "".join(signs)
        for m in re.finditer(r"[一-鿿]+", stream):
            clause = m.group()
            if self.words.cover.fullmatch(clause):
                found = self.words.word.findall(clause)
                slots = _sure([[(w, 0.0), *self._rivals(w)] for w in found], self.model)
                if "".join(found) == clause and any(len(slot) > 1 for slot in slots):
                    at = m.start()
                    for seen, meant in zip(found, _viterbi(slots, self.model)):
                        for a, b in zip(seen, meant):
                            if a != b and owner[at]:
                                noise.add((owner[at], "misread"))
                            signs[at] = b
                            at += 1
                continue
            open_start, open_end = m.start() == 0 and not head and before is None or m.start() == 0 and bool(head), m.end() == len(stream)
            cut_start = m.start() == 0 and (bool(head) or strip(before or "")[-1:] not in tuple(STOPS))
            cut_end = m.end() == len(stream) and (bool(tail) or strip(after or "")[:1] not in tuple(STOPS))
            pieces = _han_decode(clause, self.words, self.model, open_start, open_end, cut_start, cut_end)
            at = m.start()
            for seen, meant in pieces or []:
                for a, b in zip(seen, meant):
                    unknown = seen == meant and seen not in self.words.all and seen not in self.words.tails and seen not in self.words.heads
                    if (a != b or unknown) and owner[at]:
                        noise.add((owner[at], "misread"))
                    signs[at] = b
                    at += 1
        repaired: dict[int, list[str]] = {}
        for sign, no in zip(signs, owner):
            if no:
                repaired.setdefault(no, []).append(sign)
        fixed |= {no: "".join(own) for no, own in repaired.items()}

    def _paragraphs(self, raw: list[str], body: list[tuple[int, str]], fixed: dict, cut: set, marked: dict) -> list[tuple[bool, str]]:
        """Fragments in order; ``\\u0001`` at an end asks to be joined without space."""
        indented = sum(line[:1] in " \t　" for _, line in body) >= max(2, len(body) // 12) or any(line.startswith(("  ", "　　")) for _, line in body)
        out: list[list] = []
        last = 0
        for no, line in body:
            blank = any(not raw[i - 1].strip() for i in range(last + 1, no) if i not in marked)
            chapter = starts_chapter(line)
            anew = chapter or blank and bool(out) or (indented and line[:2] in ("  ", "　　", "\t")) or (bool(out) and out[-1][2])
            text = fixed.get(no, line).strip(" \t　\r")
            glue = "\u0001" if no in cut and not text.endswith("-") or _CJK.search(text[-1:]) or text[-1:] in "，。、；：！？" else "\u0001" if text.endswith("-") else " "
            if anew or not out:
                out.append([anew, text + glue, chapter])
            else:
                out[-1][1] += text + glue
                out[-1][2] = chapter
            last = no
        return [(a, t) for a, t, _ in out]


def _count(lexicon: list[str]):
    """mapInPandas function: word pairs and confusions of each batch, summed up."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(lexicon)
        pairs, wrong = Counter(), Counter()
        for batch in batches:
            for text in batch["text"]:
                before = ""
                for line in text.split("\n"):
                    if _CJK.search(line):
                        for clause in re.findall(r"[一-鿿]+", line):
                            if words.cover.fullmatch(clause):
                                found = words.word.findall(clause)
                                pairs.update(zip(["", *found], found))
                            else:
                                for w in range(2, words.longest + 1):
                                    for i in range(len(clause) - w + 1):
                                        seen = clause[i : i + w]
                                        for k in range(w):
                                            options = words.blurred.get(seen[:k] + "?" + seen[k + 1 :], ())
                                            if len(options) == 1 and options[0][0] != seen and w > 2:
                                                wrong[(seen[k], options[0][0][k])] += 1
                        continue
                    for m in _TOKEN.finditer(line):
                        token = m.group().lower()
                        if token in words.all:
                            pairs[(before, token)] += 1
                            before = token
                        else:
                            near = words.near(token) if len(token) > 3 and not token.isdigit() and token[-1] not in CUTS else []
                            least = min((len(x) for _, x in near), default=0)
                            near = [x for _, x in near if len(x) == least]
                            if len(near) == 1:
                                wrong.update(near[0])
                            before = ""
        rows = [("pair", a, b, n) for (a, b), n in pairs.items()] + [("confusion", a, b, n) for (a, b), n in wrong.items()]
        yield pd.DataFrame(rows, columns=["kind", "a", "b", "n"])

    return count


def learn_model(pages: DataFrame, lexicon: list[str]) -> Model:
    """Counts over all pages. A model holds the ``MAX_PAIRS`` most frequent pairs of lexicon words and the ``MAX_CONFUSIONS``
    most frequent confusions; rarer ones have the likelihood of uncounted ones."""
    counts = pages.where("text is not null").select("text").mapInPandas(_count(lexicon), "kind string, a string, b string, n bigint")
    summed = materialise(counts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "counts")
    rows = [r for kind, most in (("pair", MAX_PAIRS), ("confusion", MAX_CONFUSIONS)) for r in summed.where(F.col("kind") == kind).orderBy(F.desc("n"), "a", "b").limit(most).collect()]
    return Model({(r["a"], r["b"]): r["n"] for r in rows if r["kind"] == "pair"}, {(r["a"], r["b"]): r["n"] for r in rows if r["kind"] == "confusion"})


def repair_pages(pages: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row per page with text: ``page_id, source, backend, page, noise, paragraphs``.

    ``noise``: ``ARRAY<STRUCT<line_no, noise>>``; ``paragraphs``: ``ARRAY<STRUCT<anew, text>>``. Null and blank pages have no
    row and count as missing for their neighbours, as do pages with a null ``page``. Of pages with equal source, backend and
    page the one of the lowest id is the neighbour. Null backends form a backend of their own. Other columns are left out.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    words = [r["word"] for r in lexicon.where("word is not null").select(F.lower("word").alias("word")).distinct().limit(MAX_WORDS + 1).collect()]
    if len(words) > MAX_WORDS:
        raise ValueError(f"the lexicon has more than {MAX_WORDS} words")
    own = spread(pages, "page_id").select("page_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("backend", F.lit("")).alias("backend"), F.col("page").cast("int").alias("page"), "text")
    own = own.where("text is not null and trim(text) <> ''")
    edges = materialise(page_edges(own), "edges")
    model = learn_model(own, words)
    body = F.col("kind").isNull()
    head = F.min_by("line", F.when(body & (F.col("at") < EDGE), F.col("at"))).alias("head")
    foot = F.max_by("line", F.when(body & (F.col("at") >= F.col("n") - EDGE), F.col("at"))).alias("foot")
    marks = F.collect_list(F.when(~body, F.struct("line_no", "kind"))).alias("marks")
    sides = materialise(edges.groupBy("page_id", "source", "backend", "page").agg(head, foot, marks), "sides")
    near = sides.where("page is not null").groupBy("source", "backend", "page").agg(F.min_by("head", "page_id").alias("head"), F.min_by("foot", "page_id").alias("foot"))
    place = ["source", "backend", "page"]
    ahead = near.select("source", "backend", (F.col("page") - 1).alias("page"), F.col("head").alias("after"))
    behind = near.select("source", "backend", (F.col("page") + 1).alias("page"), F.col("foot").alias("before"))
    sided = materialise(sides.select("page_id", *place, "marks").join(ahead, place, "left").join(behind, place, "left").select("page_id", "marks", "before", "after"), "sided")
    joined = own.join(small(sided, BROADCAST_ROWS), "page_id")
    shared = spark.sparkContext.broadcast((words, model.pairs, model.confusions))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexical, pairs, confusions = shared.value
        reader = PageReader(Words(lexical), Model(pairs, confusions))
        for batch in batches:
            rows = []
            for page_id, source, backend, page, text, marked, before, after in batch[["page_id", *place, "text", "marks", "before", "after"]].itertuples(index=False, name=None):
                noise, paragraphs, _ = reader.read(text, {m["line_no"]: m["kind"] for m in marked}, before, after)
                rows.append((page_id, source, backend, page, [{"line_no": a, "noise": b} for a, b in sorted(noise)], [{"anew": a, "text": t} for a, t in paragraphs]))
            yield pd.DataFrame(rows, columns=["page_id", *place, "noise", "paragraphs"])

    return joined.mapInPandas(read, "page_id bigint, source string, backend string, page int, noise array<struct<line_no:int,noise:string>>, paragraphs array<struct<anew:boolean,text:string>>")


def noise_of(repaired: DataFrame) -> DataFrame:
    """``page_id, line_no, noise``."""
    return repaired.select("page_id", F.explode("noise").alias("x")).select("page_id", "x.line_no", "x.noise")


def paragraphs_of(repaired: DataFrame, span: int = 256) -> DataFrame:
    """Continuous paragraphs per source and backend: ``source, backend, page, paragraph_no, part_no, text``; ``page`` is where a
    paragraph starts, ``paragraph_no`` its number there. A paragraph that runs over more than ``PART_PAGES`` pages comes in
    parts of so many pages each, counted from 1, so that no row grows with its source; their texts follow each other directly.

    A page that opens amid a paragraph belongs to the last one before it that starts anew. That page is found by a running
    maximum in stretches of ``span`` pages and one over the stretches, so a source of any share of all rows is spread.
    """
    parts = repaired.select("source", "backend", "page", "page_id", F.posexplode("paragraphs").alias("k", "p")).select("source", "backend", "page", "page_id", "k", "p.anew", "p.text")
    starts = F.max(F.when(F.col("anew"), F.struct("page", "k")))
    pages = materialise(parts.groupBy("source", "backend", "page").agg(starts.alias("own")).withColumn("stretch", F.floor(F.col("page") / span)), "starts")
    within = Window.partitionBy("source", "backend", "stretch").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source", "backend").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = pages.groupBy("source", "backend", "stretch").agg(F.max("own").alias("top")).withColumn("earlier", F.max("top").over(over)).drop("top")
    led = pages.withColumn("inside", F.max("own").over(within)).join(whole, ["source", "backend", "stretch"]).select("source", "backend", "page", F.coalesce("inside", "earlier").alias("led"))
    here = F.struct("page", "k")
    placed = parts.join(led, ["source", "backend", "page"]).withColumn("home", F.when(F.col("anew") | (F.col("k") > 0), here).otherwise(F.coalesce("led", here)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "page_id", "k", "text"))), lambda x: x["text"]), "")
    part = (F.floor((F.coalesce(F.col("page"), F.lit(0)) - F.coalesce(F.col("home.page"), F.lit(0))) / PART_PAGES) + 1).cast("int")
    return placed.groupBy("source", "backend", "home", part.alias("part_no")).agg(F.trim(F.regexp_replace(text, "\u0001", "")).alias("text")).select(
        "source", "backend", "home.page", (F.col("home.k") + 1).alias("paragraph_no"), "part_no", "text"
    )
