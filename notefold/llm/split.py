"""Splitting of oversized texts at natural boundaries, with overlap.

Recursive bisection: a text above its limit is cut at the strongest boundary near its midpoint, halves that still exceed
the limit less the overlap are cut again, then each piece but the first is preceded by the overlap's last code points of
what comes before it. Only offsets are handled on the way, and only the surroundings of each midpoint are searched, so a
text of any length takes time in proportion to it. Texts within their limit never leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.session import bounded_batches, small

#: Boundaries from strong to weak; a cut is made at the end of a match.
BOUNDARIES = [
    re.compile(r"\n(?=#{1,6}[ \t])"),
    re.compile(r"\n[ \t\r]*\n"),
    re.compile(r"\n"),
    re.compile(r"[。！？!?…][」』”’\"')）]*|\.[\"')]*(?=\s)"),
    re.compile(r"[；;，,、]|\s"),
]


def _cut(text: str, start: int, end: int, limit: int, overlap: int) -> int:
    """Place of the strongest boundary near the middle of ``text[start:end]``; of equals, the nearest."""
    middle = (start + end) // 2
    reach = max(0, min((end - start) // 4, limit // 2, (end - start) // 2 - overlap - 1))
    low, high = middle - reach, middle + reach
    for kind in BOUNDARIES:
        places = [m.end() for m in kind.finditer(text, low, high) if low <= m.end() <= high]
        if places:
            return min(places, key=lambda p: (abs(p - middle), p))
    at = middle
    while at < high and (unicodedata.combining(text[at]) or text[at - 1 : at + 1] == "\r\n"):
        at += 1
    return at


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(piece start, start of its own part, end)`` of each piece; one whole piece if the text is within the limit.

    The own parts follow each other without gap; a piece starts ``overlap`` code points before its own part.
    """
    if limit < 1 or overlap < 0 or overlap * 4 > limit:
        raise ValueError("the limit must be positive and at least four times the overlap")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    stack, out = [(0, len(text))], []
    while stack:
        start, end = stack.pop()
        if end - start <= limit - overlap:
            out.append((max(0, start - overlap), start, end))
        else:
            at = _cut(text, start, end, limit, overlap)
            stack += [(at, end), (start, at)]
    return out


def split_texts(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of texts: ``item_kind, item_id, piece_no, n_pieces, piece_start, own_start, piece_end, text``.

    ``items``: ``item_kind STRING, item_id BIGINT, text STRING``; ``limits``: ``item_kind, size_limit, overlap``, a few rows.
    Offsets count code points from 0, ``piece_no`` counts from 1. A null text gives no piece, an empty one a single empty
    piece, a kind without limit a single whole piece. Repeated rows give repeated pieces; other columns are left out.
    """
    bounded_batches(items.sparkSession)
    schema = "item_kind string, item_id bigint, piece_no int, n_pieces int, piece_start bigint, own_start bigint, piece_end bigint, text string"
    joined = items.select("item_kind", "item_id", "text").where("text is not null").join(
        small(limits.select("item_kind", "size_limit", "overlap"), 10_000), "item_kind", "left"
    )
    over = F.coalesce(F.length("text") > F.col("size_limit"), F.lit(False))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, item, text, limit, overlap in zip(batch["item_kind"], batch["item_id"], batch["text"], batch["size_limit"], batch["overlap"]):
                spans = pieces(text, int(limit), int(overlap))
                rows += [(kind, item, i, len(spans), a, own, b, text[a:b]) for i, (a, own, b) in enumerate(spans, 1)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    one, zero = F.lit(1), F.lit(0).cast("bigint")
    whole = joined.where(~over).select(
        "item_kind", "item_id", one.alias("piece_no"), one.alias("n_pieces"), zero.alias("piece_start"), zero.alias("own_start"), F.length("text").cast("bigint").alias("piece_end"), "text"
    )
    return joined.where(over).mapInPandas(cut, schema).unionByName(whole)
