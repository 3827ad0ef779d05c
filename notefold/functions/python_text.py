"""The few text functions that no JVM expression covers, as Arrow-batched functions."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Encodings tried in turn for bytes that aren't UTF-8.
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "big5")


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references of HTML 5 resolved."""
    return text.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


def merged_sections_text(markdown: str) -> str:
    """``markdown.merged_sections`` of one text, in time linear in its sections."""
    squeezed = lambda t: re.sub("\n{3,}", "\n\n", re.sub("\r\n|\r", "\n", t)).strip()
    intro, *parts = re.split(r"\n(?=## )", "\n" + re.sub("\r\n|\r", "\n", markdown))
    if not parts:
        return squeezed(markdown)
    merged: dict[str, dict[str, None]] = {}  # both in order of first sight
    for part in parts:
        title, _, rest = part.partition("\n")
        texts = merged.setdefault(title, {})
        if body := squeezed(rest):
            texts[body] = None
    pieces = [squeezed(intro), *(p for title, texts in merged.items() for p in (title, "\n\n".join(texts)))]
    return squeezed("\n\n".join(p for p in pieces if p.strip()))


@F.pandas_udf(StringType())
def long_merged_sections(text: pd.Series) -> pd.Series:
    """Merged sections of long texts, for which the JVM expression's time grows as the square of the sections."""
    return text.map(lambda t: merged_sections_text(t) if isinstance(t, str) else None)


@F.pandas_udf(StringType())
def safe_name(text: pd.Series) -> pd.Series:
    """A name of letters, digits and hyphens, composed, 60 code points at most."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = re.sub(r'[\\/:*?"<>|]', "", unicodedata.normalize("NFC", t))
        return re.sub(r"-{2,}", "-", re.sub(r"[^\w]+", "-", t)).strip("-")[:60]

    return text.map(one)


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes in the first encoding that fits; signs that fit none are replaced."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ENCODINGS:
            try:
                return bytes(raw).decode(name)
            except UnicodeDecodeError:
                continue
        return bytes(raw).decode("utf-8", errors="replace")

    return content.map(one)


@F.pandas_udf(StringType())
def absolute_url(raw: pd.Series, base: pd.Series) -> pd.Series:
    """An address resolved against its page; empty for data and script addresses."""

    def one(r: str | None, b: str | None) -> str:
        value = html.unescape(r or "").strip()
        if not value or value.startswith(("data:", "javascript:")):
            return ""
        return "https:" + value if value.startswith("//") else urljoin(b or "", value)

    return pd.Series([one(r, b) for r, b in zip(raw, base)])


@F.pandas_udf(StringType())
def script_literal(text: pd.Series) -> pd.Series:
    """Escapes of a script's string literal resolved."""

    def one(t: str | None) -> str | None:
        if not t or "\\" not in t:
            return t
        try:
            return t.encode("utf-8").decode("unicode_escape")
        except UnicodeDecodeError:
            return t

    return text.map(one)


@F.pandas_udf(StringType())
def json_scalar(text: pd.Series) -> pd.Series:
    """A frontmatter value read as JSON where it is JSON, else without the quotes around it."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = t.strip()
        try:
            value = json.loads(t) if t else ""
        except ValueError:
            return t.strip('"').strip("'")
        return "" if value is None else str(value)

    return text.map(one)


@F.pandas_udf(StringType())
def canonical_json_hash(text: pd.Series) -> pd.Series:
    """Hash of a JSON text with its keys in order; null where it is no JSON."""
    import hashlib

    def one(t: str | None) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False).encode()).hexdigest() if t else None
        except ValueError:
            return None

    return text.map(one)


def _walk(node: object) -> str:
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return "".join(_walk(x) for x in node)
    if isinstance(node, dict):
        for key in ("text", "content", "words", "nodes", "children", "word", "rich", "paragraphs"):
            if node.get(key):
                return _walk(node[key])
    return ""


@F.pandas_udf(StringType())
def rich_text(text: pd.Series) -> pd.Series:
    """Plain text of nested JSON of strings, lists and objects with text in them."""

    def one(t: str | None) -> str | None:
        try:
            return _walk(json.loads(t)) if t else t
        except ValueError:
            return t

    return text.map(one)


@F.pandas_udf(ArrayType(StringType()))
def image_urls(text: pd.Series) -> pd.Series:
    """Addresses of images anywhere in a JSON text, each once, in order."""
    ending = re.compile(r"(?i)\.(?:jpe?g|png|gif|webp|avif|bmp)(?:[?@#].*)?$")

    def walk(node: object, out: dict[str, None]) -> None:
        if isinstance(node, list):
            for x in node:
                walk(x, out)
        elif isinstance(node, dict):
            for key, x in node.items():
                if key in ("url", "src", "img_src", "cover") and isinstance(x, str) and ending.search(x):
                    out["https:" + x if x.startswith("//") else x] = None
                else:
                    walk(x, out)

    def one(t: str | None) -> list[str]:
        out: dict[str, None] = {}
        try:
            walk(json.loads(t or "null"), out)
        except ValueError:
            pass
        return list(out)

    return text.map(one)
