"""Reference terms in texts: listed codes by pattern and names by substring.

All names are looked for in one pass over each text by an Aho-Corasick automaton, built once per worker process from the
term table, whose size is checked. There is no join of texts and names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.functions.text import listed_code
from notefold.session import bounded_batches, small

#: Terms that an automaton is built of at most.
MAX_TERMS = 500_000


def names_in(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame, name: str) -> DataFrame:
    """``id, name`` for each name that occurs anywhere in a text, once per text. Null texts and empty names match nothing."""
    bounded_batches(texts.sparkSession)
    names = [r[0] for r in terms.where(F.col(name).isNotNull() & (F.col(name) != "")).select(name).distinct().limit(MAX_TERMS + 1).collect()]
    if len(names) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    own = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for n in names:
            machine.add_word(n, n)
        machine.make_automaton()
        for batch in batches:
            rows = [(i, n) for i, t in zip(batch["id"], batch["text"]) for n in dict.fromkeys(n for _, n in machine.iter(t))] if names else []
            yield pd.DataFrame(rows, columns=["id", "name"])

    return own.mapInPandas(search, f"id {dict(own.dtypes)['id']}, name string")


def codes_in(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame, code: str) -> DataFrame:
    """``id, code, at`` for each listed code in a text, ``at`` its first place among the codes there, from 0."""
    pattern = r"(?i)(?<![\p{L}\p{N}_])(?:[036]\d{5}(?:\.(?:SZ|SH))?)(?![\p{L}\p{N}_])"
    found = texts.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias("at", "raw"))
    listed = small(terms.select(F.upper(F.col(code)).alias("code")).distinct(), MAX_TERMS)
    return found.select("id", "at", listed_code(F.col("raw")).alias("code")).join(listed, "code").groupBy("id", "code").agg(F.min("at").alias("at"))


def reference_terms(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame, code: str, name: str, limit: int = 40) -> DataFrame:
    """``id, rank, code`` of terms in a text: codes in order of place, then names, longest first, each term once."""
    by_code = codes_in(texts, id_col, text_col, terms, code).select("id", "code", F.lit(0).alias("phase"), F.col("at").alias("key"))
    listed = terms.select(F.col(name).alias("name"), F.upper(F.col(code)).alias("code"))
    by_name = names_in(texts, id_col, text_col, terms, name).join(small(listed, MAX_TERMS), "name").select("id", "code", F.lit(1).alias("phase"), (-F.length("name")).alias("key"))
    best = by_code.unionByName(by_name).groupBy("id", "code").agg(F.min(F.struct("phase", "key")).alias("best"))
    ranked = best.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("best", "code"))), 1, limit).alias("terms"))
    return ranked.select("id", F.posexplode("terms").alias("rank", "t")).select("id", (F.col("rank") + 1).alias("rank"), "t.code")
