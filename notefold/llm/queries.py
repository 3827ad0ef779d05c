"""Queries of the text operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.llm.boilerplate import strip_boilerplate
from notefold.llm.dedup import link_items, split_batches
from notefold.llm.mix import mix_sources
from notefold.llm.ocr import noise_of, paragraphs_of, repair_pages
from notefold.llm.pack import fill_report, pack_texts
from notefold.llm.spans import SharedSpans
from notefold.llm.split import split_texts
from notefold.llm.turns import speaker_turns
from notefold.session import table


def _limit(spark: SparkSession, sf_dir: str, name: str) -> int:
    """One limit of the small table size_limits."""
    return int(table(spark, sf_dir, "size_limits").where(F.col("limit_name") == name).first()["size_limit"])


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all note bodies and transcripts."""
    notes = table(spark, sf_dir, "notes").select(F.lit("note").alias("item_kind"), F.col("note_id").alias("item_id"), F.col("body").alias("text"))
    spoken = table(spark, sf_dir, "transcripts").select(F.lit("transcript").alias("item_kind"), F.col("transcript_id").alias("item_id"), F.col("transcript_text").alias("text"))
    kinds = F.when(F.col("limit_name") == "note_body", "note").when(F.col("limit_name") == "transcript_text", "transcript")
    limits = table(spark, sf_dir, "size_limits").select(kinds.alias("item_kind"), "size_limit", "overlap").where("item_kind is not null")
    return split_texts(notes.unionByName(spoken), limits)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that had to be split."""
    return p1_pieces(spark, sf_dir).where("n_pieces > 1 and piece_no = 1").select("item_kind", "item_id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_pages(table(spark, sf_dir, "page_results"), table(spark, sf_dir, "ocr_lexicon"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with noise of scanning and printing."""
    return noise_of(_pages(spark, sf_dir))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired paragraphs of every source and backend."""
    return paragraphs_of(_pages(spark, sf_dir))


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all transcripts."""
    return speaker_turns(table(spark, sf_dir, "transcripts"), table(spark, sf_dir, "speaker_roster"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's number and speaker."""
    return p3_turns(spark, sf_dir).where("speaker is not null").select("transcript_id", F.col("known_no").alias("turn_no"), "speaker")


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "notes").where(F.col("source_type").isin("webpage", "wechat-article"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of web notes that are not part of the article."""
    return strip_boilerplate(_web(spark, sf_dir)).select(F.col("id").alias("note_id"), "line_no")


def p5_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of web notes that are part of the article."""
    return strip_boilerplate(_web(spark, sf_dir), keep="content").select(F.col("id").alias("note_id"), "line_no", "line")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose source was accepted before, with the first accepted item of that source."""
    return link_items(table(spark, sf_dir, "manifest_items"), table(spark, sf_dir, "short_links"))


def p6_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item as new (null ``first_item_id``) or as a repeat, with the score of the link."""
    return split_batches(table(spark, sf_dir, "manifest_items"), table(spark, sf_dir, "short_links"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of all documents."""
    return pack_texts(table(spark, sf_dir, "documents"), _limit(spark, sf_dir, "container"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be divided."""
    return p7_containers(spark, sf_dir).where("n_pieces > 1 and piece_no = 1").select("doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p7_containers(spark, sf_dir), _limit(spark, sf_dir, "container"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each record of the mix."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares wanted and reached."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return p8_report(spark, sf_dir).where("not reachable").select("source")


def _shared(spark: SparkSession, sf_dir: str) -> SharedSpans:
    return SharedSpans(table(spark, sf_dir, "documents"), _limit(spark, sf_dir, "shared_span"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share a span."""
    return _shared(spark, sf_dir).pairs()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal shared spans."""
    return _shared(spark, sf_dir).spans()


def p9_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is found elsewhere."""
    return _shared(spark, sf_dir).amounts()


QUERIES = {f.__name__: f for f in (p1_pieces, p1_found, p2_found, p2_paragraphs, p3_turns, p3_found, p5_found, p5_article, p6_found, p6_split, p7_containers, p7_found, p7_fill, p8_mix, p8_report, p8_found, p9_found, p9_spans, p9_amounts)}

SQL = {
    "p1_found": """
        SELECT 'note' AS item_kind, note_id AS item_id FROM notes
        WHERE length(body) > (SELECT size_limit FROM size_limits WHERE limit_name = 'note_body')
        UNION ALL
        SELECT 'transcript', transcript_id FROM transcripts
        WHERE length(transcript_text) > (SELECT size_limit FROM size_limits WHERE limit_name = 'transcript_text')""",
}
