"""Queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, spread, table, written
from .exact_dedup import exact_dedup
from .lm_score import lm_scores
from .mixing import facets, mix, word_count
from .ngram_join import near_classes
from .piece_codec import encode_pieces
from .quality_rules import accepted_scores
from .sstable import shards
from .substring_dedup import substring_spans
from .token_counts import token_counts
from .warc import pages_of, read_warc, write_warc


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of at least 50 words that also stand in another document."""
    return substring_spans(spread(table(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spread(table(spark, sf_dir, "documents")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least id of its group of near copies, and how many documents have at least half of their word 3-grams in common with it."""
    return near_classes(spread(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a mix of sources and languages, smoothed by the power 0.7, takes, and how often."""
    docs = table(spark, sf_dir, "documents")
    marked, _ = mix(docs.select("doc_id", "source", "lang", "text"), facets(docs), word_count(F.col("text")), seed=4)
    return marked.where("n_epochs > 0").select("doc_id", "source", "lang", "n_epochs")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under a trigram model of all documents, with all their trigrams."""
    return lm_scores(spread(table(spark, sf_dir, "documents")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the risk-controlled rules accept, with their scores."""
    return accepted_scores(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, by id, with the number of rows each stands for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, copies=True).select("doc_id", "n_copies", "content_hash")


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids as the segments of sorted-string-table shards."""
    return shards(spread(table(spark, sf_dir, "documents")))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under merge-dropout, each decoded again and compared with its text."""
    return encode_pieces(spread(table(spark, sf_dir, "documents")), dropout=0.1, seed=20)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC files in the shared folder and read back in byte ranges."""
    folder = fresh_path(spark, "warc")
    files = written(write_warc(spread(table(spark, sf_dir, "pages")), folder), "warc-files")
    return pages_of(read_warc(files.select("file", "size")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_join": op3_ngram_join,
    "op4_mixing": op4_mixing,
    "op5_lm_score": op5_lm_score,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sstable": op8_sstable,
    "op9_piece_codec": op9_piece_codec,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT min(doc_id) AS doc_id, count(*) AS n_copies, md5(text) AS content_hash
        FROM documents WHERE text IS NOT NULL GROUP BY text
        UNION ALL SELECT doc_id, 1, NULL FROM documents WHERE text IS NULL""",
    "op10_warc": "SELECT page_id, url, html FROM pages",
}
