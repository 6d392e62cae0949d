"""The documents pipeline: quality rules, exact dedup, near dedup, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run``
writes each stage's result to the cluster's shared folder as Parquet and reads it again, so
lineage ends at every stage.

Edges: all stages take null, empty and very long texts, repeated rows, empty tables and extra
columns as the operators' docstrings define; rows without words are rejected by the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import spread, table, written
from hushframe.llm.exact_dedup import exact_dedup
from hushframe.llm.mixing import facets, mixed, word_count
from hushframe.llm.ngram_join import near_dedup
from hushframe.llm.piece_codec import encode_pieces
from hushframe.llm.quality_rules import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules accept; cutoffs are certified on the labels."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group whose 3-grams have a Jaccard similarity of at least one half."""
    return near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of overlapping sources and languages in the proportions of smoothed quotas; a document of a scarce one may come several times."""
    return mixed(docs, facets(docs), word_count(F.col("text")), seed=4)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces under seeded merge-dropout, decoded again and compared."""
    return encode_pieces(docs, dropout=0.1, seed=20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", pieces),
]

#: Exact binomial cutoffs, min-cost flow and merge agendas aren't expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
