"""Every operator on a table whose extra columns have the names that operators use themselves, with nulls, repeated rows, ties, empty and very long texts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from hushframe.llm.exact_dedup import exact_dedup
from hushframe.llm.lm_score import lm_scores
from hushframe.llm.mixing import facets, mix, mixed, word_count
from hushframe.llm.ngram_join import near_classes, near_dedup, representative_pairs
from hushframe.llm.piece_codec import encode_pieces
from hushframe.llm.quality_rules import GRIDS, accepted_scores, quality_filter
from hushframe.llm.sstable import shards
from hushframe.llm.substring_dedup import cut, substring_spans
from hushframe.llm.token_counts import token_counts
from hushframe.llm.warc import pages_of, read_warc, write_warc

NAMES = """id row h pos n places text_ stratum content marks fit order good bad toxic quality node key grams label a b sa sb g first rest found spans
again base last cut_pattern pattern n_epochs bucket tokens t shard ids seq kind chunk lens codes keys counts content_hash repeated_hash n_copies
group_root root v w class_id n_links rows member meta block file size start end at offset length page html url""".split() + list(GRIDS) + [f"cut_{r}" for r in GRIDS] + ["a.b", "select", "Text2"]
TEXTS = [(1, "one two three four", "en", "s"), (1, "one two three four", "en", "s"), (2, "one two three four", None, None), (None, "one two three four", "de", "s"), (3, None, "en", "s"), (4, "", "en", None), (5, " \n", "fr", "t"), (6, "lång text " * 30_000, "sv", "t"), (7, "one two three five", "en", "s"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(k if k % 2 else str(k)).alias(n) for k, n in enumerate(NAMES)]).withColumn("n_chars", F.length("text"))


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)


EVERY = sorted((r[0] for r in TEXTS), key=repr)


def test_operators_that_give_rows_of_their_own(spark, docs, tmp_path):
    assert ids(token_counts(docs)) == EVERY and ids(encode_pieces(docs)) == EVERY and ids(lm_scores(docs)) == EVERY
    assert sorted((r.doc_id, r.n_links) for r in near_classes(docs).collect() if r.doc_id in (1, 2, 7)) == [(1, 3), (1, 3), (2, 3), (7, 0)]
    assert representative_pairs(docs).count() == 0
    assert {r.doc_id for r in substring_spans(docs).collect()} == set()
    assert sum(r.entries for r in shards(docs).where("kind = 'footer'").collect()) == 8
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").withColumn("id", F.lit(1)).withColumn("good", F.lit(1))
    assert ids(accepted_scores(docs, labels)) == sorted([1, 1, 2, None, 6, 7], key=repr)
    folder = str(tmp_path / "w")
    made = write_warc(docs, folder, "doc_id", "lang", "text").collect()
    files = spark.createDataFrame([(r.file, r.size) for r in made], "file string, size long")
    assert sorted(map(tuple, pages_of(read_warc(files)).collect()), key=repr) == sorted([(i, lang, t) for i, t, lang, _ in TEXTS], key=repr)


def test_operators_that_keep_the_columns(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for out, want in (
        (quality_filter(docs, labels), [1, 1, 2, None, 6, 7]),
        (exact_dedup(docs), [1, 3, 4, 5, 6, 7, None]),
        (near_dedup(docs), [1, 3, 4, 5, 6, 7, None]),
        (cut(docs), EVERY),
    ):
        assert out.columns == docs.columns and ids(out) == sorted(want, key=repr)
        assert {r.asDict()["a.b"] for r in out.select("`a.b`").collect()} == {docs.first().asDict()["a.b"]}
    marked, _ = mix(docs, facets(docs), word_count(F.col("text")))
    assert ids(marked) == EVERY and marked.columns[: len(docs.columns)] == docs.columns
    assert mixed(docs, facets(docs), word_count(F.col("text"))).columns == docs.columns


def test_pipeline_stages_one_after_another(spark, docs, tmp_path):
    """All stages on the odd table: rejected, copies, near copies go in turn, and what is left decodes."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", "`a.b`", "shard")
    want = [[1, 1, 2, 6, 7, None], [1, 6, 7], [1, 6, 7]]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, rows, "/root/testdata/sf0.001")
        if k < len(cp.STAGES) - 1:
            assert out.columns == rows.columns, name
        if k < len(want):
            assert ids(out) == sorted(want[k], key=repr), name
        before = {r.doc_id for r in rows.collect()}
        out.write.parquet(str(tmp_path / str(k)))
        rows = spark.read.parquet(str(tmp_path / str(k)))
        assert {r.doc_id for r in rows.collect()} <= before
    assert all(r.lossless for r in rows.collect())
