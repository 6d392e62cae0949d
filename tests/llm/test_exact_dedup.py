from oracle import compare

from hushframe.llm.exact_dedup import exact_dedup

ROWS = [(2, "a", "x"), (1, "a", "y"), (None, "a", "z"), (3, None, "x"), (3, None, "x"), (4, "", "x"), (5, "", "x"), (6, "a ", "x"), (7, "l" * 1_000_000, "x"), (8, "l" * 1_000_000, "x"), (9, "t", "b"), (9, "t", "a"), (None, "n", "q"), (None, "n", "p")]


def test_query_matches_sql(spark):
    assert compare(spark, "op7_exact_dedup") > 0


def test_edges_on_both_join_paths(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, content_hash string")
    want = sorted([(1, "a", "y"), (3, None, "x"), (3, None, "x"), (4, "", "x"), (6, "a ", "x"), (7, "l" * 1_000_000, "x"), (9, "t", "a"), (None, "n", "p")], key=repr)
    for limit in (0, 10_000):
        got = exact_dedup(df, broadcast_hashes=limit)
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == want
    assert exact_dedup(df.where("false")).count() == 0


def test_colliding_hashes_are_compared_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "md5", lambda c: F.lit("00" * 16))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup(df).collect()) == [1, 2]
