"""Queries whose work a task holds stays the same as their tables grow: how it is dealt, and that nothing costly is done twice."""

import re
import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hushframe import registry
from hushframe.functions import text
from hushframe.operators import corpus
from hushframe.operators import model_tokens as mt
from hushframe.operators import score
from hushframe.plans import common, detection, intervals

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_grows_with_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [common.dealt(spark.range(n), "id", 10).rdd.getNumPartitions() for n in (0, 5, 10 * cores, 10 * cores + 1, 1000)] == [cores, cores, cores, cores + 1, 100]


def test_unannotated_redacts_once(spark):
    assert len(re.findall(r"(?m)^.*ArrowEvalPython", plan(registry.QUERIES["unannotated"](spark, SMALL)))) == 1


def test_notes_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(detection, "_NOTES", 1)
    n = spark.read.parquet(f"{SMALL}/customer.parquet").count()
    for name in ("redact_text", "redact_hybrid", "survival"):
        assert registry.QUERIES[name](spark, SMALL).rdd.getNumPartitions() == n


def exchanges(df):
    return [x for x in re.findall(r"(?m)^.*?Exchange (\w+)", plan(df)) if x == "hashpartitioning"]


def test_spans_shuffle_once(spark):
    """Items are dealt by order, once a side; nothing that is made of them is shuffled again but the sums by label."""
    most = {"score_exact": 2, "score_micro": 2, "score_by_label": 3, "address_coverage": 3, "merge_adjacent": 1, "merge_intervals": 1, "subtract_intervals": 2, "score_greedy": 2, "interval_overlap_join": 2, "leaks": 2}
    assert {n: len(exchanges(registry.QUERIES[n](spark, SMALL))) for n in most} == most


def test_items_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(intervals, "_ITEMS", 100)
    n = -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 100)
    for name in ("merge_adjacent", "score_exact"):
        assert f", {n})" in plan(registry.QUERIES[name](spark, SMALL))


def test_nulls_and_repeats_of_spans(spark):
    """What is null equals nothing; a gold span that stands twice, or with another of ``by``, is covered once."""
    kind = "doc_id int, start int, end int, label string"
    gold = spark.createDataFrame([(1, 0, 4, "A"), (1, 0, 4, "A"), (1, 5, 9, None), (1, None, 9, "A"), (None, 0, 4, "A"), (2, 0, 4, "B")], kind)
    pred = spark.createDataFrame([(1, 0, 4, "A"), (1, 0, 4, "B"), (1, 5, 9, None), (1, None, 9, "A"), (None, 0, 4, "A"), (3, 0, 4, "B")], kind)
    assert {tuple(r) for r in score.score_exact(gold, pred).collect()} == {(1, 3, 1, 1, 1), (None, 0, 0, 1, 1), (2, 0, 0, 0, 1), (3, 0, 0, 1, 0)}
    assert {tuple(r)[:4] for r in score.score_by_label(gold, pred).collect()} == {("A", 1, 4, 3), ("B", 0, 1, 2), (None, 0, 1, 1)}
    both = gold.where("doc_id = 1 and start = 0").unionByName(spark.createDataFrame([(1, 5, 9, None)], kind)).withColumn("k", F.lit(1))
    got = score.address_coverage(both.unionByName(both.withColumn("k", F.lit(2))), pred, ["k"]).collect()
    assert {tuple(r) for r in got} == {(1, 2, 2, 0, 1.0), (2, 2, 2, 0, 1.0)}


def test_missing_groups_are_sought_once():
    """20,000 entities that a text of a million characters hasn't: each search for them would read it to its end."""
    token = lambda i, w, tag: {"word": w, "entity": tag, "score": 0.9, "index": i}
    long, tokens = "ab cd " * 170_000 + "Bo", [token(i, "Zoe", "B-PER") for i in range(0, 40_000, 2)] + [token(50_000, "Bo", "B-PER")]
    began = time.process_time()
    assert [(d["start"], d["value"]) for d in mt.reconstruct(long, tokens)] == [(len(long) - 2, "Bo")]
    assert time.process_time() - began < 2


def test_tokens_as_columns():
    tokens = [{"entity": tag, "score": 0.9, "index": i, "word": w, "start": None, "end": None} for i, (w, tag) in enumerate([("Hej", None), ("Ann", "B-PER"), ("##a", "I-PER"), ("Berg", "I-PER"), ("!", "O")])]
    none, some, empty = mt._streams(pa.array([None, tokens, []], to_arrow_type(mt.TOKENS)))
    assert none is None and mt.reconstruct("x", empty) == []
    assert mt.reconstruct("Hej Anna Berg!", some) == mt.reconstruct("Hej Anna Berg!", tokens) == [{"start": 4, "end": 13, "value": "Anna Berg", "label": "NAMN"}]


def test_contained_shuffles_no_run_of_documents(spark, monkeypatch):
    run = registry.QUERIES["benchmark_contained"]
    df = run(spark, SMALL)
    assert "SortMergeJoin" not in plan(df) and len(exchanges(df)) == 2  # items' runs, found pairs
    rows = {tuple(r) for r in df.collect()}
    assert rows
    monkeypatch.setattr(corpus, "_FEW_RUNS", 1)
    df = run(spark, SMALL)
    assert "sha2" in plan(df) and {tuple(r) for r in df.collect()} == rows


def test_matches_hold_few_objects():
    """Matches of a batch are kept as Arrow has them: some 20 bytes each, where Python objects take over 150."""
    rows = [["ab c", None, "", "é", "1d"], [], [None], ["x" * 3, "é𝄞 é"]]
    find = lambda t: [{"start": m.start(), "end": m.end(), "value": m.group()} for m in re.finditer(r"[^\W\d]+|𝄞", t)]
    for r in rows:
        assert text.match_array(r"[^\W\d]+|𝄞|\b")(pa.array(r, pa.string())).to_pylist() == [None if t is None else find(t) for t in r]
        assert text.match_array(r"[^\W\d]+|𝄞|\b")(pa.array(["zz", *r], pa.string())[1:]).to_pylist() == [None if t is None else find(t) for t in r]
    texts = pa.array(["ab " * 1000] * 300)
    tracemalloc.start()
    got = text.match_array("[a-z]+")(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got.values) == 300_000 and peak < 30 * len(got.values)


def test_texts_one_at_a_time(spark):
    df = spark.createDataFrame([("A\u00ad ｘ  Σ",), (None,), ("",)], "t string")
    got = df.select(text.canonicalize("t"), text.nfkc_lower("t"), text.duplicate_key("t")).collect()
    assert [tuple(r) for r in got] == [("A x  Σ", "a\u00ad x  σ", "a\u00ad x σ"), (None, None, None), ("", "", "")]
    assert "PandasUDF" not in plan(df.select(text.duplicate_key("t"))) and "sha2" in plan(registry.QUERIES["gold_issues"](spark, SMALL))
