"""Every query of the library against its SQL, and those without SQL on their own terms."""

import pytest
from oracle import compare

from hushframe import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    compare(spark, name, SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() >= 200 and set(e.oracle_sql()) <= set(e.queries())


def test_interval_brute_force(spark):
    from hushframe.operators import spans as sp
    from hushframe.plans.intervals import gold, predicted

    g, p = gold(spark, SMALL), predicted(spark, SMALL)
    marks = {}
    for r in p.collect():
        marks.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    want = {(r.doc_id, r.start, r.end, r.label): len(marks.get(r.doc_id, set()) & set(range(r.start, r.end))) for r in g.collect()}
    assert {(r.doc_id, r.start, r.end, r.label): r.covered for r in sp.covered_chars(g, p).collect()} == want
    left = {}
    for r in sp.subtract_intervals(g, p).collect():
        left.setdefault((r.doc_id, r.label), set()).update(range(r.start, r.end))
    rest = {}
    for r in g.collect():
        if chars := set(range(r.start, r.end)) - marks.get(r.doc_id, set()):
            rest.setdefault((r.doc_id, r.label), set()).update(chars)
    assert left == rest


def test_greedy_and_samples(spark):
    from hushframe.operators.score import greedy
    from hushframe.operators.training import fnv, hash_sample

    g = [{"start": 0, "end": 5, "label": "A"}, {"start": 4, "end": 9, "label": "B"}]
    p = [{"start": 3, "end": 6, "label": "B"}, {"start": 3, "end": 6, "label": "B"}]
    assert greedy(g, p, typed=True, exact=False) == 1 and greedy(g, p, typed=False, exact=False) == 2
    assert fnv("a") == 0xE40C292C / 2**32
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id for r in hash_sample(docs, "doc_id", 0.1, "dev:").collect()}
    assert got == {r.doc_id for r in docs.collect() if fnv(f"dev:{r.doc_id}") < 0.1}
