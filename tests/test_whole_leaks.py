"""eval_leak and absent_names over all documents, against plain Python."""

import collections
import re
import unicodedata

from hushframe import registry
from hushframe.operators.corpus import absent_names, eval_leak

SMALL = "/root/testdata/sf0.001"


def surface(t):
    return "".join(c for c in t if unicodedata.category(c)[0] in "LN").lower()


def test_leaks_of_any_parity(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    n = collections.Counter(surface(r.text) for r in rows)
    want = sorted(r.doc_id for r in rows if surface(r.text) and n[surface(r.text)] > 1)
    assert want and any(i % 2 == 0 for i in want)
    assert sorted(r.doc_id for r in registry.QUERIES["eval_leak"](spark, SMALL).collect()) == want


def test_leaks_on_a_fixture(spark):
    df = spark.createDataFrame([(1, "A b"), (3, "ab!"), (2, "x"), (4, "X."), (5, "own"), (6, "..."), (8, "!"), (7, None), (9, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in eval_leak(df, df, id_col="doc_id").collect()) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in eval_leak(df, df.where("doc_id = 5")).collect()) == [5]


def test_absent_names_of_all_documents(spark):
    texts = [r.text.lower() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    names = {x for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() for x in re.findall("[A-Z][a-z]+", r.text)}
    want = sorted(x for x in names if not any(x.lower() in t for t in texts))
    assert sorted(r.name for r in registry.QUERIES["absent_names"](spark, SMALL).collect()) == want


def test_absent_names_query_on_a_fixture(spark, tmp_path):
    spark.createDataFrame([(1, "Berg Lind Quist Alm Ek")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "no name", "en"), (2, "herr berg", "de"), (3, "LIND", None), (4, "cederquistar", "fr"), (5, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.name for r in registry.QUERIES["absent_names"](spark, str(tmp_path)).collect()) == ["Alm", "Ek"]


def test_absent_names_with_other_signs(spark):
    names = spark.createDataFrame([("von Essen",), ("O'Neil",), ("Ann-Mari",), ("von Ek",), ("D'A",)], "name string")
    texts = spark.createDataFrame([("Hans VON ESSEN bor",), ("o'neils",), ("Joann-Marie",), (None,)], "text string")
    assert sorted(r.name for r in absent_names(names, texts).collect()) == ["D'A", "von Ek"]
