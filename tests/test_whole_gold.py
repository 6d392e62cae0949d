"""gold_issues: all of its rules, against plain Python."""

import unicodedata

import pytest

from hushframe import registry
from hushframe.operators import detect
from hushframe.operators.corpus import gold_issues

SMALL = "/root/testdata/sf0.001"
LANGS = ("en", "de", "fr", "es")


def key(t):
    return " ".join(unicodedata.normalize("NFKC", t or "").split()).lower()


def repeats(texts):
    keys = [k for k in map(key, texts) if k]
    return len(keys) - len(set(keys))


def overlaps(spans):
    return sum(any(s < b and a < e for a, b in spans[:i]) for i, (s, e) in enumerate(spans))


def test_query_reports_every_rule(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {}
    for name in ("card", "bankgiro"):
        for r in detect.native_spans(rows, name).collect():
            found.setdefault(r.doc_id, []).append((r.start, r.end))
    rows = rows.collect()
    want = {
        "bad date": sum(r.doc_id % 10 == 0 for r in rows),
        "too few reviewed": int(sum(r.doc_id % 8 == 0 for r in rows) < 0.2 * len(rows)),
        "repeated text": repeats(r.text for r in rows),
        "bad register": sum(r.lang not in LANGS for r in rows),
        "missing register": len(set(LANGS) - {r.lang for r in rows}),
        "overlapping entities": sum(map(overlaps, found.values())),
    }
    assert want["repeated text"] > 0
    assert {r.issue: r.n for r in registry.QUERIES["gold_issues"](spark, SMALL).collect()} == {k: n for k, n in want.items() if n}


@pytest.mark.parametrize("required,missing", [(("support", "healthcare"), 1), ((), 0)])
def test_operator_on_a_fixture(spark, required, missing):
    rows = [
        (1, "Ａb  c", "W1", "support", [(0, 2), (1, 3), (3, 4)], "2024-02-28", True),
        (2, "ab c ", "W2", "chat", [(0, 5), (0, 5), (4, 6)], "2024-02-28", True),
        (3, "other", "W3", None, None, "2024-02-28", True),
        (4, None, "W3", "support", [], "2024-02-28", True),
        (5, "", "W3", "support", [(0, 1)], "2024-02-28", None),
        (6, " ", "W3", "support", [(5, 6), (0, 9)], "2024-02-28", None),
    ]
    df = spark.createDataFrame(rows, "id int, text string, writer string, register string, entities array<struct<start:int,end:int>>, collected string, second_reviewed boolean")
    got = {r.issue: r.n for r in gold_issues(df, least_rows=0, required=required).collect()}
    want = {"no text": 3, "bad register": 2, "repeated text": 1, "overlapping entities": 4, "missing register": missing}
    assert got == {k: n for k, n in want.items() if n}
