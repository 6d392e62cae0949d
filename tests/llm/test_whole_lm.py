"""op5 with trigrams of any count, those seen once too."""

import math

import pytest
from test_lm_score import SF, Brute

from hushframe.llm.lm_score import STEP, lm_scores


def test_query_holds_every_trigram(spark):
    import __spark_entry__ as e

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    whole, cut = Brute([r.text for r in rows], keep=1), Brute([r.text for r in rows], keep=2)
    got = {r.doc_id: r for r in e.queries()["op5_lm_score"](spark, SF).collect()}
    moved = 0
    for r in rows[:80]:
        lp, n = whole.score(r.text)
        assert got[r.doc_id].n_tokens == n
        assert abs(got[r.doc_id].log_prob - lp) / n < 0.04
        assert abs(math.exp(-got[r.doc_id].log_prob / n) / got[r.doc_id].perplexity - 1) < 1e-9
        moved += abs(cut.score(r.text)[0] - lp) / n > 0.1
    assert moved  # the cut is seen in these documents


@pytest.mark.parametrize("texts", [["a b c", "a b d", None, "", "z " * 3000, "once only"]])
def test_edges_with_all_trigrams(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    brute = Brute(texts, keep=1)
    got = {r.doc_id: r for r in lm_scores(df, keep=1).collect()}
    assert got[2].log_prob is None
    for i, t in enumerate(texts):
        if t is not None:
            lp, n = brute.score(t)
            assert abs(got[i].log_prob - lp) / n <= STEP
