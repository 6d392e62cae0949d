from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushframe.llm.quality_rules import GRIDS, Scorer, accepted_scores, binomial_cdf, calibrate, choose, quality_filter

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 50, 0.05), (40, 400, 0.1), (5, 5, 0.3), (0, 0, 0.5), (2, 1000, 0.0083)])
def test_binomial_is_exact(k, n, p):
    q = Fraction(p)
    want = sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))
    assert abs(binomial_cdf(k, n, p) - float(want)) < 1e-10


def test_cutoffs_keep_their_promise():
    rng, bad = np.random.default_rng(1), 0
    for _ in range(200):  # good documents whose true false rejection is known: uniform scores over the grid
        counts = {}
        for rule, grid in GRIDS.items():
            good = rng.multinomial(2000, [0.97] + [0.03 / len(grid)] * len(grid))
            counts["s", rule] = good, rng.multinomial(500, [1 / (len(grid) + 1)] * (len(grid) + 1))
        cutoffs, tests = choose(counts, 1, 0.05, 0.05)
        risk = sum(0.03 * (GRIDS[r].index(c) + 1) / len(GRIDS[r]) for (_, r), c in cutoffs.items())
        bad += risk > 0.05
        assert all(t["p"] <= 0.05 / len(GRIDS) for t in tests if t["certified"])
    assert bad <= 20


def test_scores():
    s = Scorer(["vile"])
    got = dict(zip(GRIDS, s("Vile vile $$$ WORD !? a")))
    assert got["lexicon_hits"] == 2 and got["symbol_share"] == 3 / 18 and got["bare_share"] == 2 / 6 and got["shout_share"] == 2 / 6
    assert s("  ") is None and s(None) is None and dict(zip(GRIDS, s("a a a b")))["repeat_share"] == 0.5


@pytest.fixture(scope="module")
def judged(spark):
    import __spark_entry__ as e

    return {r.doc_id for r in e.queries()["op6_quality_rules"](spark, SF).select("doc_id").collect()}


def test_query_keeps_clean_documents_and_rejects_bad_ones(spark, judged):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    marks = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in docs}
    for s in set(lang.values()):
        good = [i for i, m in marks.items() if lang[i] == s and m.quality == 1 and m.toxic == 0]
        assert sum(i not in judged for i in good) <= 0.05 * len(good)
    bad = [i for i, m in marks.items() if lang[i] == "en" and (m.quality == 0 or m.toxic == 1)]
    assert sum(i not in judged for i in bad) > 0.9 * len(bad)


def test_query_against_brute_force(spark, judged):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    policy, _ = calibrate(docs, labels)
    scorer, want = Scorer(policy.lexicon), set()
    for r in docs.collect():
        got = scorer(r.text)
        if got and all(x <= policy.cutoffs.get((r.lang, rule), float("inf")) for x, rule in zip(got, GRIDS)):
            want.add(r.doc_id)
    assert judged == want
    assert {r.doc_id for r in quality_filter(docs, labels).select("doc_id").collect()} == want


def test_edges(spark):
    rows = [(1, "fine words here", "en", 1.0), (1, "fine words here", "en", 1.0), (None, "x", None, 2.0), (2, None, "en", 3.0), (3, "", None, 4.0), (4, " \n", "de", 5.0), (5, "long " * 200_000, "de", 6.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, symbol_share double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (5, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_filter(df, labels)
    assert out.columns == df.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 1, 5]
    assert accepted_scores(df, labels).count() == 4
    assert quality_filter(df, labels.where("false")).count() == 4
    assert quality_filter(df.where("false"), labels).count() == 0


def test_many_is_one_call_a_text():
    s = Scorer(["vile", "ß"])
    texts = ["Vile vile $$$ WORD !? a", None, "", " \n", "a a a b", "STRAßE İvile Ⅷ x²  \u2003 €5", "=> <= 漢字 漢字", "vile-vile!"]
    some, rules = s.many(pa.array(texts, pa.string()))
    got = iter(zip(*(r.tolist() for r in rules)))
    assert [next(got) if x else None for x in some] == [s(t) for t in texts]


def labelled(spark, copies=1, strata=lambda k: "s"):
    """4,000 documents of which a tenth, all bad, have many symbols; a tenth of the good ones have some."""
    rows = []
    for k in range(4000):
        words = [f"w{k}a", f"w{k}b"] + (["$$$$$$$"] * 3 if k % 10 == 0 else ["$"] if k % 10 == 1 else [])
        rows += [(k * copies + c, " ".join(words), strata(k), int(k % 10 > 0)) for c in range(copies)]
    docs = spark.createDataFrame([r[:3] for r in rows], ["doc_id", "text", "lang"])
    return docs, spark.createDataFrame([(r[0], r[3], 0) for r in rows], "doc_id long, quality int, toxic int")


def test_cutoffs_against_brute_force(spark):
    """Certificates from plain counts of distinct contents, with exact fractions, not from the operator's scores or counts."""
    docs, labels = labelled(spark)
    policy, _ = calibrate(docs, labels)
    split = {r.text for r in docs.select("text", F.pmod(F.xxhash64(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit("lexicon")), F.lit(5)).alias("k")).where("k != 0").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    good_shares, bad_shares = [], []
    for r in docs.collect():
        if r.text in split:
            (bad_shares if r.doc_id in bad else good_shares).append(r.text.count("$") / sum(map(len, r.text.split())))
    certified, n, q = [], len(good_shares), Fraction(0.05 / 6)
    for cut in GRIDS["symbol_share"]:
        lost = sum(x > cut for x in good_shares)
        if sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(lost + 1)) > Fraction(0.05 / 6):
            break
        certified.append((sum(x > cut for x in bad_shares) - 10 * lost, cut))
    top = [c for g, c in certified if g == max(certified)[0]]
    assert policy.cutoffs["s", "symbol_share"] == top[len(top) // 2]


def test_copies_are_no_trials(spark):
    """Every text eight times gives the same certificates as once, and a copy never stands on both sides of the split."""
    one, eight = (calibrate(*labelled(spark, c))[0].cutoffs for c in (1, 8))
    assert one == eight and one


def test_any_stratum_type(spark):
    docs, labels = labelled(spark, strata=lambda k: k % 2 == 0)
    assert docs.schema["lang"].dataType.simpleString() == "boolean"
    docs = docs.withColumn("stratum", F.lit("x")).withColumn("cut_symbol_share", F.lit(0.0)).withColumn("content", F.lit(1)).withColumn("text_", F.lit("y"))
    kept = quality_filter(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.doc_id for r in accepted_scores(docs, labels).collect()} and len(ids) < 3700
