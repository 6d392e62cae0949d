"""Scoring queries over gold and predicted spans made from lineitem keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import score as sc
from .common import table
from .intervals import GOLD, PRED, TYPED, gold, items, predicted, typed


def score_exact(spark, sf_dir):
    return sc.score_exact(gold(spark, sf_dir), typed(spark, sf_dir))


def score_micro(spark, sf_dir):
    m = sc.micro(score_exact(spark, sf_dir))
    return m.select("tp", "typed_tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "typed_f1")])


def score_by_label(spark, sf_dir):
    s = sc.score_by_label(gold(spark, sf_dir), typed(spark, sf_dir))
    return s.select("label", "tp", "n_gold", "n_predicted", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def score_greedy(spark, sf_dir):
    """Matched one to one in order, by overlap and label."""
    return sc.score_greedy(gold(spark, sf_dir), typed(spark, sf_dir))


def false_positives(spark, sf_dir):
    """Predictions of returned items that no such gold span touches, by the kind of their order."""
    p = typed(spark, sf_dir).withColumn("kind", F.col("doc_id") % 3)
    return sc.false_positives(gold(spark, sf_dir), p, "R", ["kind"])


def redaction_recall(spark, sf_dir):
    r = sc.redaction_recall(gold(spark, sf_dir), typed(spark, sf_dir))
    return r.select("n_gold", "n_predicted", "masked", "typed", F.round("redaction_recall", 6).alias("redaction_recall"), F.round("typed_precision", 6).alias("typed_precision"), F.round("typed_recall", 6).alias("typed_recall"))


def _cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("arm"), F.substring("o_orderpriority", 1, 1).alias("tail"), (F.col("o_custkey") % 7 == 0).alias("leaked"))


def leak_rate_grouping_sets(spark, sf_dir):
    r = sc.leak_rate(_cells(spark, sf_dir), [[], ["type"], ["type", "arm"], ["type", "tail"]])
    return r.select("type", "arm", "tail", "n", "leaks", F.round("rate", 6).alias("rate"))


def _tokens(spark, sf_dir):
    li = items(spark, sf_dir)
    start = (F.col("l_linenumber") * 10).cast("int")
    return li.select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 4).alias("end"), F.col("l_shipdate").cast("date").cast("string").alias("value")).distinct()


def token_retention(spark, sf_dir):
    rates, _ = sc.token_retention(_tokens(spark, sf_dir), predicted(spark, sf_dir))
    return rates.select("tokens", "flagged", F.round("retention", 6).alias("retention"), F.round("clean_texts", 6).alias("clean_texts"))


def flagged_terms(spark, sf_dir):
    return sc.token_retention(_tokens(spark, sf_dir), predicted(spark, sf_dir))[1]


_TOKENS = "k AS (SELECT DISTINCT l_orderkey AS doc_id, (l_linenumber * 10)::INT AS s, (l_linenumber * 10 + 4)::INT AS e, l_shipdate::DATE::VARCHAR AS value FROM lineitem), f AS (SELECT *, EXISTS (SELECT 1 FROM p WHERE p.doc_id = k.doc_id AND p.s < k.e AND k.s < p.e)::INT AS hit FROM k)"


def address_coverage(spark, sf_dir):
    g = gold(spark, sf_dir).withColumn("region", F.col("doc_id") % 3)
    c = sc.address_coverage(g, predicted(spark, sf_dir), ["region"])
    return c.select("region", "n", "full", "missed", F.round("coverage", 6).alias("coverage"))


def _outcomes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    redacted = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(" [NAMN_1]"))).otherwise("[NAMN_1]")
    return sc.domain_score(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), redacted.alias("redacted"), F.col("p_name").alias("value")))


def domain_score(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("id", "outcome")


def category_rollup(spark, sf_dir):
    return sc.category_rollup(_outcomes(spark, sf_dir))


_OUTCOME = """o AS (SELECT p_partkey AS id, p_brand AS category, CASE WHEN p_size % 3 = 0 THEN 'miss'
    WHEN p_size % 3 = 1 AND NOT contains(p_name, ' ') THEN 'miss'
    WHEN p_size % 3 = 1 AND length(string_split(p_name, ' ')[1]) >= 4 THEN 'partial' ELSE 'hit' END AS outcome FROM part)"""


def latency_quantiles(spark, sf_dir):
    return sc.quantiles(table(spark, sf_dir, "orders"), "o_totalprice")


def vocab_topk(spark, sf_dir):
    """The 50 most frequent words of documents, two of them certain."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    return sc.vocabulary(words, 50, keep=["the", "and"])


def label_agreement(spark, sf_dir):
    """Labels against a rule (more than 200 characters is good): a binary score."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    both = l.join(d, "doc_id").select((F.col("quality") == 1).alias("gold"), (F.col("n_chars") > 200).alias("pred"))
    return both.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (score_exact, score_micro, score_by_label, score_greedy, false_positives, redaction_recall, leak_rate_grouping_sets, token_retention, flagged_terms, address_coverage, domain_score, category_rollup, latency_quantiles, vocab_topk, label_agreement)
}

_EXACT = f"""{GOLD}, {TYPED}, gc AS (SELECT doc_id, s, e, count(*) AS g FROM g GROUP BY ALL), pc AS (SELECT doc_id, s, e, count(*) AS p FROM t GROUP BY ALL),
    tc AS (SELECT doc_id, s, e, count(*) AS t FROM g JOIN t USING (doc_id, s, e, label) GROUP BY ALL),
    b AS (SELECT doc_id, s, e, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM gc FULL JOIN pc USING (doc_id, s, e)),
    x AS (SELECT doc_id, sum(least(g, p))::BIGINT AS tp, sum(least(coalesce(t, 0), g, p))::BIGINT AS typed_tp, sum(p - least(g, p))::BIGINT AS fp, sum(g - least(g, p))::BIGINT AS fn FROM b LEFT JOIN tc USING (doc_id, s, e) GROUP BY doc_id)"""
ORACLES = {
    "false_positives": f"WITH {GOLD}, {TYPED} SELECT doc_id % 3 AS kind, count(*) AS n FROM t WHERE label = 'R' AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = t.doc_id AND g.label = 'R' AND g.s < t.e AND t.s < g.e) GROUP BY 1",
    "score_greedy": f"""
        WITH RECURSIVE {GOLD}, {TYPED}, a AS (SELECT doc_id, s, e, label, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, label) AS j FROM g),
        b AS (SELECT doc_id, s, e, label, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, label) AS i FROM t),
        l AS (SELECT doc_id, list({{'j': j, 's': s, 'e': e, 'label': label}} ORDER BY j) AS gs FROM a GROUP BY doc_id),
        f AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, []::BIGINT[] AS used FROM b
            UNION ALL SELECT doc_id, i, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END
            FROM (SELECT b.doc_id, b.i, f.used, list_filter(coalesce(l.gs, []), lambda x: x.label = b.label AND x.s < b.e AND b.s < x.e AND NOT list_contains(f.used, x.j))[1].j AS j
                FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i + 1 LEFT JOIN l ON l.doc_id = f.doc_id)),
        h AS (SELECT doc_id, max(len(used)) AS tp, max(i) AS n FROM f GROUP BY doc_id)
        SELECT doc_id, coalesce(tp, 0) AS tp, coalesce(n, 0) - coalesce(tp, 0) AS fp, coalesce(len(gs), 0) - coalesce(tp, 0) AS fn FROM h FULL JOIN l USING (doc_id)""",
    "score_exact": f"WITH {_EXACT} SELECT * FROM x",
    "score_micro": f"""WITH {_EXACT}, s AS (SELECT sum(tp)::BIGINT AS tp, sum(typed_tp)::BIGINT AS typed_tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM x)
        SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1, round(2.0 * typed_tp / (2 * tp + fp + fn), 6)::DOUBLE AS typed_f1 FROM s""",
    "score_by_label": f"""WITH {GOLD}, {TYPED}, h AS (SELECT label, count(*) AS tp FROM g JOIN t USING (doc_id, s, e, label) GROUP BY label)
        SELECT label, tp, n_gold, n_predicted, round(tp / n_predicted, 6) AS precision, round(tp / n_gold, 6) AS recall
        FROM h JOIN (SELECT label, count(*) AS n_gold FROM g GROUP BY label) USING (label) JOIN (SELECT label, count(*) AS n_predicted FROM t GROUP BY label) USING (label)""",
    "redaction_recall": f"""WITH {GOLD}, {TYPED}, a AS (SELECT count(*) AS n_gold, count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE t.doc_id = g.doc_id AND g.s < t.e AND t.s < g.e)) AS masked,
            count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE t.doc_id = g.doc_id AND g.s < t.e AND t.s < g.e AND t.label = g.label)) AS typed FROM g),
        b AS (SELECT count(*) AS n_predicted, count(*) FILTER (EXISTS (SELECT 1 FROM g WHERE t.doc_id = g.doc_id AND g.s < t.e AND t.s < g.e AND t.label = g.label)) AS tp FROM t)
        SELECT n_gold, n_predicted, masked, typed, round(masked / n_gold, 6) AS redaction_recall, round(tp / n_predicted, 6) AS typed_precision, round(typed / n_gold, 6) AS typed_recall FROM a, b""",
    "leak_rate_grouping_sets": """WITH c AS (SELECT o_orderstatus AS type, o_orderpriority AS arm, substr(o_orderpriority, 1, 1) AS tail, (o_custkey % 7 = 0)::INT AS leaked FROM orders)
        SELECT type, arm, tail, count(*) AS n, sum(leaked)::BIGINT AS leaks, round(avg(leaked), 6) AS rate FROM c GROUP BY GROUPING SETS ((), (type), (type, arm), (type, tail))""",
    "token_retention": f"""WITH {PRED}, {_TOKENS}, d AS (SELECT doc_id, count(*) AS n, sum(hit) AS h FROM f GROUP BY doc_id)
        SELECT sum(n)::BIGINT AS tokens, sum(h)::BIGINT AS flagged, round(1 - sum(h) / sum(n), 6) AS retention, round(avg((h = 0)::INT), 6) AS clean_texts FROM d""",
    "flagged_terms": f"WITH {PRED}, {_TOKENS} SELECT value, count(*) AS n FROM f WHERE hit = 1 GROUP BY value ORDER BY n DESC, value LIMIT 25",
    "address_coverage": f"""WITH {GOLD}, {PRED}, c AS (SELECT doc_id, s, e, label, (SELECT count(DISTINCT x) FROM (SELECT unnest(range(p.s, p.e)) AS x FROM p WHERE p.doc_id = g.doc_id) WHERE x >= g.s AND x < g.e) AS covered FROM g)
        SELECT doc_id % 3 AS region, count(*) AS n, sum((covered = e - s)::INT)::BIGINT AS "full", sum((covered = 0)::INT)::BIGINT AS missed, round(sum(covered) / sum(e - s), 6) AS coverage FROM c GROUP BY ALL""",
    "domain_score": f"WITH {_OUTCOME} SELECT id, outcome FROM o",
    "category_rollup": f"WITH {_OUTCOME} SELECT category, count(*) AS n, count(*) FILTER (outcome = 'hit') AS hit, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'miss') AS miss FROM o GROUP BY ROLLUP (category)",
    "latency_quantiles": "WITH s AS (SELECT list(o_totalprice ORDER BY o_totalprice) AS v FROM orders) SELECT v[1 + least(len(v) - 1, floor(0.5 * len(v)))::INT] AS p50, v[1 + least(len(v) - 1, floor(0.95 * len(v)))::INT] AS p95 FROM s",
    "vocab_topk": "WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY token IN ('the', 'and') DESC, n DESC, token LIMIT 50",
    "label_agreement": "SELECT quality = 1 AS gold, n_chars > 200 AS pred, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
}
