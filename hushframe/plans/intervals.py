"""Queries of the span algebra; intervals are made from lineitem and events keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spans as sp
from .common import dealt, table

#: Items of orders that are one task's work.
_ITEMS = 200_000


def items(spark, sf_dir) -> DataFrame:
    """Items dealt by order: what is made of them and meets by order has no other shuffle."""
    return dealt(table(spark, sf_dir, "lineitem"), "l_orderkey", _ITEMS)


def gold(spark, sf_dir) -> DataFrame:
    li = items(spark, sf_dir)
    start = (F.col("l_partkey") % 60).cast("int")
    return li.select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 2 + F.col("l_suppkey") % 9).cast("int").alias("end"), F.col("l_returnflag").alias("label")).distinct()


def predicted(spark, sf_dir) -> DataFrame:
    li = items(spark, sf_dir)
    start = (F.col("l_partkey") % 60 + F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("l_suppkey") % 7)).cast("int")
    return li.where("l_suppkey % 5 > 0").select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 2 + F.col("l_suppkey") % 9).cast("int").alias("end"), F.col("l_linestatus").alias("label"), F.col("l_returnflag").alias("flag")).distinct()


def typed(spark, sf_dir) -> DataFrame:
    """Predictions whose label is the flag."""
    return predicted(spark, sf_dir).select("doc_id", "start", "end", F.col("flag").alias("label")).distinct()


GOLD = """g AS (SELECT DISTINCT l_orderkey AS doc_id, (l_partkey % 60)::INT AS s, (l_partkey % 60 + 2 + l_suppkey % 9)::INT AS e, l_returnflag AS label FROM lineitem)"""
PRED = """p AS (SELECT DISTINCT l_orderkey AS doc_id, (l_partkey % 60 + CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 7 END)::INT AS s, (l_partkey % 60 + CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 7 END + 2 + l_suppkey % 9)::INT AS e, l_linestatus AS label, l_returnflag AS flag FROM lineitem WHERE l_suppkey % 5 > 0)"""
TYPED = PRED + ", t AS (SELECT DISTINCT doc_id, s, e, flag AS label FROM p)"
TOUCH = "g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e"


def interval_overlap_join(spark, sf_dir):
    j = sp.overlap_join(gold(spark, sf_dir), predicted(spark, sf_dir))
    return j.groupBy("a.doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("a.end", "b.end") - F.greatest("a.start", "b.start")).alias("chars"))


def exact_span_join(spark, sf_dir):
    return sp.exact_join(gold(spark, sf_dir), typed(spark, sf_dir).withColumnRenamed("label", "other")).groupBy("label", "other").agg(F.count(F.lit(1)).alias("n"))


def leaks(spark, sf_dir):
    return sp.leaks(gold(spark, sf_dir), predicted(spark, sf_dir))


def merge_intervals(spark, sf_dir):
    return sp.merge_intervals(gold(spark, sf_dir))


def merge_adjacent(spark, sf_dir):
    return sp.merge_adjacent(gold(spark, sf_dir), gap=1)


def subtract_intervals(spark, sf_dir):
    """What predictions leave of gold spans, by document: pieces and characters."""
    left = sp.subtract_intervals(gold(spark, sf_dir), predicted(spark, sf_dir))
    return left.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("chars"))


def merge_feature_spans(spark, sf_dir):
    return sp.merge_sources(gold(spark, sf_dir), predicted(spark, sf_dir).drop("flag").distinct())


def resolve_overlaps(spark, sf_dir):
    """Overlaps resolved in texts of digits made to hold the gold spans."""
    from ..operators.redact import resolve_overlaps as resolve

    g = gold(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.lit("").alias("value"), "label"))).alias("f"))
    out = g.select("doc_id", F.explode(resolve(F.lit("0" * 80), F.col("f"))).alias("s"))
    return out.select("doc_id", "s.start", "s.end", "s.label")


def trim_edges(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("start"), F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("value"))
    return sp.trim_edges(t.withColumn("end", F.length("value")))


QUERIES = {f.__name__: f for f in (interval_overlap_join, exact_span_join, leaks, merge_intervals, merge_adjacent, subtract_intervals, merge_feature_spans, resolve_overlaps, trim_edges)}

ORACLES = {
    "interval_overlap_join": f"WITH {GOLD}, {PRED} SELECT g.doc_id, count(*) AS n, sum(least(g.e, p.e) - greatest(g.s, p.s))::BIGINT AS chars FROM g JOIN p ON {TOUCH} GROUP BY g.doc_id",
    "exact_span_join": f"WITH {GOLD}, {TYPED} SELECT g.label, t.label AS other, count(*) AS n FROM g JOIN t USING (doc_id, s, e) GROUP BY ALL",
    "leaks": f'WITH {GOLD}, {PRED} SELECT doc_id, s AS start, e AS "end", label FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE {TOUCH})',
    "merge_intervals": f"""
        WITH {GOLD}, r AS (SELECT *, max(e) OVER w AS reach FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY s, e DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e DESC, label ROWS UNBOUNDED PRECEDING) AS k FROM r)
        SELECT doc_id, min(s) AS start, max(e) AS "end", first(label ORDER BY s, e DESC, label) AS label FROM i GROUP BY doc_id, k""",
    "resolve_overlaps": f"""
        WITH RECURSIVE {GOLD}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, s - e, label) AS i FROM g),
        f AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, -1 AS cur, 0 AS s, 0 AS e, '' AS label, FALSE AS kept FROM g
            UNION ALL SELECT r.doc_id, r.i, CASE WHEN k THEN r.e ELSE cur END, greatest(r.s, cur), r.e, r.label, k
            FROM (SELECT r.*, f.cur, r.s >= f.cur OR r.e - f.cur >= 2 AS k FROM f JOIN r ON r.doc_id = f.doc_id AND r.i = f.i + 1) r)
        SELECT doc_id, s AS start, e AS "end", label FROM f WHERE kept""",
    "merge_adjacent": f"""
        WITH {GOLD}, r AS (SELECT *, max(e) OVER w AS reach FROM g WINDOW w AS (PARTITION BY doc_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r)
        SELECT doc_id, label, min(s) AS start, max(e) AS "end" FROM i GROUP BY doc_id, label, k""",
    "subtract_intervals": f"""
        WITH {GOLD}, {PRED}, c AS (SELECT doc_id, s, e, label, unnest(range(s, e)) AS x FROM g)
        SELECT doc_id, count(*)::BIGINT AS chars FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = c.doc_id AND p.s <= c.x AND c.x < p.e) GROUP BY doc_id""",
    "merge_feature_spans": f"""
        WITH {GOLD}, {PRED}, u AS (SELECT doc_id, s, e, label, 0 AS k FROM g UNION ALL SELECT DISTINCT doc_id, s, e, label, 1 FROM p)
        SELECT doc_id, s AS start, e AS "end", label FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY k, label) = 1""",
    "trim_edges": """SELECT p_partkey AS doc_id, 1 AS start, (length(p_name) + 1)::INT AS "end", p_name AS value FROM part""",
}
