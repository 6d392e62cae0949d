"""Algebra of spans in long form: rows of (keys, start, end, ...), ends exclusive.

All operators are equi-joins or windows on the document's keys, so spans shuffle by document only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import SPACE

KEYS = ("doc_id",)


def overlap(a: str = "a", b: str = "b") -> Column:
    """I1."""
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def _on(keys, more: Column) -> Column:
    for k in keys:
        more = (F.col(f"a.{k}") == F.col(f"b.{k}")) & more
    return more


def overlap_join(a: DataFrame, b: DataFrame, keys=KEYS, how: str = "inner") -> DataFrame:
    """I1, I3 (how="left_anti"), I4, I5, I7 (how="left_semi")."""
    return a.alias("a").join(b.alias("b"), _on(keys, overlap()), how)


def exact_join(a: DataFrame, b: DataFrame, keys=KEYS, how: str = "inner") -> DataFrame:
    """I2."""
    return a.join(b, [*keys, "start", "end"], how)


def leaks(gold: DataFrame, predicted: DataFrame, keys=KEYS) -> DataFrame:
    """Gold spans that no prediction touches."""
    return overlap_join(gold, predicted, keys, "left_anti")


def _islands(df: DataFrame, part, order, starts_new: Column) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_new", F.coalesce(starts_new.cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merge_intervals(df: DataFrame, keys=KEYS) -> DataFrame:
    """M3: overlapping spans become their union with the first one's label."""
    w = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "label")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_reach", reach)
    out = _islands(marked, keys, ["start", F.desc("end"), "label"], F.col("start") >= F.col("_reach"))
    first = F.min_by("label", F.struct(F.col("start"), -F.col("end"), F.col("label")))
    return out.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("label")).drop("_island")


def merge_adjacent(df: DataFrame, gap: int = 1, keys=KEYS) -> DataFrame:
    """I8: spans of one label with at most ``gap`` characters between them become one."""
    w = Window.partitionBy(*keys, "label").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_reach", reach)
    out = _islands(marked, [*keys, "label"], ["start", "end"], F.col("start") > F.col("_reach") + gap)
    return out.groupBy(*keys, "label", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def merge_blank_gaps(spans: DataFrame, texts: DataFrame, keys=KEYS, text: str = "text") -> DataFrame:
    """I8: (keys, label, start, end): spans of a label that touch, overlap or have only white space between them become one."""
    blank = f"\\A[{SPACE}]*\\z"
    w = Window.partitionBy(*keys, "label").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # only the gaps are looked up in the texts, and with them the texts of rows that have spans
    near = spans.withColumn("_reach", reach).join(texts.select(*keys, F.col(text).alias("_text")), list(keys))
    gap = F.substr(F.col("_text"), F.col("_reach") + 1, F.greatest(F.col("start") - F.col("_reach"), F.lit(0)))
    opens = F.col("_reach").isNull() | ~gap.rlike(blank)
    marked = near.withColumn("_new", F.when(opens, 1).otherwise(0)).drop("_text", "_reach")
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "label", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def subtract_intervals(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    """What of each span of ``a`` no span of ``b`` covers; a span may come back in pieces."""
    cover = merge_intervals(b.withColumn("label", F.lit("")) if "label" not in b.columns else b, keys)
    near = a.alias("a").join(cover.alias("b"), _on(keys, overlap()), "left").select(*[F.col(f"a.{c}") for c in a.columns], F.col("b.start").alias("_s"), F.col("b.end").alias("_e"))
    own = [c for c in a.columns]
    cuts = near.groupBy(*own).agg(F.array_sort(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"))))).alias("_cuts"))
    begins = F.concat(F.array(F.col("start")), F.transform("_cuts", lambda x: x["e"]))
    ends = F.concat(F.transform("_cuts", lambda x: x["s"]), F.array(F.col("end")))
    pieces = F.filter(F.arrays_zip(begins.alias("x"), ends.alias("y")), lambda p: p["x"] < p["y"])
    rest = [c for c in own if c not in ("start", "end")]
    return cuts.select(*rest, F.explode(pieces).alias("p")).select(*rest, F.col("p.x").alias("start"), F.col("p.y").alias("end"))


def covered_chars(gold: DataFrame, predicted: DataFrame, keys=KEYS, own: Sequence[str] | None = None) -> DataFrame:
    """Of each gold span, how many characters predictions cover; ``own``: the columns that make a gold span, its keys, place and label if not given."""
    union = merge_intervals(predicted.withColumn("label", F.lit("")), keys)
    part = F.when(F.col("b.start").isNotNull(), F.least("a.end", "b.end") - F.greatest("a.start", "b.start"))  # least() passes over nulls
    near = gold.alias("a").join(union.alias("b"), _on(keys, overlap()), "left")
    columns = [F.col(f"a.{c}") for c in own or (*keys, "start", "end", "label")]
    return near.groupBy(*columns).agg(F.coalesce(F.sum(part), F.lit(0)).alias("covered"))


def merge_sources(first: DataFrame, second: DataFrame, keys=KEYS) -> DataFrame:
    """All spans once; where both sources have the same boundaries, the first's label."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    w = Window.partitionBy(*keys, "start", "end").orderBy("_p", "label")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def trim_edges(df: DataFrame) -> DataFrame:
    """White space at the edges of a span's value leaves the span."""
    lead = F.length("value") - F.length(F.regexp_replace("value", r"^\s+", ""))
    tail = F.length("value") - F.length(F.regexp_replace("value", r"\s+$", ""))
    out = df.withColumn("_a", F.col("start") + lead).withColumn("_b", F.col("end") - tail).where("_a < _b")
    return out.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).withColumn("start", F.col("_a")).withColumn("end", F.col("_b")).drop("_a", "_b")


def clamp(start: Column, end: Column, length: Column) -> Column:
    """C5."""
    lo = F.least(F.greatest(F.coalesce(start, F.lit(0)), F.lit(0)), length)
    return F.struct(lo.alias("start"), F.greatest(lo, F.least(F.greatest(F.coalesce(end, F.lit(0)), F.lit(0)), length)).alias("end"))
