"""Scoring of predicted spans against gold ones: joins on the document, then conditional sums."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.patterns import SPACE
from ..functions.text import safe_lower_text

from .spans import KEYS, covered_chars, overlap_join


def ratio(a: Column, b: Column, empty: float = 1.0) -> Column:
    """A share; ``empty`` where there is nothing to share."""
    return F.when(b == 0, F.lit(empty)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def occurrences(texts: pd.Series, values: pd.Series) -> pd.Series:
    """All places of a value in a text, overlapping ones too."""

    def places(t, v):
        if t is None or not v:
            return None
        out, i = [], t.find(v)
        while i >= 0:
            out.append({"start": i, "end": i + len(v)})
            i = t.find(v, i + 1)
        return out

    return pd.Series([places(t, v) for t, v in zip(texts, values)])


def resolve_spans(docs: DataFrame, gold: DataFrame, keys=KEYS, text: str = "text") -> DataFrame:
    """Gold (keys, value, label, nth from 1 or null) with start and end; a value that isn't there is an error."""
    place = F.try_element_at(occurrences(F.col(text), F.col("value")), F.coalesce("nth", F.lit(1)))
    out = docs.select(*keys, text).join(gold, list(keys)).withColumn("_p", place)
    here = F.when(F.col("_p").isNull(), F.raise_error(F.lit("a gold value isn't in its text"))).otherwise(F.col("_p"))
    return out.withColumn("_p", here).select(*keys, "value", "label", F.col("_p.start").alias("start"), F.col("_p.end").alias("end"))


def _counted(gold: DataFrame, predicted: DataFrame, keys) -> DataFrame:
    """(keys, start, end, label, g, p): how often each span stands in either. A union that is counted: a join would sort both sides again for each set of its columns."""
    by = [*keys, "start", "end", "label"]
    side = lambda df, g, p: df.select(*by, F.lit(g).alias("g"), F.lit(p).alias("p"))
    return side(gold, 1, 0).unionByName(side(predicted, 0, 1)).groupBy(*by).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def _known(*columns: str) -> Column:
    """Whether none of the columns is null: what is null equals nothing."""
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def score_exact(gold: DataFrame, predicted: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, tp, typed_tp, fp, fn): equal boundaries, one to one, in order of label among repeats."""
    typed = F.when(F.col("label").isNotNull(), F.least("g", "p")).otherwise(0)
    each = _counted(gold, predicted, keys).groupBy(*keys, "start", "end").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum(typed).alias("t"))
    tp = F.when(_known(*keys, "start", "end"), F.least("g", "p")).otherwise(0)
    return each.groupBy(*keys).agg(F.sum(tp).alias("tp"), F.sum(F.least(F.col("t"), tp)).alias("typed_tp"), F.sum(F.col("p") - tp).alias("fp"), F.sum(F.col("g") - tp).alias("fn"))


def micro(scores: DataFrame, *by: str, empty: float = 1.0) -> DataFrame:
    """E3 (empty=1) and E4's convention (empty=0): sums, precision, recall, F1, typed F1."""
    s = scores.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "typed_tp", "fp", "fn")])
    p, r = (ratio(F.col("tp"), F.col("tp") + F.col(c), empty) for c in ("fp", "fn"))
    tp, tr = (ratio(F.col("typed_tp"), F.col("tp") + F.col(c), empty) for c in ("fp", "fn"))
    return s.select(*by, "tp", "typed_tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), f1(tp, tr).alias("typed_f1"))


def score_by_label(gold: DataFrame, predicted: DataFrame, keys=KEYS) -> DataFrame:
    """Exact precision and recall of each label, both sides filtered to it."""
    tp = F.when(_known(*keys, "start", "end", "label"), F.least("g", "p")).otherwise(0)
    both = _counted(gold, predicted, keys).groupBy("label").agg(F.sum(tp).alias("tp"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_predicted"))
    return both.select("label", "tp", "n_gold", "n_predicted", ratio(F.col("tp"), F.col("n_predicted")).alias("precision"), ratio(F.col("tp"), F.col("n_gold")).alias("recall"))


def greedy(gold: list[dict], predicted: list[dict], typed: bool, exact: bool) -> int:
    """Predictions in order each take the first free gold span that fits."""
    free, hits = list(gold), 0
    for p in predicted:
        for g in free:
            fits = (p["start"], p["end"]) == (g["start"], g["end"]) if exact else p["start"] < g["end"] and g["start"] < p["end"]
            if fits and (not typed or p["label"] == g["label"]):
                free.remove(g)
                hits += 1
                break
    return hits


def score_greedy(gold: DataFrame, predicted: DataFrame, keys=KEYS, typed: bool = True, exact: bool = False) -> DataFrame:
    """(keys, tp, fp, fn); spans of a document meet in one row, in order of start, end and label."""
    item = F.struct("start", "end", "label")
    g = gold.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("g"))
    p = predicted.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("p"))

    @F.pandas_udf(T.LongType())
    def hits(gs: pd.Series, ps: pd.Series) -> pd.Series:
        rows = lambda x: [] if x is None else [dict(d) for d in x]
        return pd.Series([greedy(rows(a), rows(b), typed, exact) for a, b in zip(gs, ps)])

    both = g.join(p, list(keys), "full").withColumn("tp", hits("g", "p"))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return both.select(*keys, "tp", (size("p") - F.col("tp")).alias("fp"), (size("g") - F.col("tp")).alias("fn"))


def redaction_recall(gold: DataFrame, predicted: DataFrame, keys=KEYS) -> DataFrame:
    """Gold spans that any prediction touches, those touched with their label, and both sides' sizes."""
    same = gold.alias("a").join(predicted.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [(F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col("a.label") == F.col("b.label"))], "left_semi")
    back = predicted.alias("a").join(gold.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [(F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col("a.label") == F.col("b.label"))], "left_semi")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(gold, "n_gold").crossJoin(n(predicted, "n_predicted")).crossJoin(n(overlap_join(gold, predicted, keys, "left_semi"), "masked")).crossJoin(n(same, "typed")).crossJoin(n(back, "typed_predicted"))
    p, r = ratio(F.col("typed_predicted"), F.col("n_predicted")), ratio(F.col("typed"), F.col("n_gold"))
    return out.select("*", ratio(F.col("masked"), F.col("n_gold")).alias("redaction_recall"), p.alias("typed_precision"), r.alias("typed_recall"), f1(p, r).alias("typed_f1"))


def leak_rate(cells: DataFrame, sets: list[list[str]], leaked: str = "leaked") -> DataFrame:
    """Rows, leaks and rate for all the groupings at once."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    hit = F.col(leaked)
    return cells.groupingSets([[F.col(c) for c in g] for g in sets], *every).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum(hit.cast("int")).alias("leaks"), F.avg(hit.cast("double")).alias("rate"))


def token_retention(tokens: DataFrame, predicted: DataFrame, keys=KEYS, top: int = 25) -> tuple[DataFrame, DataFrame]:
    """Share of tokens and of texts that no prediction touches; the terms touched most."""
    hit = overlap_join(tokens, predicted, keys, "left_semi").select(*keys, "start", "end", F.lit(1).alias("hit"))
    marked = tokens.join(hit.distinct(), [*keys, "start", "end"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    texts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("flags"))
    rates = texts.agg(F.sum("n").alias("tokens"), F.sum("flags").alias("flagged"), (1 - F.try_divide(F.sum("flags"), F.sum("n"))).alias("retention"), F.avg((F.col("flags") == 0).cast("double")).alias("clean_texts"))
    terms = marked.where("hit = 1").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)
    return rates, terms


def address_coverage(gold: DataFrame, predicted: DataFrame, by: list[str], keys=KEYS) -> DataFrame:
    """Characters of gold spans that predictions cover, fully and partly covered spans."""
    own = list(dict.fromkeys([*keys, "start", "end", "label", *by]))
    c = covered_chars(gold.select(*own).distinct(), predicted, keys, own)
    size = F.col("end") - F.col("start")
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("covered") == size).cast("int")).alias("full"), F.sum((F.col("covered") == 0).cast("int")).alias("missed"), F.try_divide(F.sum("covered"), F.sum(size)).alias("coverage"))


def false_positives(gold: DataFrame, predicted: DataFrame, label: str, by: list[str], keys=KEYS) -> DataFrame:
    """Predictions of a label that touch no gold span of it, counted by columns of theirs."""
    p, g = predicted.where(F.col("label") == label), gold.where(F.col("label") == label)
    return overlap_join(p, g, keys, "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def domain_score(rows: DataFrame, stopwords: list[str] = ()) -> DataFrame:
    """Of (id, category, redacted, value): miss if the value stands in the redacted text as words, partial if a word of 4 letters does."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    text, value = fold(F.col("redacted")), fold(F.col("value"))
    guard = lambda v: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), v, F.lit(r"\E(?![\p{L}\p{N}])"))
    words = F.filter(F.split(F.regexp_replace(value, r"""[.,;:!?()"']""", ""), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*stopwords) if stopwords else F.length(w) >= 4)
    outcome = F.when(F.regexp_like(text, guard(value)), "miss").when(F.exists(words, lambda w: F.regexp_like(text, guard(w))), "partial").otherwise("hit")
    return rows.withColumn("outcome", outcome)


def category_rollup(outcomes: DataFrame) -> DataFrame:
    """Hits, partials and misses by category, and in all (null category)."""
    count = lambda o: F.sum((F.col("outcome") == o).cast("int")).alias(o)
    return outcomes.rollup("category").agg(F.count(F.lit(1)).alias("n"), count("hit"), count("partial"), count("miss"))


_MARKS = r"""[.,;:!?()"']"""


def _long_words(c: Column, least: int = 3) -> Column:
    """Words of at least so many characters, in lower case and without punctuation."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.trim(c)), _MARKS, ""), f"[{SPACE}]+"), lambda w: F.length(w) >= least)


def classify_extra(label: Column, value: Column) -> Column:
    """Why a redaction that no annotation asks for may be right, by its label, or that it is a candidate for an error."""
    kinds = {"POSTNUMMER": "postcode", "PLATS": "place", "ORGANISATION": "organisation"}
    out = F.when((label == "NAMN") & value.rlike(NAME_LIKE), "name-like")
    for name, kind in kinds.items():
        out = out.when(label == name, kind)
    return out.otherwise("candidate")


_NAME = "[A-ZÅÄÖ][a-zåäöé'-]+"
NAME_LIKE = rf"\A{_NAME}(?: {_NAME})+\z"


def unannotated(redactions: DataFrame, expected: DataFrame, keys=KEYS) -> DataFrame:
    """Redactions (keys, label, value) that share no word of three characters or more with the expected values (keys, value) of their text, classified."""
    wanted = expected.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list(_long_words(F.col("value"))))).alias("_w"))
    # a text's words come to its redactions, so that these, which may be costly, are read once
    shared = F.coalesce(F.arrays_overlap(_long_words(F.col("value")), F.col("_w")), F.lit(False))
    return redactions.join(wanted, list(keys), "left").where(~shared).drop("_w").withColumn("classification", classify_extra(F.col("label"), F.col("value")))


_TOKEN = r"\[[A-ZÅÄÖ_]+_[0-9]+\]"
SURVIVAL = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("material", T.IntegerType()), T.StructField("retained", T.IntegerType()), T.StructField("outcome", T.StringType())]))


def survival(text: str, masked: str, values: list[str], token: str = _TOKEN) -> list[dict]:
    """Of each gold value how many of its letters and digits stand in parts of the text that were not redacted: hit (none), partial or miss (all).

    The masked text's plain parts must stand in the text in their order, each value in the text, and a value must have a letter or digit.
    """
    left, at, low, out = bytearray(len(text)), 0, safe_lower_text(text), []
    for part in re.split(token, masked):
        if part:
            at = text.find(part, at)
            if at < 0:
                raise ValueError("a part that isn't redacted doesn't stand in the text")
            left[at : at + len(part)] = b"\1" * len(part)
            at += len(part)
    for v in values:
        start = low.find(safe_lower_text(v))
        if start < 0:
            raise ValueError("a gold value doesn't stand in the text")
        places = [k for k in range(start, start + len(v)) if text[k].isalnum()]
        if not places:
            raise ValueError("a gold value has no letter or digit")
        n = sum(left[k] for k in places)
        out.append({"value": v, "material": len(places), "retained": n, "outcome": "hit" if not n else "miss" if n == len(places) else "partial"})
    return out


def surviving(text: Column, masked: Column, values: Column) -> Column:
    """E16 as a column."""
    kind = to_arrow_type(SURVIVAL)

    @F.arrow_udf(SURVIVAL)
    def run(texts: pa.Array, redacted: pa.Array, gold: pa.Array) -> pa.Array:
        return pa.array([None if t is None or m is None else survival(t, m, v or []) for t, m, v in zip(texts.to_pylist(), redacted.to_pylist(), gold.to_pylist())], kind)

    return run(text, masked, values)


def quantiles(df: DataFrame, value: str, qs=(0.5, 0.95), margin: float = 0.001) -> DataFrame:
    """The element at floor(q * n) of the sorted values, exactly.

    Approximate quantiles a margin below and above bracket the rank; values below are only
    counted, and only those in the bracket are sorted.
    """
    v = df.select(F.col(value).alias("v")).where("v is not null")
    edges = [e for q in qs for e in (max(0.0, q - margin), min(1.0, q + margin))]
    n, found = v.agg(F.count(F.lit(1)), F.percentile_approx("v", edges, 10_000)).first()
    if not n:
        return df.sparkSession.range(1).select(*[F.lit(None).cast(v.schema["v"].dataType).alias(f"p{int(q * 100)}") for q in qs])
    brackets = list(zip(found[::2], found[1::2]))
    below = v.agg(*[F.sum((F.col("v") < lo).cast("long")).alias(f"b{k}") for k, (lo, _) in enumerate(brackets)]).first()
    out = []
    for q, (lo, hi), less in zip(qs, brackets, below):
        rank = min(n - 1, int(q * n)) - less
        inside = v.where((F.col("v") >= lo) & (F.col("v") <= hi)) if 0 <= rank else v
        rank = rank if 0 <= rank else rank + less
        if inside is not v and inside.count() <= rank:
            inside, rank = v, rank + less
        out.append(inside.orderBy("v").limit(rank + 1).agg(F.max("v").alias(f"p{int(q * 100)}")))
    first, *rest = out
    for r in rest:
        first = first.crossJoin(r)
    return first


def gates(metrics: dict[str, float], floors: dict[str, float], ceilings: dict[str, float]) -> list[str]:
    """What misses its floor or passes its ceiling."""
    return [f"{k} {metrics[k]:g} is below {v:g}" for k, v in floors.items() if metrics[k] < v] + [f"{k} {metrics[k]:g} is above {v:g}" for k, v in ceilings.items() if metrics[k] > v]


def vocabulary(tokens: DataFrame, size: int, keep: list[str] = (), native: DataFrame | None = None) -> DataFrame:
    """The must-haves, then the most frequent, then the native order, up to ``size``."""
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    must = F.col("token").isin(*keep) if keep else F.lit(False)
    if native is not None:
        counted = native.join(counted, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        counted = counted.withColumn("ix", F.lit(0))
    return counted.orderBy(F.desc(must), F.desc("n"), "ix", "token").limit(size).select("token", "n")


def category_sums(categories: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(name, entities, hits, junk) of named groups of categories (category, entities, hits, junk); a group's missing category is an error."""
    wanted = categories.sparkSession.createDataFrame([(g, c) for g, cs in groups.items() for c in cs], "name string, category string")
    both = wanted.join(categories, "category", "left")
    known = F.when(F.col("entities").isNull(), F.raise_error(F.lit("a category is missing"))).otherwise(F.col("entities"))
    return both.groupBy("name").agg(F.sum(known).alias("entities"), F.sum("hits").alias("hits"), F.sum("junk").alias("junk"))


def snapshot(scores: DataFrame, digits: int = 1) -> DataFrame:
    """Scores with each share (a double column) as a percentage of so many digits, for a release's published figures."""
    return scores.select(*[F.round(100 * F.col(f.name), digits).alias(f"{f.name}_pct") if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in scores.schema])
