"""Redaction: overlaps resolved, stable placeholders given, texts rebuilt and restored.

``redact`` is one Arrow step on (text): detect, resolve, number, rebuild. Numbers run within a
document, so there is no shuffle. ``redact_spans`` takes spans from elsewhere. Errors name
positions and lengths, never values.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.patterns import DEFAULT, PRIORITY
from .detect import CUSTOM, FIELDS, SPAN, detect_text, install

TEMPLATE = "[{label}_{n}]"
RESULT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("redactions", T.ArrayType(T.StructType([*FIELDS, T.StructField("replacement", T.StringType())]))),
        T.StructField("map", T.MapType(T.StringType(), T.StringType())),
    ]
)
_WORD = regex.compile(r"[\p{L}\p{N}]")


def resolve(found: Iterable[dict], text: str) -> list[dict]:
    """R2: the earliest, then longest, then prior label; later ones keep what is left of them."""
    out, cursor = [], -1
    for d in sorted(found, key=lambda d: (d["start"], d["start"] - d["end"], PRIORITY.get(d["label"], 5), d["label"])):
        s, e = d["start"], d["end"]
        if s < cursor:
            if e <= cursor:
                continue
            s = cursor
            while s < e and not _WORD.match(text[s]):
                s += 1
            while e > s and not _WORD.match(text[e - 1]):
                e -= 1
            if e - s < 2:
                continue
        out.append({**d, "start": s, "end": e, "value": text[s:e]})
        cursor = e
    return out


def problems(found: Iterable[dict], text: str, template: str = TEMPLATE) -> list[str]:
    """What is wrong with spans from elsewhere."""
    out = []
    for k, d in enumerate(found):
        s, e = d["start"], d["end"]
        if s is None or e is None or not 0 <= s < e <= len(text):
            out.append(f"span {k}: {s}..{e} isn't inside a text of {len(text)}")
        elif d.get("value") != text[s:e]:
            out.append(f"span {k}: a value of {len(d.get('value') or '')} isn't what stands at {s}..{e}")
        if template == TEMPLATE and any(ch in (d["label"] or "") for ch in "[]"):
            out.append(f"span {k}: a label may not hold brackets")
    return out


def number(kept: list[dict], text: str, template: str = TEMPLATE) -> tuple[list[dict], dict[str, str]]:
    """Equal (label, value) share a token; tokens that stand in the text are passed over."""
    if "{n}" not in template:
        raise ValueError("a placeholder needs {n}")
    have: dict[tuple[str, str], str] = {}
    used: dict[str, str] = {}
    count: dict[str, int] = {}
    taken: dict[str, set[str]] = {}
    out = []
    for d in kept:
        key = d["label"], d["value"]
        if key not in have:
            label = d["label"]
            if label not in taken:  # one pass finds the tokens of a label that the text has already
                a, b = (regex.escape(x) for x in template.replace("{label}", label).split("{n}", 1))
                taken[label] = {m.group(1) for m in regex.finditer(a + "([0-9]+)" + b, text, overlapped=True)} if "{n}" in template else set()
            n = count.get(label, 0) + 1
            while str(n) in taken[label] or template.format(label=label, n=n) in used:
                n += 1
            count[label] = n
            have[key] = template.format(label=label, n=n)
            used[have[key]] = d["value"]
        out.append({**d, "replacement": have[key]})
    return out, used


def rebuilt(numbered: list[dict], text: str) -> str:
    """R6."""
    parts, at = [], 0
    for d in numbered:
        parts += [text[at : d["start"]], d["replacement"]]
        at = d["end"]
    return "".join([*parts, text[at:]])


def redact_text(text: str, names: Iterable[str] = tuple(DEFAULT), template: str = TEMPLATE) -> dict:
    """R8."""
    return redact_found(detect_text(text, names), text, template)


def redact_found(found: Iterable[dict], text: str, template: str = TEMPLATE) -> dict:
    """R9."""
    numbered, tokens = number(resolve(found, text), text, template)
    return {"text": rebuilt(numbered, text), "redactions": numbered, "map": tokens}


def restore_text(text: str, tokens: dict[str, str]) -> str:
    """One pass, the longest token at each place; inserted values aren't read again."""
    if not tokens:
        return text
    either = regex.compile("|".join(map(regex.escape, sorted(tokens, key=len, reverse=True))))
    return either.sub(lambda m: tokens[m.group()], text)


def redact(c: Column, names: Iterable[str] = tuple(DEFAULT), template: str = TEMPLATE) -> Column:
    """text -> struct(text, redactions, map)."""
    names = list(names)
    own = {n: CUSTOM[n] for n in names if n in CUSTOM}
    if "{n}" not in template:
        raise ValueError("a placeholder needs {n}")

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        install(own)
        return results([None if t is None else redact_text(t, names, template) for t in texts.to_pylist()])

    return run(c)


def results(rows: list[dict | None]) -> pa.Array:
    """Results as columns side by side, so that texts are copied once and not by way of row objects."""
    kind = to_arrow_type(RESULT)
    parts = [pa.array([r and r[f.name] if f.name != "map" else r and list(r["map"].items()) for r in rows], f.type) for f in kind]
    return pa.StructArray.from_arrays(parts, fields=list(kind))


@F.arrow_udf(SPAN)
def resolve_overlaps(texts: pa.Array, found: pa.Array) -> pa.Array:
    return pa.array([None if t is None or f is None else resolve(f, t) for t, f in zip(texts.to_pylist(), found.to_pylist())], to_arrow_type(SPAN))


@F.arrow_udf(T.StringType())
def restore(texts: pa.Array, tokens: pa.Array) -> pa.Array:
    return pa.array([None if t is None else restore_text(t, dict(m or ())) for t, m in zip(texts.to_pylist(), tokens.to_pylist())], pa.string())


def redact_spans(docs: DataFrame, spans: DataFrame, keys=("doc_id",), text: str = "text", template: str = TEMPLATE) -> DataFrame:
    """(keys, redacted, n_redactions, map) of documents with spans (keys, start, end, value, label) from elsewhere; a wrong span is an error."""
    each = spans.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "value", "label")).alias("_found"))

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for t, f in zip(texts.to_pylist(), found.to_pylist()):
            f = f or []
            if t is not None and (wrong := problems(f, t, template)):
                raise ValueError("; ".join(wrong[:5]))
            rows.append(None if t is None else redact_found(f, t, template))
        return results(rows)

    out = docs.select(*keys, text).join(each, list(keys), "left").select(*keys, run(F.col(text), F.col("_found")).alias("r"))
    return out.select(*keys, F.col("r.text").alias("redacted"), F.size("r.redactions").alias("n_redactions"), F.col("r.map").alias("map"))


def assign_placeholders(spans: DataFrame, keys=("doc_id",)) -> DataFrame:
    """R4 on resolved spans in long form, for texts without such tokens: the n-th new value of a label is number n."""
    first = F.min("start").over(Window.partitionBy(*keys, "label", "value"))
    n = F.dense_rank().over(Window.partitionBy(*keys, "label").orderBy("_first"))
    out = spans.withColumn("_first", first).withColumn("n", n).drop("_first")
    return out.withColumn("replacement", F.concat(F.lit("["), "label", F.lit("_"), F.col("n").cast("string"), F.lit("]")))


def label_counts(spans: DataFrame) -> DataFrame:
    """R12."""
    return spans.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def segments(text: str, marked: Iterable[dict]) -> list[dict]:
    """The text as pieces, plain and marked in turn."""
    out, at = [], 0
    for d in sorted(marked, key=lambda d: d["start"]):
        if d["start"] > at:
            out.append({"text": text[at : d["start"]], "label": None})
        out.append({"text": text[d["start"] : d["end"]], "label": d["label"]})
        at = d["end"]
    return out + ([{"text": text[at:], "label": None}] if at < len(text) else [])


def token_ranges(c: Column) -> Column:
    """Placeholders that stand in a text."""
    from ..functions.text import matches

    return matches(c, r"\[[A-ZÅÄÖ_]+_[0-9]+\]")
