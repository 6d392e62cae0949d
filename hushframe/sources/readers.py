"""Readers and writers of the formats that annotated text comes in, as DataFrames."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import decode_entities

ROW = "tokens array<string>, tags array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: str = ROW) -> DataFrame:
    """Blank lines are passed over; a line that isn't JSON fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """S2."""
    df.write.mode(mode).json(path)


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """S3: (file, sentence, tokens, tags); the last field of a line is the tag, a blank line ends a sentence, 0 is O."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\r", ""), r"\n[ \t]*\n")).alias("sentence", "block"))
    lines = F.filter(F.split("block", "\n"), lambda ln: F.trim(ln) != "")
    word = F.transform(lines, lambda ln: F.trim(F.regexp_replace(F.trim(ln), r"\s+\S+$", "")))
    tag = F.transform(lines, lambda ln: F.regexp_extract(F.trim(ln), r"(\S+)$", 1))
    return whole.where(F.size(lines) > 0).select("file", "sentence", word.alias("tokens"), F.transform(tag, lambda t: F.when(t == "0", "O").otherwise(t)).alias("tags"))


def read_tsv(spark: SparkSession, path: str, fields: int = 2) -> DataFrame:
    """Array of fields; a line with fewer is an error."""
    parts = F.split("value", "\t")
    fine = F.when(F.size(parts) < fields, F.raise_error(F.concat(F.lit("too few fields in a line of "), F.length("value").cast("string")))).otherwise(parts)
    return spark.read.text(path).where(F.trim("value") != "").select(fine.alias("fields"))


def read_sentences_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, sentence, tokens, tags) of <sentence> with <token> and <name type="...">, names as BIO."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<sentence\b[^>]*>(.*?)</sentence>"), F.lit(1))).alias("sentence", "body"))

    kinds = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType()))])
    mark = regex.compile(r'<(name)\b[^>]*?type="([^"]*)"[^>]*>|</(name)>|<token\b[^>]*>(.*?)</token>', regex.S)

    def one(body):
        tokens, tags, kind, first = [], [], None, False
        for m in mark.finditer(body):
            if m[1]:
                kind, first = m[2], True
            elif m[3]:
                kind = None
            else:
                tokens.append(m[4].strip())
                tags.append("O" if kind is None else ("B-" if first else "I-") + kind)
                first = False
        return {"tokens": tokens, "tags": tags}

    @F.arrow_udf(kinds)
    def parse(bodies: pa.Array) -> pa.Array:
        return pa.array([None if b is None else one(b) for b in bodies.to_pylist()], to_arrow_type(kinds))

    p = whole.select("file", "sentence", parse("body").alias("p"))
    return p.select("file", "sentence", F.transform("p.tokens", decode_entities).alias("tokens"), F.col("p.tags").alias("tags"))


def quality_gate(tokens: Column) -> Column:
    """4 to 40 tokens, at least 3 and half of them with a letter, none very long, no links or addresses."""
    words = F.size(F.filter(tokens, lambda t: t.rlike(r"\p{L}")))
    bad = F.exists(tokens, lambda t: (F.length(t) > 30) | t.contains("http") | t.contains("www.") | t.contains("@"))
    return F.size(tokens).between(4, 40) & (words >= 3) & (words * 2 >= F.size(tokens)) & ~bad


def read_sentence_stream(spark: SparkSession, path: str, source: str, most: int | None = None) -> DataFrame:
    """(tokens, src) of the sentences of large XML exports, compressed by bzip2 or not, that pass the gate; ``most`` rows at most.

    A record ends with its sentence's end tag, so files are read in splits, compressed ones too, and the
    scan stops once ``most`` rows are found.
    """
    body = F.regexp_extract("value", r"(?s).*<sentence[^>]*>(.*)\z", 1)
    found = F.regexp_extract_all(body, F.lit(r"<token[^>]*>([^\r\n]*?)</token>"), F.lit(1))
    tokens = F.filter(F.transform(found, lambda t: F.trim(decode_entities(t))), lambda t: t != "")
    rows = spark.read.option("lineSep", "</sentence>").text(path).where(F.col("value").contains("<sentence")).select(tokens.alias("tokens"), F.lit(source).alias("src")).where(quality_gate(F.col("tokens")))
    return rows if most is None else rows.limit(most)


def read_lexicon_xml(spark: SparkSession, path: str) -> DataFrame:
    """(word, pos) of a lexicon's entries, an entry a record: its written form and part of speech features."""
    feature = lambda name: F.regexp_extract("value", rf'<feat[^>]*att="{name}"[^>]*val="([^"]*)"', 1)
    rows = spark.read.option("lineSep", "</LexicalEntry>").text(path)
    return rows.select(decode_entities(feature("writtenForm")).alias("word"), feature("partOfSpeech").alias("pos")).where("word != ''")


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(word, rank) of a list of words by frequency, one a line in a file of its own; ranks count from 1."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda w: F.trim(w) != "")).alias("rank", "line"))
    return lines.select(F.element_at(F.split(F.trim("line"), r"\s+"), 1).alias("word"), (F.col("rank") + 1).alias("rank"))


def read_marked_up(spark: SparkSession, path: str) -> DataFrame:
    """Lines with [PER:x] marks, and <k=v ...> before them: (line, meta, text, entities)."""
    entity = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("value", T.StringType())])
    out = T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()), T.StructField("entities", T.ArrayType(entity))])
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))

    @F.arrow_udf(out)
    def parse(rows: pa.Array) -> pa.Array:
        found = [parse_marked_up(r) for r in rows.to_pylist()]
        return pa.array([{"meta": list(m.items()), "text": t, "entities": [dict(zip(("start", "end", "label", "value"), e)) for e in es]} for m, t, es in found], to_arrow_type(out))

    p = lines.select(F.col("value").alias("line"), parse("value").alias("p"))
    return p.select("line", "p.meta", "p.text", "p.entities")


_MARK = regex.compile(r"\[([A-ZÅÄÖ_]+):([^\]]*)\]")
_META = regex.compile(r"\A<([^>]*)>\s*")


def parse_marked_up(line: str):
    meta, text, found, at = {}, "", [], 0
    if (m := _META.match(line)) and "=" in m[1]:
        meta, line = dict(kv.split("=", 1) for kv in m[1].split() if "=" in kv), line[m.end() :]
    for m in _MARK.finditer(line):
        text += line[at : m.start()]
        found.append((len(text), len(text) + len(m[2]), m[1], m[2]))
        text, at = text + m[2], m.end()
    return meta, text + line[at:], found


def slots(annotated: Column) -> Column:
    """Array of (slot, value) of [slot : value] marks."""
    found = F.regexp_extract_all(annotated, F.lit(r"\[[^\]:]*:[^\]]*\]"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.trim(F.regexp_extract(x, r"\[([^\]:]*):", 1)).alias("slot"), F.trim(F.regexp_extract(x, r":([^\]]*)\]", 1)).alias("value")))


def without_slots(df: DataFrame, column: str, poison: list[str]) -> DataFrame:
    """Rows with none of the slots."""
    return df.where(~F.exists(slots(F.col(column)), lambda s: s["slot"].isin(*poison)))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, system, doc_ix, text, spans) of files <corpus>.<system>.json."""
    schema = "docs array<struct<text:string,spans:array<struct<start:int,end:int,label:string>>>>"
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.regexp_extract(name, r"^([^.]+)\.", 1).alias("corpus"), F.regexp_extract(name, r"^[^.]+\.(.+)\.json$", 1).alias("system"), F.posexplode("docs").alias("doc_ix", "d"))
    return raw.select("corpus", "system", "doc_ix", "d.text", "d.spans")


def read_frequencies(spark: SparkSession, path: str, schema: str = "name string, bearers long") -> DataFrame:
    """A CSV of names and bearers; list files are read with ``read_tsv`` or ``spark.read.text``."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_report(rows: DataFrame, path: str, title: str) -> str:
    """A small aggregate as a Markdown table; returns the text it wrote."""
    held = rows.collect()
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    text = f"# {title}\n\n{head}\n" + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in held)
    with open(path, "w") as f:
        f.write(text)
    return text


def write_gold(spans: DataFrame, path: str, keys=("doc_id",)) -> None:
    """Resolved spans, a row a document."""
    spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "value"))).alias("gold")).write.mode("overwrite").json(path)
