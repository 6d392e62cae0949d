"""Queries of the training-row operators; rows are an order's lines with tags made from their flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import training as tr
from .common import table


def _rows(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_partkey") % 3 == 0, "PER").when(F.col("l_partkey") % 3 == 1, "LOC").otherwise("ORG")
    tag = F.when(F.col("l_suppkey") % 4 == 0, "O").when(F.col("l_suppkey") % 4 == 1, F.concat(F.lit("B-"), kind)).otherwise(F.concat(F.lit("I-"), kind))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").cast("string").alias("w"), tag.alias("t"))
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(item)).alias("x")).select("doc_id", F.col("x.w").alias("tokens"), F.col("x.t").alias("tags"))


_TAGGED = """r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE::VARCHAR, tag) - 1 AS i, l_shipdate::DATE::VARCHAR AS w, tag FROM (
    SELECT *, CASE WHEN l_suppkey % 4 = 0 THEN 'O' WHEN l_suppkey % 4 = 1 THEN 'B-' || kind ELSE 'I-' || kind END AS tag FROM (
    SELECT *, CASE WHEN l_partkey % 3 = 0 THEN 'PER' WHEN l_partkey % 3 = 1 THEN 'LOC' ELSE 'ORG' END AS kind FROM lineitem)))"""
_BEFORE = "lag(tag, 1, 'O') OVER (PARTITION BY doc_id ORDER BY i)"


def bio_repair(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", F.posexplode(tr.bio_repair(F.col("tags"))).alias("i", "tag"))


def to_bio(spark, sf_dir):
    flat = F.transform("tags", lambda t: F.when(t == "O", t).otherwise(F.substring(t, 3, 10)))
    return _rows(spark, sf_dir).select("doc_id", F.posexplode(tr.to_bio(flat)).alias("i", "tag"))


def bio_spans(spark, sf_dir):
    return tr.bio_spans(_rows(spark, sf_dir))


def remap_tags(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", F.posexplode(tr.remap_tags(F.col("tags"), {"ORG": None, "LOC": "PLACE"})).alias("i", "tag"))


def audit_rows(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    a = tr.audit(rows.where("doc_id % 10 > 0"), rows.where("doc_id % 10 = 0"))
    return a.select("n", "bad_tags", "bad_lengths", "orphans", "distinct_rows", F.round("duplicate_share", 6).alias("duplicate_share"), F.round("overlap_share", 6).alias("overlap_share"))


def dedupe_first(spark, sf_dir):
    """The first order of each customer."""
    return tr.dedupe_first(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def hash_sample(spark, sf_dir):
    """Documents in a tenth by the FNV-1a hash of their id."""
    return tr.hash_sample(table(spark, sf_dir, "documents"), "doc_id", 0.1, "dev:").select("doc_id")


def hash_shares(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(tr.hash_share(F.col("c_name")) * 2**32).cast("long").alias("h"))


def word_uniform(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tr.word_uniform(F.col("p_name")).alias("u"))


def group_split(spark, sf_dir):
    return tr.group_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.2)


def lower_augment(spark, sf_dir):
    a = tr.lower_augment(_rows(spark, sf_dir), "doc_id", 0.3)
    return a.groupBy("augmented").agg(F.sum(F.size("tokens")).alias("tokens"))


def agreement_filter(spark, sf_dir):
    """Orders whose tags and those with every line's kind of flag agree surely enough."""
    rows = _rows(spark, sf_dir)
    conf = F.transform("tags", lambda t, i: 0.8 + (i % 5) * 0.05)
    second = F.transform("tags", lambda t, i: F.when(i % 6 == 5, "O").otherwise(t))
    return rows.where(tr.agreement(F.col("tags"), conf, second)).select("doc_id")


def stratified_round_robin(spark, sf_dir):
    """30 orders of each status, the clerks' priorities taking turns."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return tr.stratified_round_robin(o, "o_orderstatus", "o_orderpriority", "o_orderkey", {"F": 30, "O": 30, "P": 10})


def manifest(spark, sf_dir):
    """Rows and digest of the customers' keys and names."""
    return tr.manifest(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey", "c_name"])


def without_held_out(spark, sf_dir):
    """Documents that hold no capitalized word of a benchmark item in any case, not even as a part."""
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0))).alias("name"))
    return tr.without_held_out(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", names).select("doc_id")


def template_rows(spark, sf_dir):
    """1,000 generated rows and their tags' counts."""
    g = tr.generate(spark, 1000, [["{PER}", "bor", "i", "{LOC}"], ["Ring", "{PER}"]], {"PER": ["Anna", "Bo"], "LOC": ["Malmö", "Umeå"]})
    return g.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def fnv_sql(c: str) -> str:
    """FNV-1a of an ASCII string."""
    return f"list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length({c}) + 1), lambda i: unicode(({c})[i])::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


QUERIES = {f.__name__: f for f in (bio_repair, to_bio, bio_spans, remap_tags, audit_rows, dedupe_first, hash_sample, hash_shares, word_uniform, group_split, lower_augment, agreement_filter, stratified_round_robin, manifest, without_held_out, template_rows)}
ORACLES = {
    "bio_repair": f"WITH {_TAGGED} SELECT doc_id, i::INT AS i, CASE WHEN tag[1] = 'I' AND substr({_BEFORE}, 3) <> substr(tag, 3) THEN 'B-' || substr(tag, 3) ELSE tag END AS tag FROM r",
    "to_bio": f"WITH {_TAGGED} SELECT doc_id, i::INT AS i, CASE WHEN tag = 'O' THEN tag WHEN {_BEFORE} <> 'O' AND substr({_BEFORE}, 3) = substr(tag, 3) THEN 'I-' || substr(tag, 3) ELSE 'B-' || substr(tag, 3) END AS tag FROM r",
    "bio_spans": f"""WITH {_TAGGED}, n AS (SELECT *, (tag <> 'O' AND (tag[1] = 'B' OR substr({_BEFORE}, 3) <> substr(tag, 3)))::INT AS new FROM r), k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS isl FROM n)
        SELECT doc_id, min(i)::INT AS start, (max(i) + 1)::INT AS "end", any_value(substr(tag, 3)) AS label FROM k WHERE tag <> 'O' GROUP BY doc_id, isl""",
    "remap_tags": f"WITH {_TAGGED} SELECT doc_id, i::INT AS i, CASE WHEN tag = 'O' OR substr(tag, 3) = 'ORG' THEN 'O' ELSE replace(tag, 'LOC', 'PLACE') END AS tag FROM r",
    "audit_rows": f"""WITH {_TAGGED}, f AS (SELECT *, (tag[1] = 'I' AND substr({_BEFORE}, 3) <> substr(tag, 3)) AS orphan FROM r), d AS (SELECT doc_id, string_agg(w, chr(31) ORDER BY i) AS k, bool_or(orphan) AS orphan FROM f GROUP BY doc_id),
        t AS (SELECT count(*) AS n, 0::BIGINT AS bad_tags, 0::BIGINT AS bad_lengths, count(*) FILTER (orphan) AS orphans, count(DISTINCT k) AS distinct_rows FROM d WHERE doc_id % 10 > 0),
        v AS (SELECT round(avg((k IN (SELECT k FROM d WHERE doc_id % 10 > 0))::INT), 6) AS overlap_share FROM d WHERE doc_id % 10 = 0)
        SELECT n, bad_tags, bad_lengths, orphans, distinct_rows, round((n - distinct_rows) / n, 6) AS duplicate_share, overlap_share FROM t, v""",
    "dedupe_first": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "hash_shares": "SELECT c_custkey, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(c_name) + 1), lambda i: unicode(c_name[i])::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS h FROM customer",
    "hash_sample": f"SELECT doc_id FROM documents WHERE {fnv_sql("'dev:' || doc_id")} / 4294967296.0 < 0.1",
    "group_split": f"""WITH g AS (SELECT DISTINCT source FROM documents), h AS (SELECT source, row_number() OVER (ORDER BY {fnv_sql('source')}, source) AS i, count(*) OVER () AS n FROM g)
        SELECT doc_id, source, CASE WHEN i <= least(floor(n * 0.2 + 0.5), n - 1) THEN 'dev' ELSE 'train' END AS part FROM documents JOIN h USING (source)""",
    "lower_augment": f"SELECT FALSE AS augmented, count(*) AS tokens FROM lineitem UNION ALL SELECT TRUE, count(*) FROM lineitem WHERE {fnv_sql("'lower:' || l_orderkey")} / 4294967296.0 < 0.3",
    "stratified_round_robin": f"""WITH h AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY {fnv_sql("o_orderkey::VARCHAR")}, o_orderkey) AS turn FROM orders)
        SELECT o_orderkey, o_orderstatus, o_orderpriority FROM h QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY turn, o_orderpriority) <= CASE o_orderstatus WHEN 'P' THEN 10 WHEN 'F' THEN 30 WHEN 'O' THEN 30 ELSE 0 END""",
    "manifest": """WITH h AS (SELECT sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS h FROM customer),
        s AS (SELECT count(*) AS n, """ + ", ".join(f"sum(('0x' || substr(h, {at}, {size}))::UBIGINT::HUGEINT) AS s{at}" for at, size in tr._PIECES) + """ FROM h)
        SELECT n, sha256(concat_ws(chr(10), """ + ", ".join(f"s{at}::VARCHAR" for at, _ in tr._PIECES) + """)) AS sha256 FROM s""",
    "without_held_out": r"""WITH n AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}'))) AS name FROM benchmark)
        SELECT doc_id FROM documents WHERE text IS NULL OR NOT EXISTS (SELECT 1 FROM n WHERE contains(lower(text), name))""",
    "agreement_filter": f"WITH {_TAGGED} SELECT doc_id FROM r GROUP BY doc_id HAVING bool_and(CASE WHEN tag = 'O' THEN TRUE WHEN i % 6 = 5 THEN 0.8 + (i % 5) * 0.05 >= 0.97 ELSE 0.8::DOUBLE + (i % 5) * 0.05::DOUBLE >= 0.85::DOUBLE END)",
}
