"""Queries that build and check corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.patterns import S
from ..operators import corpus as co
from ..operators import detect, redact
from ..operators import model_tokens as mt
from ..sources.readers import quality_gate as gate
from .common import spread, table
from .detection import _values_sql, luhn_sql
from .training import fnv_sql


def eval_leak(spark, sf_dir):
    """Documents whose surface is another document's."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return co.eval_leak(d, d, id_col="doc_id").select("doc_id")


def benchmark_contained(spark, sf_dir):
    """Documents that hold a run of 8 words of a benchmark item."""
    return co.contained(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


_RUNS = r"""list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))"""
_WORDS = r"""string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"""


def absent_names(spark, sf_dir):
    """Capitalized words of benchmark items that stand in no document."""
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("name")).distinct()
    return co.absent_names(names, table(spark, sf_dir, "documents"))


def template_cross(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("name"))
    return co.template_cross(n, ["Hej {name}!", "{name} ringde.", "Till {name} och co", "Mejl från {name}"], per_name=2).select("i", "name", "template", "text")


def lexicon_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("name"), F.col("c_custkey").alias("bearers"))
    w = table(spark, sf_dir, "orders").select(F.element_at(F.array(F.lit("building"), F.lit("machinery"), F.lit("x")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("word"), F.col("o_orderstatus").alias("pos"))
    r = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("word"), F.col("c_custkey").alias("rank"))
    return co.lexicon_join(c, w, r, 1)


def quota_select(spark, sf_dir):
    """60 suppliers, evenly by nation's region, two of a balance's hundred at most."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("region"), F.floor(F.col("s_acctbal") / 100).alias("street"))
    return co.quota_select(s, 60, "region", "street", "s_suppkey")


def homograph_rows(spark, sf_dir):
    """The 30 part names of most parts by their first word, in three frames."""
    n = table(spark, sf_dir, "part").groupBy(F.element_at(F.split("p_name", " "), 1).alias("name")).agg(F.count(F.lit(1)).alias("bearers"))
    return co.homograph_rows(n, ["{name} ringde", "Hej {name}!", "hos {name}"])


def filler_tokens(spark, sf_dir):
    """Benchmark texts as filler tokens."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tx.tokenize_filler(F.col("text"))).alias("i", "token"))


def corpus_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("value"))
    return co.corpus_rows(n, "i", "value", ["Bor i {} nu", "{}", "Till {}"]).select("i", "gold", "text", "start", "end")


_LANGS = ("en", "de", "fr", "es")


def gold_issues(spark, sf_dir):
    """Documents as a gold table: their languages as registers, card and bankgiro numbers as entities; all rules."""
    d = table(spark, sf_dir, "documents")
    g = d.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("writer"), F.col("lang").alias("register"), F.when(F.col("doc_id") % 10 == 0, "2024-02-30").otherwise("2024-02-28").alias("collected"), (F.col("doc_id") % 8 == 0).alias("second_reviewed"), F.concat(detect.native(F.col("text"), "card"), detect.native(F.col("text"), "bankgiro")).alias("entities"))
    return co.gold_issues(g, registers=_LANGS, required=_LANGS)


def pack_chunks(spark, sf_dir):
    """Conversations packed in order of turns into chunks of at most 48,000 characters, each conversation on its own."""
    c = table(spark, sf_dir, "conversations")
    return co.pack_chunks(c.select("conv_id", "turn", "text"), "turn", keys=["conv_id"]).groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))


def pack_batches(spark, sf_dir):
    """Benchmark items packed in order into chunks of at most 48,000 characters."""
    b = table(spark, sf_dir, "benchmark")
    return co.pack_chunks(b, "item_id").select("item_id", "chunk")


def html_to_markdown(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages").select("page_id", "html", "url")).select("page_id", co.html_to_markdown("html", "url").alias("markdown"))


def quality_gate(spark, sf_dir):
    """Sentences of documents that pass the gate, by document."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[.\n]")).alias("s"))
    return s.where(gate(F.split(F.trim("s"), " +"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def whole_word(spark, sf_dir):
    """Documents where 'the' stands as a word."""
    low = F.lower("text")
    whole = F.exists(tx.matches(low, "the"), lambda m: mt.whole_word(low, m["start"], m["end"]))
    return table(spark, sf_dir, "documents").where(whole).select("doc_id")


_CLINICAL = [("Puls 72", ""), ("Alvedon forte 500", " mg x 3"), ("Alvedon forte 500", " stycken"), (" Penicillin", " hjälper"), ("Anna Berg", " mg"), ("Journalnr AB12-345C", ""), ("blodtryck: 120", "/80"), ("Pulsen 72", " mgr")]


def clinical_filter(spark, sf_dir):
    """Findings in care texts, by rules and by a model in turn, and which of them stay."""
    case = F.get(F.array(*[F.struct(F.lit(v).alias("value"), F.lit(a).alias("after")) for v, a in _CLINICAL]), (F.col("p_size") % len(_CLINICAL)).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", case.alias("c"), F.when(F.col("p_partkey") % 3 == 0, "rule").otherwise("model").alias("source"))
    return p.where(mt.clinical_filter(F.col("c.value"), F.col("source"), F.col("c.after"))).select("p_partkey", F.col("c.value").alias("value"))


def normalise_labels(spark, sf_dir):
    """Model spans at customers' towns and streets: labels and ends put right."""
    value = F.get(F.array(*map(F.lit, ("umeå", "Umeå", "Storgatan", "Nya Torget", "Bolaget"))), (F.col("c_custkey") % 5).cast("int"))
    tail = F.get(F.array(*map(F.lit, (" nr 12 B, igår", " 4 i", " 12345", " 7", ""))), (F.col("c_nationkey") % 5).cast("int"))
    t = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("vid "), value, tail).alias("text"), F.length(value).alias("n"), F.when(F.col("c_custkey") % 7 == 0, "NAMN").otherwise("ORGANISATION").alias("label"))
    d = mt.normalised(F.col("text"), F.lit(4), F.col("n") + 4, F.col("label"))
    return t.select("c_custkey", d.alias("d")).select("c_custkey", "d.end", "d.value", "d.label")


def split_points(spark, sf_dir):
    """Where each document would be cut in two for a tagger."""
    at = mt.split_points(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", at.alias("s")).select("doc_id", "s.left_end", "s.right_start")


def token_entities(spark, sf_dir):
    """Documents cut into word pieces whose capitalized ones are tagged, without places; spans by reconstruction."""
    piece = F.regexp_extract_all("text", F.lit(r"\p{L}+|[^\s\p{L}]"), F.lit(0))
    tag = lambda w: F.when(w.rlike(r"\A[A-Z][a-z]+\z"), "B-PER").otherwise("O")
    token = lambda w, i: F.struct(tag(w).alias("entity"), F.lit(0.9).alias("score"), i.alias("index"), w.alias("word"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    found = mt.reconstructed(F.col("text"), F.transform(piece, token))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.start", "s.end", "s.value", "s.label")


def conversation_numbers(spark, sf_dir):
    """Speakers' roles numbered within a conversation by first turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("start"), F.lit("ROLE").alias("label"), F.col("role").alias("value"))
    return redact.assign_placeholders(c, keys=("conv_id",)).select("conv_id", F.col("value").alias("role"), "n").distinct()


def gazetteer_hybrid(spark, sf_dir):
    """A name list as recognizer over notes, its spans by document."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("Anna Berg och Bo i "), "n_name").alias("text"))
    found = mt.recognize(n, lambda: mt.gazetteer(["Anna", "Bo"], ["Berg"]))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.value", "s.label")


QUERIES = {
    f.__name__: f
    for f in (eval_leak, benchmark_contained, absent_names, template_cross, lexicon_join, quota_select, homograph_rows, filler_tokens, corpus_rows, gold_issues, pack_chunks, pack_batches, html_to_markdown, quality_gate, whole_word, clinical_filter, normalise_labels, split_points, token_entities, conversation_numbers, gazetteer_hybrid)
}
_CARD, _BANKGIRO = r"\b[0-9](?:[ -]?[0-9]){12,18}\b", r"\b[0-9]{3,4}\s{0,2}-\s{0,2}[0-9]{4}\b"


def _packed(source: str, group: str, order: str, shown: str) -> str:
    """The greedy fold, a row after the other."""
    return f"""
        WITH RECURSIVE r AS (SELECT {group} AS g, {shown} AS o, length(text) AS n, row_number() OVER (PARTITION BY {group} ORDER BY {order}, text) AS i FROM {source}),
        f AS (SELECT g, o, i, 0 AS chunk, n AS size FROM r WHERE i = 1
            UNION ALL SELECT r.g, r.o, r.i, CASE WHEN f.size + r.n > 48000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.size + r.n > 48000 THEN r.n ELSE f.size + r.n END FROM f JOIN r ON r.g = f.g AND r.i = f.i + 1)
        SELECT g, o, chunk FROM f"""


_SURFACE = r"lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))"
ORACLES = {
    "eval_leak": f"""WITH s AS (SELECT doc_id, {_SURFACE} AS k FROM documents)
        SELECT doc_id FROM s WHERE k <> '' AND k IN (SELECT k FROM s GROUP BY k HAVING min(doc_id) < max(doc_id))""",
    "benchmark_contained": f"""WITH d AS (SELECT DISTINCT doc_id, unnest({_RUNS}) AS run FROM (SELECT doc_id, {_WORDS} AS w FROM documents)), b AS (SELECT DISTINCT item_id, unnest({_RUNS}) AS run FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))
        SELECT DISTINCT doc_id, item_id FROM d JOIN b USING (run)""",
    "absent_names": r"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM benchmark), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}-]+')) AS w FROM documents)
        SELECT name FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE contains(w, lower(name)))""",
    "template_cross": "SELECT i, name, template, replace(['Hej {name}!', '{name} ringde.', 'Till {name} och co', 'Mejl från {name}'][template + 1], '{name}', name) AS text FROM (SELECT n_nationkey AS i, n_name AS name, ((n_nationkey + 6 * k) % 4)::INT AS template FROM nation, range(2) t(k))",
    "lexicon_join": """WITH c AS (SELECT lower(c_mktsegment) AS name, sum(c_custkey)::BIGINT AS bearers, min(c_custkey) AS rank FROM customer GROUP BY 1), w AS (SELECT ['building', 'machinery', 'x'][o_orderkey % 3 + 1] AS name, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS pos FROM orders GROUP BY 1)
        SELECT name, bearers, pos, rank FROM c JOIN w USING (name)""",
    "quota_select": f"""WITH s AS (SELECT s_suppkey, s_nationkey % 5 AS region, floor(s_acctbal / 100)::BIGINT AS street, {fnv_sql("s_suppkey::VARCHAR")} AS h FROM supplier),
        k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY region, street ORDER BY h, s_suppkey) <= 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY h, s_suppkey) AS r FROM k)
        SELECT s_suppkey, region, street FROM r ORDER BY r > ceil(60 / (SELECT count(DISTINCT region) FROM k)), h, s_suppkey LIMIT 60""",
    "homograph_rows": """WITH n AS (SELECT string_split(p_name, ' ')[1] AS name, count(*) AS bearers FROM part GROUP BY 1 ORDER BY bearers DESC, name LIMIT 30), f AS (SELECT * FROM (VALUES (0, '{name} ringde'), (1, 'Hej {name}!'), (2, 'hos {name}')) t(frame, t))
        SELECT name, bearers, frame, replace(t, '{name}', name) AS text, (strpos(t, '{name}') - 1)::INT AS start, (strpos(t, '{name}') - 1 + length(name))::INT AS "end" FROM n, f""",
    "filler_tokens": r"""WITH w AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS w FROM benchmark),
        t AS (SELECT item_id, flatten(list_transform(w, lambda r: regexp_extract_all(r, '^[^A-Za-z0-9_ÅÄÖåäö]+$|^[^A-Za-z0-9_ÅÄÖåäö]+|[A-Za-z0-9_ÅÄÖåäö](?:.*[A-Za-z0-9_ÅÄÖåäö])?|[^A-Za-z0-9_ÅÄÖåäö]+$'))) AS x FROM w),
        u AS (SELECT item_id, flatten(list_transform(x, lambda p: CASE WHEN regexp_matches(p, '[A-Za-z0-9_ÅÄÖåäö]') THEN [p] ELSE string_split(p, '') END)) AS t FROM t)
        SELECT item_id, (unnest(range(len(t))))::INT AS i, unnest(t) AS token FROM u""",
    "corpus_rows": """WITH n AS (SELECT n_nationkey AS i, CASE n_nationkey % 6 WHEN 4 THEN lower(n_name) WHEN 5 THEN upper(n_name) ELSE n_name END AS gold, ['Bor i {} nu', '{}', 'Till {}'][n_nationkey % 3 + 1] AS t FROM nation)
        SELECT i, gold, replace(t, '{}', gold) AS text, (strpos(t, '{}') - 1)::INT AS start, (strpos(t, '{}') - 1 + length(gold))::INT AS "end" FROM n""",
    "gold_issues": f"""
        WITH d AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k FROM documents),
        c AS ({_values_sql(_CARD, "documents", "doc_id", "text", luhn_sql("value"))}), b AS ({_values_sql(_BANKGIRO, "documents", "doc_id", "text", luhn_sql("value"))}),
        i AS (SELECT 'bad date' AS issue, count(*) AS n FROM d WHERE doc_id % 10 = 0
            UNION ALL SELECT 'too few reviewed', (avg((doc_id % 8 = 0)::INT) < 0.2)::BIGINT FROM d
            UNION ALL SELECT 'too few rows', greatest(0, 200 - count(*)) FROM d
            UNION ALL SELECT 'too few writers', greatest(0, 3 - count(DISTINCT source)) FROM d
            UNION ALL SELECT 'no text', count(*) FROM d WHERE coalesce(trim(text), '') = ''
            UNION ALL SELECT 'no writer', count(*) FROM d WHERE coalesce(trim(source), '') = ''
            UNION ALL SELECT 'bad register', count(*) FROM d WHERE coalesce(lang NOT IN {_LANGS}, TRUE)
            UNION ALL SELECT 'missing register', {len(_LANGS)} - count(DISTINCT lang) FILTER (lang IN {_LANGS}) FROM d
            UNION ALL SELECT 'repeated text', count(k) - count(DISTINCT k) FROM d WHERE k <> ''
            UNION ALL SELECT 'overlapping entities', count(*) FROM b WHERE EXISTS (SELECT 1 FROM c WHERE c.doc_id = b.doc_id AND c.start < b."end" AND b.start < c."end"))
        SELECT issue, n FROM i WHERE n > 0""",
    "pack_chunks": _packed("conversations", "conv_id", "turn", "turn").replace("SELECT g, o, chunk FROM f", "SELECT g AS conv_id, chunk, count(*) AS n FROM f GROUP BY g, chunk"),
    "pack_batches": _packed("benchmark", "0", "item_id", "item_id").replace("SELECT g, o, chunk FROM f", "SELECT o AS item_id, chunk FROM f"),
    "quality_gate": r"""WITH s AS (SELECT doc_id, string_split_regex(trim(unnest(string_split_regex(text, '[.\n]'))), ' +') AS t FROM documents)
        SELECT doc_id, count(*) AS n FROM s WHERE len(t) BETWEEN 4 AND 40 AND len(list_filter(t, lambda w: regexp_matches(w, '\p{L}'))) >= greatest(3, len(t) / 2)
            AND len(list_filter(t, lambda w: length(w) > 30 OR contains(w, 'http') OR contains(w, 'www.') OR contains(w, '@'))) = 0 GROUP BY doc_id""",
    "whole_word": r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}])the([^\p{L}]|$)')",
    "clinical_filter": f"SELECT p_partkey, [{', '.join(repr(v) for v, _ in _CLINICAL)}][p_size % {len(_CLINICAL)} + 1] AS value FROM part WHERE p_partkey % 3 = 0 OR p_size % {len(_CLINICAL)} IN (2, 4, 7)",
    "normalise_labels": r"""WITH t AS (SELECT c_custkey, ['umeå', 'Umeå', 'Storgatan', 'Nya Torget', 'Bolaget'][c_custkey % 5 + 1] AS v, [' nr 12 B', ' 4', '', ' 7', ''][c_nationkey % 5 + 1] AS tail, CASE WHEN c_custkey % 7 = 0 THEN 'NAMN' ELSE 'ORGANISATION' END AS label FROM customer),
        k AS (SELECT *, label <> 'NAMN' AND v IN ('Storgatan', 'Nya Torget') AND tail <> '' AS takes FROM t)
        SELECT c_custkey, (4 + length(v) + CASE WHEN takes THEN length(tail) ELSE 0 END)::INT AS "end", v || CASE WHEN takes THEN tail ELSE '' END AS value, CASE WHEN takes THEN 'ADRESS' WHEN v = 'umeå' AND label = 'ORGANISATION' THEN 'PLATS' ELSE label END AS label FROM k""",
    "split_points": f"""WITH t AS (SELECT doc_id, text, length(text) AS n, (length(text) // 2)::INT AS half, least(100, length(text) // 8)::INT AS lap FROM documents),
        w AS (SELECT *, greatest(half - 199, 2) AS low, substring(text, greatest(half - 199, 2)::BIGINT + 1, greatest(half - greatest(half - 199, 2) + 1, 0)::BIGINT) AS near FROM t),
        b AS (SELECT *, CASE WHEN regexp_matches(near, '{S}') THEN low + length(regexp_extract(near, '(?s)^(.*){S}', 1)) ELSE half END AS blank FROM w),
        m AS (SELECT *, CASE WHEN lap < blank AND blank + lap < n THEN blank ELSE half END AS mid FROM b)
        SELECT doc_id, (mid + lap)::INT AS left_end, (mid - lap)::INT AS right_start FROM m""",
    "token_entities": _values_sql(r"\p{L}+|[^\s\p{L}]", "documents", "doc_id", "text", "regexp_full_match(value, '[A-Z][a-z]+')").replace('AS "end", value FROM', "AS \"end\", value, 'NAMN' AS label FROM"),
    "conversation_numbers": "SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), role)::INT AS n FROM conversations GROUP BY conv_id, role",
    "gazetteer_hybrid": """SELECT n_nationkey AS doc_id, unnest([0, 14])::INT AS start, unnest([9, 16])::INT AS "end", unnest(['Anna Berg', 'Bo']) AS value, 'NAMN' AS label FROM nation""",
}
