"""Queries over text: detection, redaction, canonical forms, identifier checks.

The given texts hold few Swedish identifiers, so some queries make texts from ``customer`` and
``orders`` keys, which SQL can make as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import validators as v
from ..operators import detect, redact
from ..operators import model_tokens as mt
from ..operators import score as sc
from ..operators import spans as sp
from .common import dealt, spread, table

#: Keys whose notes are one task's work: a few seconds of redaction.
_NOTES = 25_000


def _notes(spark, sf_dir) -> DataFrame:
    """Notes made from customers' keys. The keys alone are dealt: a file of them is small, and would be one task's work."""
    k = F.col("doc_id")
    text = F.concat(
        F.lit("Kund "), k.cast("string"), F.lit(": ring 070-174 06 "), F.lpad((k % 95 + 5).cast("string"), 2, "0"), F.lit(", mejl kund"), k.cast("string"),
        F.lit("@example.com eller kund"), k.cast("string"), F.lit("@example.com, bankgiro 991-2346, kort 4242 4242 4242 4242, ip 192.0.2."), (k % 256).cast("string"), F.lit(", org 202100-4748, iban SE4280000890119146168423."),
    )
    return dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), "doc_id", _NOTES).select(k, text.alias("text"))


_REDACTED = "'Kund ' || c_custkey || ': ring [TELEFON_1], mejl [EPOST_1] eller [EPOST_1], bankgiro [BANKGIRO_1], kort [KORTNUMMER_1], ip [IP_ADRESS_1], org [ORGANISATIONSNUMMER_1], iban [IBAN_1].'"


def _documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def redact_documents(spark, sf_dir):
    r = redact.redact(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", F.size("r.redactions").alias("n_redactions"), F.col("r.text").alias("redacted"))


def redact_text(spark, sf_dir):
    r = redact.redact(F.col("text"))
    return _notes(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", F.size("r.redactions").alias("n_redactions"), F.col("r.text").alias("redacted"))


def redact_hybrid(spark, sf_dir):
    """Notes with a recognizer's spans, one of a name and one that runs into a telephone number, of which the rules leave its first word."""
    t = _notes(spark, sf_dir)
    span = lambda s, e, label: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.substr("text", s + 1, e - s).alias("value"), F.lit(label).alias("label"))
    name = F.length(F.concat(F.lit("Kund "), F.col("doc_id").cast("string")))
    r = mt.redact_hybrid(F.col("text"), F.array(span(F.lit(0), name, "NAMN"), span(name + 2, name + 15, "PLATS")))
    return t.select("doc_id", r.alias("r")).select("doc_id", F.size("r.redactions").alias("n_redactions"), F.col("r.text").alias("redacted"))


def survival(spark, sf_dir):
    """What of three values of each note its redaction leaves: a whole e-mail address, a label with its number, and a name that rules don't know."""
    k = F.col("doc_id").cast("string")
    values = F.array(F.concat(F.lit("KUND"), k, F.lit("@example.com")), F.lit("bankgiro 991-2346"), F.concat(F.lit("Kund "), k))
    s = sc.surviving(F.col("text"), redact.redact(F.col("text")).getField("text"), values)
    return _notes(spark, sf_dir).select("doc_id", F.explode(s).alias("s")).select("doc_id", "s.value", "s.material", "s.retained", "s.outcome")


def unannotated(spark, sf_dir):
    """Redactions of notes that customers' expected values don't ask for."""
    t = _notes(spark, sf_dir)
    pair = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    each = t.select("doc_id", redact.redact(F.col("text")).getField("redactions").alias("r"))
    # the name beside an IBAN is made from the same array: a union would redact all notes again
    more = F.transform(F.filter("r", lambda s: s["label"] == "IBAN"), lambda s: pair(F.lit("NAMN"), F.lit("Anna Berg")))
    found = each.select("doc_id", F.explode(F.concat(F.transform("r", lambda s: pair(s["label"], s["value"])), more)).alias("s")).select("doc_id", "s.label", "s.value")
    k = F.col("doc_id").cast("string")
    expected = t.select("doc_id", F.explode(F.array(F.concat(F.lit("kund"), k, F.lit("@example.com")), F.lit("bankgiro 991-2346"), F.lit("4242 4242"))).alias("value"))
    return sc.unannotated(found, expected).select("doc_id", "label", "classification")


def restore_text(spark, sf_dir):
    """Redacted documents restored, and whether they are as before."""
    both = _documents(spark, sf_dir).select("doc_id", "text", redact.redact(F.col("text")).alias("r"))
    return both.select("doc_id", F.equal_null(redact.restore(F.col("r.text"), F.col("r.map")), F.col("text")).alias("same"))


def redact_from_spans(spark, sf_dir):
    """Spans from the IP detector alone, given to the redaction as spans from elsewhere."""
    docs = _documents(spark, sf_dir)
    return redact.redact_spans(docs, detect.native_spans(docs, "ip")).select("doc_id", "n_redactions", "redacted")


def _values(name: str, source: str, key: str, column: str):
    def query(spark, sf_dir):
        t = spread(table(spark, sf_dir, source).select(F.col(key).alias("doc_id"), F.col(column).alias("text")))
        return detect.native_spans(t, name).select("doc_id", "start", "end", "value")

    return query


def _values_sql(pattern: str, source: str, key: str, column: str, where: str = "TRUE") -> str:
    p = pattern.replace("'", "''")
    return f"""
        WITH m AS (SELECT {key} AS doc_id, regexp_extract_all({column}, '{p}') AS v, string_split_regex({column}, '{p}') AS g FROM {source}),
        n AS (SELECT doc_id, v, g, unnest(range(1, len(v) + 1)) AS i FROM m),
        s AS (SELECT doc_id, v[i] AS value, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0))::INT AS start FROM n)
        SELECT doc_id, start, (start + length(value))::INT AS "end", value FROM s WHERE {where}"""


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "regexp_replace({c}, '[^0-9]', '', 'g')"


def luhn_sql(c: str) -> str:
    d = _DIGITS.format(c=c)
    return f"(length({d}) > 0 AND list_sum(list_transform(range(1, length({d}) + 1), lambda k: CASE WHEN (length({d}) - k) % 2 = 0 THEN substr({d}, k, 1)::INT ELSE 2 * substr({d}, k, 1)::INT - 9 * (substr({d}, k, 1)::INT > 4)::INT END)) % 10 = 0)"


_BANKGIRO_TEXT = "SELECT o_orderkey, 'betala till ' || o_orderkey || '-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || ' eller ' || (o_orderkey % 1000) || ' - ' || lpad((o_custkey * 7 % 10000)::VARCHAR, 4, '0') || '.' AS text FROM orders"


def detect_bankgiro(spark, sf_dir):
    """Payment texts made from orders' keys, a tenth of whose numbers have the right check digit."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    four = lambda x: F.lpad(x.cast("string"), 4, "0")
    text = F.concat(F.lit("betala till "), k.cast("string"), F.lit("-"), four(c % 10000), F.lit(" eller "), (k % 1000).cast("string"), F.lit(" - "), four(c * 7 % 10000), F.lit("."))
    t = table(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"))
    return detect.native_spans(t, "bankgiro").select("doc_id", "start", "end", "value")


def merge_blank_gaps(spark, sf_dir):
    """Runs of digits in documents, joined where only white space lies between."""
    t = _documents(spark, sf_dir)
    found = t.select("doc_id", F.explode(tx.matches(F.col("text"), "[0-9]+")).alias("s")).select("doc_id", F.lit("N").alias("label"), "s.start", "s.end")
    return sp.merge_blank_gaps(found, t).select("doc_id", "start", "end")


def detect_email(spark, sf_dir):
    return detect.spans(_documents(spark, sf_dir), names=["email"]).select("doc_id", "value")


def detect_all(spark, sf_dir):
    """All findings of the default detectors in documents."""
    return detect.spans(_documents(spark, sf_dir))


def label_counts(spark, sf_dir):
    return redact.label_counts(detect.spans(_notes(spark, sf_dir), names=["email", "phone", "bankgiro", "card", "ip", "organisation", "iban"]))


def assign_placeholders(spark, sf_dir):
    """Numbers for the e-mails of documents by first place; SQL ranks them likewise."""
    found = detect.spans(_documents(spark, sf_dir), names=["email"])
    return redact.assign_placeholders(found).select("doc_id", "value", "start", F.col("n").cast("long").alias("n"), "replacement").distinct().select("doc_id", "value", "n", "replacement").distinct()


def canonicalize_text(spark, sf_dir):
    """Customers' names with invisible signs and a wide letter after them, folded."""
    t = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("­ ​ｘ")).alias("t"))
    return t.select("c_custkey", tx.canonicalize("t").alias("folded"))


def strip_invisible(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("­​⁠ x")).alias("t"))
    return t.select("c_custkey", tx.strip_invisible(F.col("t")).alias("stripped"))


def normalize_surface(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.surface(F.col("text"))).alias("surface"), F.md5(tx.strip_punctuation(F.col("text"))).alias("plain"))


def tokenize_words(spark, sf_dir):
    """Tokens of benchmark texts with their places."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.tokenize(F.col("text"))).alias("t")).select("item_id", "t.start", "t.end", "t.value")


_TOKEN = r"[\p{L}\p{M}\p{N}]+(?:[-'’][\p{L}\p{M}\p{N}]+)*|[^\s]"


def string_scalars(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", tx.collapse_lower(F.concat(F.lit("  "), n, F.lit(" \t X "))).alias("collapsed"), tx.genitive(n).alias("genitive"),
        tx.decode_entities(F.concat(n, F.lit(" &lt;a&gt; &amp;lt; &quot;&apos;"))).alias("decoded"), tx.clean_component(F.concat(n, F.lit("   7 B"))).alias("component"),
        tx.has_word(n, "green").alias("green"),
    )


def _numbers(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, F.lpad((k * 7919 * 104729 % 10000000000).cast("string"), 10, "0").alias("n"))


_NUMBERS = "(SELECT o_orderkey, lpad((o_orderkey * 7919 * 104729 % 10000000000)::VARCHAR, 10, '0') AS n FROM orders)"


def validators(spark, sf_dir):
    """Checks of ten-digit numbers made from order keys, with the century before some and a dash inside."""
    n = F.col("n")
    dashed = F.concat(F.substring(n, 1, 6), F.lit("-"), F.substring(n, 7, 4))
    return _numbers(spark, sf_dir).select(
        "o_orderkey", v.luhn_valid(n).alias("luhn"), v.personal_shape_valid(dashed).alias("personal_shape"), v.coordination_shape_valid(n).alias("coordination_shape"),
        v.personal_valid(dashed).alias("personal"), v.coordination_valid(n).alias("coordination"), v.organisation_valid(F.concat(F.lit("16"), n)).alias("organisation"),
    )


def invalid_ids(spark, sf_dir):
    """Numbers made from order keys, written as personal ones are, that are neither such nor an organisation's."""
    n = F.col("n")
    t = _numbers(spark, sf_dir).select("o_orderkey", F.concat(F.lit("nr "), F.substring(n, 1, 6), F.lit("-"), F.substring(n, 7, 4), F.lit(".")).alias("text"))
    found = detect.invalid_ids(F.col("text"), detect.detect_udf(["email"])(F.col("text")))
    return t.select("o_orderkey", F.explode(found).alias("value"))


def _dates_sql(shift: int) -> str:
    mm, dd, yy = "substr(n, 3, 2)::INT", f"(substr(n, 5, 2)::INT - {shift})", "substr(n, 1, 2)::INT"
    days = f"CASE WHEN {mm} = 2 THEN CASE WHEN {yy} % 4 = 0 THEN 29 ELSE 28 END WHEN {mm} IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
    return f"({mm} BETWEEN 1 AND 12 AND {dd} >= 1 AND {dd} <= {days})"


def iso_dates(spark, sf_dir):
    """Order keys read as dates of 2024."""
    d = F.concat(F.lit("2024-"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", v.iso_date_valid(d).alias("valid"))


def approved_fixtures(spark, sf_dir):
    """Addresses, numbers and test values made from customers' keys, and which of them a fixture may hold."""
    k = F.col("c_custkey")
    pick = lambda *x: F.get(F.array(*map(F.lit, x)), (k % len(x)).cast("int"))
    two = F.lpad((k % 100).cast("string"), 2, "0")
    ip = F.concat(pick("192.0.2.", "10.0.2.", "172.31.1.", "172.32.1.", "8.8.4."), (k % 256).cast("string"))
    mail = F.concat(F.lit("a@"), pick("mail.example.com", "X.test", "example.com.invalidx", "notexample.com"))
    phone = F.concat(pick("+46 (0)70-174 06 ", "031-390 06 ", "+46 40 628 04 ", "08-123 456 "), two)
    value, label = pick("850601-2387", "162021004748", "SE42 8000 0890 1191 4616 8423", "991-2347"), pick("PERSONNUMMER", "ORGANISATIONSNUMMER", "IBAN", "BANKGIRO")
    return table(spark, sf_dir, "customer").select("c_custkey", v.approved_ip(ip).alias("ip"), v.approved_email(mail).alias("email"), v.approved_phone(phone).alias("phone"), v.approved_test_value(value, label).alias("test_value"))


def privacy_issues(spark, sf_dir):
    """Kinds of identifiers in documents, and how many documents hold them."""
    kinds = F.explode(detect.privacy_issues(F.col("text"))).alias("issue")
    return _documents(spark, sf_dir).select(kinds).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def identifier_scrub(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~detect.identifier_like(F.col("text"))).select("doc_id")


def token_ranges(spark, sf_dir):
    """Placeholders in redacted notes."""
    t = redact_text(spark, sf_dir).select("doc_id", F.explode(redact.token_ranges(F.col("redacted"))).alias("t"))
    return t.select("doc_id", "t.value").groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


def canonicalize_documents(spark, sf_dir):
    """Documents with a soft hyphen put before each blank, folded again: the result is the text where that was canonical."""
    return _documents(spark, sf_dir).select("doc_id", tx.canonicalize(F.replace("text", F.lit(" "), F.lit("\u00ad "))).alias("folded"))


def strip_invisible_documents(spark, sf_dir):
    """Documents with invisible signs put before each blank, and stripped of all such signs."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_invisible(F.replace("text", F.lit(" "), F.lit("\u00ad\u200b\u2060 "))).alias("stripped"))


def tokenize_documents(spark, sf_dir):
    """Tokens of documents' whole texts with their places."""
    return _documents(spark, sf_dir).select("doc_id", F.explode(tx.tokenize(F.col("text"))).alias("t")).select("doc_id", "t.start", "t.end", "t.value")


def label_counts_documents(spark, sf_dir):
    """Findings of all default detectors in documents, by label."""
    return redact.label_counts(detect_all(spark, sf_dir))


def token_ranges_documents(spark, sf_dir):
    """Placeholders in redacted documents."""
    t = redact_documents(spark, sf_dir).select("doc_id", F.explode(redact.token_ranges(F.col("redacted"))).alias("t"))
    return t.select("doc_id", "t.value").groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "redact_documents": redact_documents,
    "redact_text": redact_text,
    "redact_hybrid": redact_hybrid,
    "survival": survival,
    "unannotated": unannotated,
    "restore_text": restore_text,
    "redact_from_spans": redact_from_spans,
    "detect_ip": _values("ip", "documents", "doc_id", "text"),
    "detect_card": _values("card", "documents", "doc_id", "text"),
    "detect_bankgiro": detect_bankgiro,
    "detect_url": _values("url", "pages", "page_id", "html"),
    "detect_email": detect_email,
    "merge_blank_gaps": merge_blank_gaps,
    "detect_all": detect_all,
    "label_counts": label_counts,
    "assign_placeholders": assign_placeholders,
    "canonicalize_text": canonicalize_text,
    "strip_invisible": strip_invisible,
    "normalize_surface": normalize_surface,
    "tokenize_words": tokenize_words,
    "string_scalars": string_scalars,
    "validators": validators,
    "invalid_ids": invalid_ids,
    "iso_dates": iso_dates,
    "approved_fixtures": approved_fixtures,
    "privacy_issues": privacy_issues,
    "identifier_scrub": identifier_scrub,
    "token_ranges": token_ranges,
    "canonicalize_documents": canonicalize_documents,
    "strip_invisible_documents": strip_invisible_documents,
    "tokenize_documents": tokenize_documents,
    "label_counts_documents": label_counts_documents,
    "token_ranges_documents": token_ranges_documents,
}

_EMAIL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}"
_TOKENS = ["TELEFON", "EPOST", "BANKGIRO", "KORTNUMMER", "IP_ADRESS", "ORGANISATIONSNUMMER", "IBAN"]
ORACLES = {
    "redact_text": f"SELECT c_custkey AS doc_id, 8 AS n_redactions, {_REDACTED} AS redacted FROM customer",
    "survival": r"""WITH v AS (SELECT c_custkey AS doc_id, unnest(['KUND' || c_custkey || '@example.com', 'bankgiro 991-2346', 'Kund ' || c_custkey]) AS value, unnest([0, 8, 99]) AS kept, unnest(['hit', 'partial', 'miss']) AS outcome FROM customer)
        SELECT doc_id, value, length(regexp_replace(value, '[^\p{L}\p{N}]', '', 'g'))::INT AS material, least(kept, length(regexp_replace(value, '[^\p{L}\p{N}]', '', 'g')))::INT AS retained, outcome FROM v""",
    "unannotated": "SELECT c_custkey AS doc_id, unnest(['TELEFON', 'IP_ADRESS', 'ORGANISATIONSNUMMER', 'IBAN', 'NAMN']) AS label, unnest(['candidate', 'candidate', 'candidate', 'candidate', 'name-like']) AS classification FROM customer",
    "redact_hybrid": "SELECT c_custkey AS doc_id, 10 AS n_redactions, " + _REDACTED.replace("'Kund ' || c_custkey || ': ring [TEL", "'[NAMN_1]: [PLATS_1] [TEL") + " AS redacted FROM customer",
    "restore_text": "SELECT doc_id, TRUE AS same FROM documents",
    "detect_ip": _values_sql(rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "documents", "doc_id", "text"),
    "detect_card": _values_sql(r"\b[0-9](?:[ -]?[0-9]){12,18}\b", "documents", "doc_id", "text", luhn_sql("value")),
    "detect_bankgiro": _values_sql(r"\b[0-9]{3,4}\s{0,2}-\s{0,2}[0-9]{4}\b", f"({_BANKGIRO_TEXT})", "o_orderkey", "text", luhn_sql("value")),
    "detect_url": _values_sql(r"""(?i)\b(?:https?://|www\.)[^\s<>")]*[^\s<>").,;:!?]""", "pages", "page_id", "html"),
    "merge_blank_gaps": "SELECT doc_id, start, \"end\" FROM (" + _values_sql(r"[0-9]+(?:\s+[0-9]+)*", "documents", "doc_id", "text") + ")",
    "detect_email": f"SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS value FROM documents",
    "label_counts": " UNION ALL ".join(f"SELECT '{t}' AS label, count(*) * {2 if t == 'EPOST' else 1} AS n FROM customer" for t in _TOKENS),
    "assign_placeholders": f"""
        WITH m AS (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS v FROM documents),
        s AS (SELECT doc_id, v[i] AS value, i FROM (SELECT doc_id, v, unnest(range(1, len(v) + 1)) AS i FROM m)),
        f AS (SELECT doc_id, value, min(i) AS i FROM s GROUP BY ALL),
        r AS (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
        SELECT doc_id, value, n, '[EPOST_' || n || ']' AS replacement FROM r""",
    "canonicalize_text": "SELECT c_custkey, c_name || ' x' AS folded FROM customer",
    "strip_invisible": "SELECT c_custkey, c_name || ' x' AS stripped FROM customer",
    "normalize_surface": r"""SELECT doc_id, md5(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))) AS surface, md5(regexp_replace(text, '[.,;:!?()"'']', '', 'g')) AS plain FROM documents""",
    "tokenize_words": _values_sql(_TOKEN, "benchmark", "item_id", "text").replace("doc_id", "item_id"),
    "string_scalars": r"""
        SELECT p_partkey, lower(trim(p_name)) || ' x' AS collapsed, CASE WHEN regexp_matches(p_name, '(?i)[sxz]$') THEN p_name ELSE p_name || 's' END AS genitive,
               p_name || ' <a> &lt; "''' AS decoded, p_name || ' 7 B' AS component, regexp_matches(p_name, '(^|[^\p{L}\p{N}])green([^\p{L}\p{N}]|$)') AS green FROM part""",
    "validators": f"""
        SELECT o_orderkey, {luhn_sql("n")} AS luhn, {_dates_sql(0)} AS personal_shape, {_dates_sql(60)} AS coordination_shape,
               {_dates_sql(0)} AND {luhn_sql("n")} AS personal, {_dates_sql(60)} AND {luhn_sql("n")} AS coordination, substr(n, 3, 1) >= '2' AND {luhn_sql("n")} AS organisation FROM {_NUMBERS}""",
    "invalid_ids": f"""SELECT o_orderkey, substr(n, 1, 6) || '-' || substr(n, 7, 4) AS value FROM {_NUMBERS} WHERE NOT ({_dates_sql(0)} OR {_dates_sql(60)} OR (substr(n, 3, 1) >= '2' AND {luhn_sql("n")}))""",
    "iso_dates": "SELECT o_orderkey, try_cast('2024-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS DATE) IS NOT NULL AS valid FROM orders",
    "approved_fixtures": "SELECT c_custkey, c_custkey % 5 < 3 AS ip, c_custkey % 4 < 2 AS email, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 100 >= 5 WHEN 3 THEN FALSE ELSE TRUE END AS phone, c_custkey % 4 < 3 AS test_value FROM customer",
    "identifier_scrub": r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[0-9]{6}[-+]?[0-9]{4}|@|(?i:https?://)|(?i:www\.)')",
    "token_ranges": "SELECT c_custkey AS doc_id, '[' || unnest(['" + "','".join(_TOKENS) + "']) || '_1]' AS value, unnest([" + ",".join("2" if t == "EPOST" else "1" for t in _TOKENS) + "])::BIGINT AS n FROM customer",
}
