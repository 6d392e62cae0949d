"""Preparation of training rows: deterministic samples and splits, tag algebra, audits.

Rows are (tokens, tags) arrays; tags are O, B-x or I-x. Array work is native expressions.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = r"\A(O|[BI]-(PER|LOC|ORG|ADR))\z"


def fnv(s: str) -> float:
    """FNV-1a over UTF-16 units as a share of 2**32."""
    h, raw = 2166136261, s.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 16777619) & 0xFFFFFFFF
    return h / 2**32


@F.pandas_udf(T.DoubleType())
def hash_share(c: pd.Series) -> pd.Series:
    """T1 as a column."""
    return c.map(lambda s: None if s is None else fnv(s))


def hash_sample(df: DataFrame, key: str, share: float, prefix: str = "") -> DataFrame:
    """T4, T5: rows whose hash is below the share; the rest of a split is its complement."""
    return df.where(hash_share(F.concat(F.lit(prefix), F.col(key).cast("string"))) < share)


def word_uniform(c: Column) -> Column:
    """T3."""
    return F.crc32(c.cast("binary")) / F.lit(2**32)


def group_split(df: DataFrame, group: str, share: float) -> DataFrame:
    """``part`` dev for round(n * share) of the groups by hash, never for all of them, train for others."""
    groups = df.select(group).distinct().withColumn("_h", hash_share(F.col(group).cast("string")))
    n = groups.count()
    most = min(int(n * share + 0.5), n - 1)
    dev = groups.orderBy("_h", group).limit(max(0, most)).select(group, F.lit("dev").alias("part"))
    return df.join(dev, group, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def bio_repair(tags: Column) -> Column:
    """An I- that continues nothing of its kind begins it."""
    kind = lambda t: F.substring(t, 3, 100)
    before = lambda i: kind(F.coalesce(F.get(tags, i - 1), F.lit("O")))
    return F.transform(tags, lambda t, i: F.when(t.startswith("I-") & ((i == 0) | (before(i) != kind(t))), F.concat(F.lit("B-"), kind(t))).otherwise(t))


def remap_tags(tags: Column, names: dict[str, str | None]) -> Column:
    """Labels by name; null drops them to O."""
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v or "")])
    new = lambda t: F.coalesce(F.try_element_at(table, F.substring(t, 3, 100)), F.substring(t, 3, 100))
    return F.transform(tags, lambda t: F.when((t == "O") | (new(t) == ""), F.lit("O")).otherwise(F.concat(F.substring(t, 1, 2), new(t))))


def to_bio(labels: Column) -> Column:
    """Flat labels (O or a name); a label goes on where the one before is the same."""
    return F.transform(labels, lambda t, i: F.when(t == "O", t).when((i > 0) & (F.get(labels, i - 1) == t), F.concat(F.lit("I-"), t)).otherwise(F.concat(F.lit("B-"), t)))


def bio_spans(df: DataFrame, keys=("doc_id",), tags: str = "tags") -> DataFrame:
    """(keys, start, end, label) in tokens; an I- without a beginning begins a span."""
    t = df.select(*keys, F.posexplode(tags).alias("i", "tag"))
    w = Window.partitionBy(*keys).orderBy("i")
    kind = F.substring("tag", 3, 100)
    before = F.lag("tag", 1, "O").over(w)
    begins = F.col("tag").startswith("B-") | (F.substring(before, 3, 100) != kind) | (before == "O")
    marked = t.withColumn("new", F.when((F.col("tag") != "O") & begins, 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("tag != 'O'").groupBy(*keys, "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.first(kind).alias("label")).drop("island")


def spans_to_bio(tokens: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[str]:
    """Tags of tokens for character spans; a span that cuts a token, overlaps another or holds no token is an error."""
    out = ["O"] * len(tokens)
    for s, e, label in sorted(spans):
        inside = [k for k, (a, b) in enumerate(tokens) if a < e and s < b]
        if not inside:
            raise ValueError("an entity holds no token")
        for n, k in enumerate(inside):
            a, b = tokens[k]
            if a < s or b > e:
                raise ValueError("an entity's edge cuts a token")
            if out[k] != "O":
                raise ValueError("entities overlap")
            out[k] = ("I-" if n else "B-") + label
    return out


TAGS = T.ArrayType(T.StringType())


def char_spans_to_bio(tokens: Column, spans: Column) -> Column:
    """T10 as a column: tags of tokens (array of start, end) for character spans (array of start, end, label); errors as ``spans_to_bio``'s."""

    @F.arrow_udf(TAGS)
    def run(each: pa.Array, marked: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(each.to_pylist(), marked.to_pylist()):
            out.append(None if t is None else spans_to_bio([(x["start"], x["end"]) for x in t], [(x["start"], x["end"], x["label"]) for x in s or ()]))
        return pa.array(out, pa.list_(pa.string()))

    return run(tokens, spans)


def convert_classes(df: DataFrame, names: dict[str, str], poison: set[str], outside: set[str], generic: set[str] = frozenset()) -> DataFrame:
    """Df (tokens, tags) with its classes mapped; rows with a poison class go, classes ``outside`` and spans whose whole text is a
    generic word become O, and a class that none of these names is an error."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    kind = lambda t: F.substring(t, 3, 200)
    known = [*names, *poison, *outside]
    unknown = F.exists("tags", lambda t: (t != "O") & ~kind(t).isin(*known))
    checked = df.where(F.when(unknown, F.raise_error(F.lit("a row has a class that isn't mapped"))).otherwise(~F.exists("tags", lambda t: kind(t).isin(*poison) if poison else F.lit(False))))
    # a span goes on while its class does and no B- begins another; its text is looked up at its first token
    new = lambda i: (F.get("tags", i) != "O") & ((i == 0) | F.get("tags", i).startswith("B-") | (kind(F.coalesce(F.get("tags", i - 1), F.lit("O"))) != kind(F.get("tags", i))))
    ix = F.when(F.size("tags") > 0, F.sequence(F.lit(0), F.size("tags") - 1)).otherwise(F.array().cast("array<int>"))
    alone = lambda i: new(i) & ((i + 1 >= F.size("tags")) | (F.coalesce(F.get("tags", i + 1), F.lit("O")) == "O") | new(i + 1))
    plain = lambda i: alone(i) & F.get("tokens", i).isin(*generic) if generic else F.lit(False)
    label = lambda i: F.try_element_at(table, kind(F.get("tags", i)))
    out = F.transform(ix, lambda i: F.when((F.get("tags", i) == "O") | label(i).isNull() | plain(i), F.lit("O")).otherwise(F.concat(F.when(new(i), F.lit("B-")).otherwise(F.lit("I-")), label(i))))
    return checked.withColumn("tags", out)


def augment_cases(df: DataFrame, key: str, lower: float = 0.35, upper: float = 0.05, drop_mark: float = 0.0, seed: int = 0) -> DataFrame:
    """Rows by the hash of their key in lower case, in upper case, or as they are, and without a final sign; equal rows once."""
    share = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cased = F.transform("tokens", lambda t: F.when(share("case") < lower, F.lower(t)).when(share("case") < lower + upper, F.upper(t)).otherwise(t))
    drop = (share("mark") < drop_mark) & (F.size("tokens") > 1) & F.element_at("tokens", -1).rlike(r"\A[^\p{L}\p{N}]\z") & (F.element_at("tags", -1) == "O")
    size = F.size("tokens") - drop.cast("int")
    out = df.select(*[c for c in df.columns if c not in ("tokens", "tags")], F.slice(cased, F.lit(1), size).alias("tokens"), F.slice("tags", F.lit(1), size).alias("tags"))
    first = out.groupBy("tokens", "tags").agg(F.min(key).alias(key))
    return out.join(first.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def lower_augment(df: DataFrame, key: str, share: float) -> DataFrame:
    """Rows, and lower-case copies of a share of them."""
    copies = hash_sample(df, key, share, "lower:").withColumn("tokens", F.transform("tokens", F.lower)).withColumn("augmented", F.lit(True))
    return df.withColumn("augmented", F.lit(False)).unionByName(copies)


def agreement(first: Column, conf: Column, second: Column, alone: float = 0.97, confirmed: float = 0.85) -> Column:
    """Whether two taggers' rows may be kept: sure enough where only the first tags, less so where both agree, never ADR nor only the second."""
    ix = F.sequence(F.lit(0), F.size(first) - 1)
    a, b, p = (lambda i: F.get(first, i)), (lambda i: F.get(second, i)), (lambda i: F.get(conf, i))
    fine = lambda i: F.when(a(i) == "O", b(i) == "O").when(F.substring(a(i), 3, 100) == "ADR", F.lit(False)).when(F.substring(a(i), 3, 100) == F.substring(b(i), 3, 100), p(i) >= confirmed).otherwise((b(i) == "O") & (p(i) >= alone))
    return F.when(F.size(first) == 0, F.lit(True)).otherwise(F.forall(ix, fine))


def without_held_out(df: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """Rows that hold none of the names (name) as a part, without case; a null text holds none.

    The names, a list of held-out rows, become one automaton in each task, so a text is read once for all of them.
    """
    from ..functions.text import safe_lower_text

    held = sorted({safe_lower_text(r["name"]) for r in names.select("name").distinct().collect() if r["name"]})  # a held-out list, not a corpus

    @F.arrow_udf(T.BooleanType())
    def free(texts: pa.Array) -> pa.Array:
        import ahocorasick

        find = ahocorasick.Automaton()
        for n in held:
            find.add_word(n, True)
        find.make_automaton()
        return pa.array([t is None or next(find.iter(safe_lower_text(t)), None) is None for t in texts.to_pylist()], pa.bool_())

    return df.where(free(F.col(text))) if held else df


def dedupe_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row in order of each key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stratum(tags: Column, tokens: Column) -> Column:
    """lowerPer, per, orgLoc or empty."""
    has = lambda *k: F.exists(tags, lambda t: F.substring(t, 3, 100).isin(*k))
    lower = F.exists(F.arrays_zip(tokens.alias("w"), tags.alias("t")), lambda x: x["t"].endswith("-PER") & (x["w"] == F.lower(x["w"])))
    return F.when(lower, "lowerPer").when(has("PER"), "per").when(has("ORG", "LOC"), "orgLoc").otherwise("empty")


def stratified_round_robin(df: DataFrame, strata: str, source: str, key: str, budgets: dict[str, int]) -> DataFrame:
    """Of each stratum its budget, sources taking turns, rows of a source by hash.

    A row's place is at least its turn, so turns and places over the largest budget go early: Spark keeps so many rows a
    group in each task before it shuffles, and no stratum is sorted whole.
    """
    most = max(budgets.values(), default=0)
    h = df.withColumn("_h", hash_share(F.col(key).cast("string")))
    turn = F.row_number().over(Window.partitionBy(strata, source).orderBy("_h", key))
    place = F.row_number().over(Window.partitionBy(strata).orderBy("_turn", source))
    budget = F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv])
    near = h.withColumn("_turn", turn).where(F.col("_turn") <= most).withColumn("_place", place).where(F.col("_place") <= most)
    return near.where(F.col("_place") <= F.coalesce(F.try_element_at(budget, F.col(strata)), F.lit(0))).drop("_h", "_turn", "_place")


def audit(rows: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """Counts of what is wrong, and the shares that the gates look at."""
    tags, tokens = F.col("tags"), F.col("tokens")
    bad_tag = F.exists(tags, lambda t: ~t.rlike(TAG))
    orphan = ~F.equal_null(bio_repair(tags), tags)
    key = F.array_join(tokens, "\x1f")
    n = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(bad_tag.cast("int")), F.lit(0)).alias("bad_tags"),
        F.coalesce(F.sum((F.size(tags) != F.size(tokens)).cast("int")), F.lit(0)).alias("bad_lengths"),
        F.coalesce(F.sum(orphan.cast("int")), F.lit(0)).alias("orphans"),
        F.countDistinct(key).alias("distinct_rows"),
    )
    out = n.withColumn("duplicate_share", F.when(F.col("n") == 0, 0.0).otherwise((F.col("n") - F.col("distinct_rows")) / F.col("n")))
    if validation is not None:
        v = validation.select(key.alias("_k"))
        shared = v.join(rows.select(key.alias("_k")).distinct(), "_k", "left_semi").agg(F.count(F.lit(1)).alias("_s")).crossJoin(v.agg(F.count(F.lit(1)).alias("_v")))
        out = out.crossJoin(shared.select(F.when(F.col("_v") == 0, 0.0).otherwise(F.col("_s") / F.col("_v")).alias("overlap_share")))
    return out


def unmarked_addresses(df: DataFrame, markers: list[str], keys=("doc_id",)) -> DataFrame:
    """ADR spans whose words carry none of the markers of made-up addresses."""
    s = bio_spans(df, keys).where("label = 'ADR'").join(df.select(*keys, "tokens"), list(keys))
    value = F.array_join(F.slice("tokens", F.col("start") + 1, F.col("end") - F.col("start")), " ")
    return s.withColumn("value", value).where(~F.lower("value").rlike("|".join(m.lower() for m in markers))).drop("tokens")


_PIECES = [(1, 15), (16, 15), (31, 15), (46, 15), (61, 4)]  # of a digest in hexadecimal


def manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and a SHA-256 over what the rows' digests add up to piece by piece: independent of order, repeats count, and
    each task adds up its own rows."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    sums = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.conv(F.substring("h", at, size), 16, 10).cast("decimal(38,0)")), F.lit(0)).alias(f"s{at}") for at, size in _PIECES])
    return sums.select("n", F.sha2(F.concat_ws("\n", *[F.col(f"s{at}").cast("string") for at, _ in _PIECES]), 256).alias("sha256"))


def unverified(df: DataFrame, columns: list[str], expected: DataFrame) -> DataFrame:
    """The manifest's row, if rows or digest differ from the expected (n, sha256); no row otherwise."""
    return manifest(df, columns).join(expected.select(F.col("n").alias("_n"), F.col("sha256").alias("_s")), (F.col("n") == F.col("_n")) & (F.col("sha256") == F.col("_s")), "left_anti")


def generate(spark, n: int, templates: list[list[str]], slots: dict[str, list[str]], seed: int = 0) -> DataFrame:
    """Rows from templates whose {slot} tokens are filled by hash and tagged with the slot's label."""
    pick = lambda size, what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(size)).cast("int")
    arr = F.array(*[F.array(*map(F.lit, t)) for t in templates])
    fill = {k: F.get(F.array(*map(F.lit, v)), pick(len(v), k)) for k, v in slots.items()}
    df = spark.range(n).withColumn("template", F.get(arr, pick(len(templates), "template")))

    def word(t):
        out = F.struct(t.alias("w"), F.lit("O").alias("t"))
        for k, v in fill.items():
            out = F.when(t == "{" + k + "}", F.struct(v.alias("w"), F.lit("B-" + k).alias("t"))).otherwise(out)
        return out

    return df.withColumn("_x", F.transform("template", word)).select("id", F.transform("_x", lambda x: x["w"]).alias("tokens"), F.transform("_x", lambda x: x["t"]).alias("tags"))


def align_pieces(tags: list[str], word_ids: list[int | None], continue_inside: bool = False) -> list[str | None]:
    """Tags of word pieces: a word's first piece has its tag, later ones none or I-."""
    out, last = [], None
    for w in word_ids:
        if w is None:
            out.append(None)
        elif w != last:
            out.append(tags[w])
        else:
            out.append(None if not continue_inside else tags[w].replace("B-", "I-", 1))
        last = w
    return out


def uncovered_terms(tokens: Column, tags: Column, terms: list[list[str]]) -> Column:
    """Whether a term of one or more words stands in a row, its last word in the genitive or not, with a word that no tag covers."""
    low = F.transform(tokens, F.lower)

    def stands(term: list[str]):
        *head, last = [w.lower() for w in term]
        ends = [last] if last[-1] in "sxz" else [last, last + "s"]

        def at(i):
            fits = F.get(low, i + len(head)).isin(*ends)
            for k, w in enumerate(head):
                fits = fits & (F.get(low, i + k) == w)
            return fits & F.exists(F.slice(tags, i + 1, len(term)), lambda t: t == "O")

        return at

    found = F.lit(False)
    for term in terms:
        n = F.size(low) - len(term)
        starts = F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        found = found | F.exists(starts, stands(term))
    return found
