"""Building and checking corpora: contamination, quotas, packing, HTML to Markdown, issue tables."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import surface


def eval_leak(train: DataFrame, held_out: DataFrame, text: str = "text", id_col: str | None = None) -> DataFrame:
    """Training rows whose surface (letters and digits, lower case) is a held-out one's; with ``id_col``, one's with another id.

    Surfaces are compared by their SHA-256, so that no text is shuffled.
    """
    k = surface(F.col(text))
    key = F.when(k != "", F.sha2(k, 256)).alias("_k")
    rows, held = train.withColumn("_k", key), held_out.select(key, *([F.col(id_col).alias("_i")] if id_col else [])).where("_k is not null")
    if not id_col:
        return rows.join(held.distinct(), "_k", "left_semi").drop("_k")
    ends = held.groupBy("_k").agg(F.min("_i").alias("_a"), F.max("_i").alias("_b")).withColumnRenamed("_k", "_h")
    other = ~(F.equal_null(F.col("_a"), F.col(id_col)) & F.equal_null(F.col("_b"), F.col(id_col)))
    return rows.join(ends, (F.col("_k") == F.col("_h")) & other, "left_semi").drop("_k")


def contained(docs: DataFrame, items: DataFrame, width: int = 8, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """X2 turned about: (doc, item) where a run of ``width`` words of the item stands in the document. An equi-join on runs of words.

    While the items' runs are few (``_FEW_RUNS``) they go to all tasks and only what is found is shuffled; else runs of both are shuffled as
    SHA-256, 32 bytes whatever their words.
    """
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ")

    def runs(df: DataFrame, key: str) -> DataFrame:
        def of(w: Column) -> Column:
            last = F.size(w) - width + 1
            return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " ")))

        # the words are bound once a row: a lambda would split the text again for each run
        found = F.element_at(F.transform(F.array(words(F.col("text"))), of), 1)
        return df.select(F.col(key), F.explode(found).alias("run"))

    here, sought = runs(docs, id_col), runs(items, item_col)
    if sought.limit(_FEW_RUNS + 1).count() <= _FEW_RUNS:
        sought = F.broadcast(sought.distinct())
    else:
        here, sought = (df.withColumn("run", F.unhex(F.sha2("run", 256))).distinct() for df in (here, sought))
    return here.join(sought, "run").select(id_col, item_col).distinct()


#: Runs of items that every task may hold: some 30 MB.
_FEW_RUNS = 200_000
_RUN = r"[\p{L}\p{M}-]+"


def absent_names(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Names (name) that stand in no training text, not even inside a word, in any case.

    A name of letters, marks and hyphens stands in a text just if it stands in one of the text's
    runs of these, so it's sought in the distinct runs; other names are sought in the texts.
    """
    low = names.select(F.lower("name").alias("_n")).distinct()
    plain = F.col("_n").rlike(f"^{_RUN}$")
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_RUN), F.lit(0))).alias("_w")).distinct()
    whole = texts.select(F.lower("text").alias("_w"))
    found = [hay.join(F.broadcast(low.where(c)), F.contains("_w", "_n")).select("_n").distinct() for hay, c in ((runs, plain), (whole, ~plain))]
    return names.join(found[0].unionByName(found[1]), F.lower("name") == F.col("_n"), "left_anti")


def template_cross(names: DataFrame, templates: list[str], per_name: int = 1, step: int = 6) -> DataFrame:
    """Each name (i, name) in templates (i + step * k) mod n, {name} filled."""
    arr = F.array(*map(F.lit, templates))
    k = F.explode(F.sequence(F.lit(0), F.lit(per_name - 1))).alias("k")
    at = F.pmod(F.col("i") + step * F.col("k"), F.lit(len(templates))).cast("int")
    return names.select("i", "name", k).withColumn("template", at).withColumn("text", F.replace(F.get(arr, F.col("template")), F.lit("{name}"), F.col("name")))


def homograph_rows(names: DataFrame, frames: list[str], top: int = 30, by: str = "bearers") -> DataFrame:
    """The ``top`` names (name, by) with most bearers, ties by name, in every frame, {name} filled, with the name's place."""
    loud = names.orderBy(F.desc(by), "name").limit(top)
    rows = loud.select("name", by, F.posexplode(F.array(*map(F.lit, frames))).alias("frame", "t"))
    start = F.instr("t", "{name}") - 1
    return rows.select("name", by, "frame", F.replace("t", F.lit("{name}"), F.col("name")).alias("text"), start.alias("start"), (start + F.length("name")).alias("end"))


def decomposed_absent(names: DataFrame, texts: DataFrame, vocab, least: int = 2) -> DataFrame:
    """Names that stand in no text and that a vocabulary cuts into ``least`` pieces or more, with their ``pieces``."""
    from ..functions.text import wordpiece

    cut = names.withColumn("pieces", wordpiece(F.col("name"), vocab)).where(F.size("pieces") >= least)
    return absent_names(cut, texts)


def lexicon_join(bearers: DataFrame, words: DataFrame, ranks: DataFrame, least: int) -> DataFrame:
    """Names that are also words: bearers summed, kinds of word gathered, rank in the word list."""
    total = bearers.groupBy(F.lower("name").alias("name")).agg(F.sum("bearers").alias("bearers")).where(F.col("bearers") >= least)
    kinds = words.groupBy(F.lower("word").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("pos")), ",").alias("pos"))
    rank = ranks.groupBy(F.lower("word").alias("name")).agg(F.min("rank").alias("rank"))
    return total.join(kinds, "name").join(rank, "name", "left").orderBy(F.desc("bearers"), "name")


def quota_select(df: DataFrame, n: int, region: str, street: str, key: str, per_street: int = 2) -> DataFrame:
    """Of rows once by key, at most ``per_street`` of a street, an even quota by region in order of hash, then the rest fills up."""
    from .training import hash_share

    once = df.withColumn("_h", hash_share(F.col(key).cast("string"))).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_h", region, street))).where("_n = 1")
    held = once.withColumn("_s", F.row_number().over(Window.partitionBy(region, street).orderBy("_h", key))).where(F.col("_s") <= per_street)
    regions = held.select(region).distinct().count()
    quota = -(-n // max(1, regions))
    # a row that n of its region come before can't be among the first n, so tasks drop it before the shuffle
    placed = held.withColumn("_r", F.row_number().over(Window.partitionBy(region).orderBy("_h", key))).where(F.col("_r") <= n)
    return placed.orderBy(F.col("_r") > quota, "_h", key).limit(n).drop("_h", "_n", "_s", "_r")


def corpus_rows(df: DataFrame, i: str, value: str, templates: list[str]) -> DataFrame:
    """Value in template i mod n, cased by i mod 6 (as is, lower, upper in turn), with its gold place."""
    cased = F.when(F.col(i) % 6 == 4, F.lower(value)).when(F.col(i) % 6 == 5, F.upper(value)).otherwise(F.col(value))
    t = F.get(F.array(*map(F.lit, templates)), F.pmod(F.col(i), F.lit(len(templates))).cast("int"))
    start = F.instr(t, "{}") - 1
    return df.select("*", cased.alias("gold")).select("*", F.replace(t, F.lit("{}"), F.col("gold")).alias("text"), start.alias("start")).withColumn("end", F.col("start") + F.length("gold"))


REGISTERS = ("support", "healthcare", "authority", "everyday")
REQUIRED_REGISTERS = ("support", "healthcare", "authority")


def overlapping(entities: Column) -> Column:
    """How many of a row's entities (start, end) overlap one before them in the array."""
    before = lambda e, i: F.exists(F.slice(entities, 1, i), lambda s: (e["start"] < s["end"]) & (s["start"] < e["end"]))
    return F.coalesce(F.size(F.filter(entities, before)), F.lit(0))


def gold_issues(gold: DataFrame, least_rows: int = 200, least_writers: int = 3, least_reviewed: float = 0.2, registers: Sequence[str] = REGISTERS, required: Sequence[str] = REQUIRED_REGISTERS) -> DataFrame:
    """(issue, n) of a gold table (id, text, writer, register, entities, collected, second_reviewed); no row is an issue-free table.

    Entities are arrays of (start, end, ...); each that overlaps one before it counts. Rows without text aren't repeats of each other.
    """
    from ..functions.text import duplicate_key
    from ..functions.validators import iso_date_valid

    per_row = {
        "no text": F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0,
        "no writer": F.coalesce(F.length(F.trim("writer")), F.lit(0)) == 0,
        "bad register": ~F.coalesce(F.col("register").isin(*registers), F.lit(False)),
        "bad date": ~F.coalesce(iso_date_valid(F.col("collected")), F.lit(False)),
        "overlapping entities": overlapping(F.col("entities")),
    }
    missing = sum((F.coalesce(F.max((F.col("register") == r).cast("long")), F.lit(0)) == 0).cast("long") for r in required) if required else F.lit(0)
    rows = gold.agg(*[F.sum(c.cast("long")).alias(k) for k, c in per_row.items()], missing.cast("long").alias("m"), F.count(F.lit(1)).alias("n"), F.countDistinct("writer").alias("w"), F.avg(F.col("second_reviewed").cast("double")).alias("r"))
    found = rows.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(k).alias("issue"), F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias("n")) for k in per_row],
                F.struct(F.lit("too few rows").alias("issue"), F.greatest(F.lit(0), least_rows - F.col("n")).alias("n")),
                F.struct(F.lit("too few writers").alias("issue"), F.greatest(F.lit(0), least_writers - F.col("w")).alias("n")),
                F.struct(F.lit("missing register").alias("issue"), F.col("m").alias("n")),
                F.struct(F.lit("too few reviewed").alias("issue"), (F.coalesce("r", F.lit(0.0)) < least_reviewed).cast("long").alias("n")),
            )
        ).alias("x")
    ).select("x.issue", "x.n")
    twice = gold.select(duplicate_key(F.col("text")).alias("k")).where("k != ''").groupBy(F.sha2("k", 256)).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
    return found.unionByName(twice.select(F.lit("repeated text").alias("issue"), "n")).where("n > 0")


def pack_chunks(df: DataFrame, order: str, text: str = "text", most: int = 48_000, keys: list[str] | None = None) -> DataFrame:
    """Df with the number of each row's chunk, filled greedily in order; a row over the limit is an error.

    Rows of equal order go by their text. A group's rows stream through one task, which holds its running size alone; without
    keys the table is one group. A null text has no length.
    """
    by = keys or []
    schema = T.StructType([*df.schema.fields, T.StructField("chunk", T.IntegerType(), False)])
    at_keys, at_text, names = [df.columns.index(k) for k in by], df.columns.index(text), df.columns

    def run(items):
        group, chunk, size = None, 0, 0
        for b in items:
            lens = pc.utf8_length(b.column(at_text)).fill_null(0).to_pylist()
            out = []
            for k, n in zip(zip(*(b.column(c).to_pylist() for c in at_keys)) if at_keys else [()] * len(lens), lens):
                if n > most:
                    raise ValueError("a row is over the limit")
                if k != group:
                    group, chunk, size = k, 0, 0
                if size + n > most:
                    chunk, size = chunk + 1, 0
                size += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], [*names, "chunk"])

    safe = df.toDF(*[f"c{k}" for k in range(len(names))])  # a name with a dot couldn't be given to the function
    groups, last = [f"c{k}" for k in at_keys], [f"c{names.index(order)}", f"c{at_text}"]
    placed = safe.repartition(*groups) if by else safe.coalesce(1)
    return placed.sortWithinPartitions(*groups, *last).mapInArrow(run, schema)


_DROP = {"script", "style", "nav", "footer", "header", "aside", "noscript", "template", "svg", "form", "button", "head", "iframe"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "col"}


class _Markdown(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.skip, self.lists, self.link, self.pre, self.row, self.rows = base, [], [], [], [], 0, None, None

    def put(self, s: str) -> None:
        (self.row[-1] if self.row else self.out).append(s)

    def close_cell(self) -> None:
        """A cell ends with its end tag, or where the next cell, row or the table's end comes without one."""
        if self.row and self.rows:
            self.rows[-1].append(" ".join("".join(self.row[0]).split()).replace("|", "\\|"))
        self.row = None

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
            return
        a = dict(attrs)
        if tag in _DROP:
            self.skip.append(tag)
        elif re.fullmatch("h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "main", "blockquote"):
            self.put("\n\n" + ("> " if tag == "blockquote" else ""))
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.put("\n\n" if len(self.lists) == 1 else "")
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            kind, n = self.lists[-1] if self.lists else ("ul", 1)
            self.put("\n" + "  " * max(0, len(self.lists) - 1) + (f"{n}. " if kind == "ol" else "- "))
        elif tag == "a":
            self.link.append(urljoin(self.base, a["href"]) if a.get("href") else None)
            self.put("[" if self.link[-1] else "")
        elif tag == "img" and a.get("src"):
            self.put(f"![{a.get('alt') or ''}]({urljoin(self.base, a['src'])})")
        elif tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag in ("strong", "b"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("*")
        elif tag == "pre":
            self.pre += 1
            self.put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.close_cell()
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.close_cell()
            self.row = [[]]

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag == "a" and self.link:
            href = self.link.pop()
            self.put(f"]({href})" if href else "")
        elif tag in ("strong", "b"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("*")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.put("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.put("\n\n" if not self.lists else "")
        elif re.fullmatch("h[1-6]|p|div|section|article|blockquote", tag):
            self.put("\n\n")
        elif tag in ("td", "th"):
            self.close_cell()
        elif tag == "table" and self.rows is not None:
            self.close_cell()
            rows, self.rows, self.row = [r for r in self.rows if r], None, None
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                self.put("\n\n" + "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.put(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(page: str, base: str = "") -> str:
    """X9 for one page."""
    p = _Markdown(base or "")
    p.feed(page)
    p.close()
    text = "".join(p.out)
    lines = [ln.rstrip() if k % 2 else re.sub(r"^ +(?![-0-9])", "", ln.rstrip()) for k, ln in ((0, x) for x in text.split("\n"))]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(pages: pd.Series, bases: pd.Series) -> pd.Series:
    """X9."""
    return pd.Series([None if p is None else to_markdown(p, b or "") for p, b in zip(pages, bases)])


def page_title(c: Column) -> Column:
    """A page's title, its character references decoded by ``unescape``."""
    return unescape(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


@F.pandas_udf(T.StringType())
def unescape(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else html.unescape(t))


def negotiate(accept: str | None, offers: list[str]) -> str | None:
    """The offer with the best quality; ties by specificity, then place in the header, then order of offers."""
    ranges = []
    for k, part in enumerate((accept or "*/*").split(",")):
        kind, *params = (x.strip() for x in part.split(";"))
        q = next((p[2:] for p in params if p.lower().startswith("q=")), "1")
        try:
            ranges.append((kind.lower(), min(1.0, max(0.0, float(q))), k))
        except ValueError:
            continue
    best = None
    for n, offer in enumerate(offers):
        fits = [((2 if kind == offer.lower() else 1 if kind == offer.split("/")[0].lower() + "/*" else 0), q, k) for kind, q, k in ranges if kind in (offer.lower(), offer.split("/")[0].lower() + "/*", "*/*")]
        if fits:
            spec, q, k = max(fits, key=lambda x: (x[0], -x[2]))
            if q > 0 and (best is None or (q, spec, -k, -n) > best[0]):
                best = (q, spec, -k, -n), offer
    return best[1] if best else None


def first_difference(a, b, path: str = "$") -> str | None:
    """Where two nested values first differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        for k in sorted({*a, *b}, key=str):
            if (k in a) != (k in b):
                return f"{path}.{k}"
            if d := first_difference(a[k], b[k], f"{path}.{k}"):
                return d
        return None
    if isinstance(a, list) and isinstance(b, list):
        for k, (x, y) in enumerate(zip(a, b)):
            if d := first_difference(x, y, f"{path}[{k}]"):
                return d
        return None if len(a) == len(b) else f"{path}[{min(len(a), len(b))}]"
    return None if type(a) is type(b) and a == b else path


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """O9 for tables: rows that only one has, with repeats."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def aligned(a: DataFrame, b: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Rows of both by order; an error if the texts there aren't the same."""
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{order}") == F.col(f"b.{order}"), "full")
    same = F.coalesce(F.equal_null(F.col(f"a.{text}"), F.col(f"b.{text}")) & F.col(f"a.{order}").isNotNull() & F.col(f"b.{order}").isNotNull(), F.lit(False))
    return j.select(F.when(same, F.col(f"a.{order}")).otherwise(F.raise_error(F.lit("the tables aren't aligned"))).alias(order), F.col(f"a.{text}").alias(text))
