"""Operator 6: quality rules whose cutoffs carry a guarantee against false rejection.

Each rule scores a text and rejects scores above a cutoff. A scan scores all rules at once.
Cutoffs are chosen per stratum on labelled holdouts:

* For every rule and stratum the candidate cutoffs, fixed in advance, are tested from
  lenient to strict. A cutoff is certified if the exact binomial probability of as few
  false rejections as were seen, were the true rate ``alpha / rules``, is at most
  ``delta / (rules * strata)``; testing stops at the first that fails. Testing in a fixed
  order needs no correction within a rule; Bonferroni's covers rules and strata. So, with
  probability 1 - delta, in every stratum at most a share ``alpha`` of good documents is
  rejected by all rules together.
* Of the certified cutoffs, those with the largest gain (bad documents rejected less
  ``GOOD_WEIGHT`` times the good ones) are taken, the middle one of them; where no gain is
  positive, the rule is off. A stratum with
  too few labels certifies nothing and loses no document.

A document is good with quality 1 and toxic 0, bad with quality 0 or toxic 1. Trials must be
independent, so equal texts count once in a stratum (least quality, most toxic of their
labels), and the split below is by content. The lexicon rule counts words of a list that is
fitted on at most ``fit_docs`` labelled texts of a hash-chosen fifth of all contents, which no holdout
uses. Everything else - scores, holdout counts, cutoffs - covers all rows; cutoffs are chosen by
tasks, one stratum each, so their number isn't bounded.

Edges: a null text, or one without words, is rejected; a null stratum is the stratum "(null)", others
go by their string; labels repeated for an id count once (least quality, most toxic), null labels
not at all; documents without labels are only judged; repeated rows are judged alike; a very long
text is scored whole; with no labels or no documents nothing is certified. Extra columns are
carried along whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import cached_property
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, discard, spare, words_of, written

SHARES = [round(0.6 * 0.8**k, 6) for k in range(28)]  # 0.6 down to 0.0015
COUNTS = [k + 0.5 for k in range(39, -1, -1)]
PLAIN = frozenset(".,;:'’\"!?()-")
MEMO_WORDS = 150_000
_FIELD = (1 << 40) - 1
_LETTERS = re.compile(r"[^\W\d_]+")
NO_STRATUM = "(null)"
#: A cutoff's gain is the bad documents it rejects less so many times the good ones.
GOOD_WEIGHT = 10
#: Most strata whose cutoffs are broadcast; more are joined by shuffle.
BROADCAST_STRATA = 10_000


class Scorer:
    """Rule scores of texts. All but one add up over words, so words are told apart first (``many``) or their shares memoised."""

    def __init__(self, lexicon: list[str]) -> None:
        self.lexicon, self.memo = frozenset(lexicon), {}
        self.blocks, self.table = set(), np.zeros(0x110000, np.uint8)

    def _word(self, w: str) -> int:
        letters = upper = symbols = 0
        for c in w:
            if c.isalpha():
                letters += 1
                upper += c.isupper()
            elif not c.isdigit() and c not in PLAIN and unicodedata.category(c)[0] not in "MN":
                symbols += 1
        bare = not letters and not any(map(str.isalnum, w))
        hits = sum(x in self.lexicon for x in _LETTERS.findall(w.lower())) if self.lexicon else 0
        # six counts of 40 bits each
        packed = len(w) | letters << 40 | upper << 80 | symbols << 120 | (w.count("!") + w.count("?")) << 160 | bare << 200 | hits << 240
        if len(w) <= 64:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[w] = packed
        return packed

    def _flags(self, cps: np.ndarray) -> np.ndarray:
        """Classes of characters, from a table that grows by blocks of 256."""
        for block in set(np.flatnonzero(np.bincount(cps >> 8)).tolist()) - self.blocks:
            self.blocks.add(block)
            for c in range(block << 8, block + 1 << 8):
                ch = chr(c)
                alpha = ch.isalpha()
                symbol = not alpha and not ch.isdigit() and ch not in PLAIN and unicodedata.category(ch)[0] not in "MN"
                self.table[c] = alpha | (alpha and ch.isupper()) << 1 | symbol << 2 | (ch in "!?") << 3 | ch.isalnum() << 4
        return self.table[cps]

    def _hits(self, w: str) -> int:
        if w.isascii() and w.isalpha():
            return w.lower() in self.lexicon
        return sum(x in self.lexicon for x in _LETTERS.findall(w.lower()))

    def many(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which texts have words, and these texts' scores by rule; equal to one call a text."""
        words, at, counts = words_of(texts)
        some = counts > 0
        if not some.any():
            return some, [np.zeros(0)] * len(GRIDS)
        cps = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        flags, first = self._flags(cps), np.cumsum(size) - size
        letters, upper, symbols, shouts, alnum = (np.add.reduceat((flags >> k & 1).astype(np.int64), first) for k in range(5))
        hits = np.fromiter(map(self._hits, words), np.int64, len(words)) if self.lexicon else np.zeros(len(words), np.int64)
        n = counts[some]
        starts = np.cumsum(n) - n
        of = lambda x: np.add.reduceat(x[at], starts)
        again = np.append(False, at[1:] == at[:-1])
        again[starts] = False
        size, letters, upper, symbols, shouts, bare, hits = map(of, (size, letters, upper, symbols, shouts, (alnum == 0).astype(np.int64), hits))
        return some, [symbols / size, upper / np.maximum(1, letters), shouts / n, bare / n, np.add.reduceat(again.astype(np.int64), starts) / n, hits.astype(float)]

    def __call__(self, text: str | None) -> tuple[float, ...] | None:
        """Scores in the order of GRIDS; None for a text without words."""
        words = text.split() if text else []
        if not words:
            return None
        parts = list(map(self.memo.get, words))
        if None in parts:
            parts = [self._word(w) if p is None else p for p, w in zip(parts, words)]
        total = sum(parts)
        size, letters, upper, symbols, shouts, bare = (total >> k & _FIELD for k in range(0, 240, 40))
        n = len(words)
        again = sum(map(eq, words, islice(words, 1, None)))
        return symbols / size, upper / max(1, letters), shouts / n, bare / n, again / n, float(total >> 240)


GRIDS = {"symbol_share": SHARES, "upper_share": SHARES, "shout_share": SHARES, "bare_share": SHARES, "repeat_share": SHARES, "lexicon_hits": COUNTS}


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Bin(n, p), summed exactly."""
    if k >= n:
        return 1.0
    if p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(k + 1, dtype=float)
    steps = np.log(np.maximum(n - i[:-1], 1)) - np.log(i[:-1] + 1) if k else np.zeros(0)
    logs = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)]) + i * (math.log(p) - math.log1p(-p))
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


@dataclass(frozen=True)
class Policy:
    lexicon: list[str]
    table: DataFrame  # (stratum, a cutoff for each rule); null: the rule is off

    @cached_property
    def cutoffs(self) -> dict[tuple[str, str], float]:
        """(stratum, rule) -> cutoff, for a report."""
        return {(r["stratum"], rule): r[rule] for r in self.table.collect() for rule in GRIDS if r[rule] is not None}


def choose(counts: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]], strata: int, alpha: float, delta: float) -> tuple[dict, list[dict]]:
    """Cutoffs from, per (stratum, rule), good and bad documents by the number of grid cutoffs below their score."""
    rules = len(GRIDS)
    level, risk, cutoffs, tests = delta / (rules * max(1, strata)), alpha / rules, {}, []
    for (stratum, rule), (good, bad) in sorted(counts.items()):
        grid = GRIDS[rule]
        n, best = int(good.sum()), []
        for j, cut in enumerate(grid):
            # the grid falls, so a score is above cutoff j if at least len(grid) - j cutoffs lie below it
            lost, caught = int(good[len(grid) - j :].sum()), int(bad[len(grid) - j :].sum())
            p = binomial_cdf(lost, n, risk) if n else 1.0
            tests.append({"stratum": stratum, "rule": rule, "cutoff": cut, "n_good": n, "good_rejected": lost, "bad_rejected": caught, "p": p, "certified": p <= level})
            if p > level:
                break
            best.append((caught - GOOD_WEIGHT * lost, cut))
        gain = max((g for g, _ in best), default=0)
        if gain > 0:
            ties = [c for g, c in best if g == gain]
            cutoffs[stratum, rule] = ties[len(ties) // 2]
    return cutoffs, tests


def fit_lexicon(docs: DataFrame, labels: DataFrame, fit_docs: int, support: int = 8, precision: float = 0.9) -> list[str]:
    """All words, of at least ``support`` different fitting texts, of which a share ``precision`` is toxic."""
    rows = labels.where("fit").orderBy("order", "id").limit(fit_docs).select("id", "toxic")
    held = docs.join(F.broadcast(rows), "id")  # at most fit_docs rows
    texts = held.groupBy(F.md5("text")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}++"), F.lit(0))))
    stats = texts.select("toxic", words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    found = stats.where((F.col("n") >= support) & (F.col("t") >= precision * F.col("n"))).orderBy("word")
    return [r["word"] for r in found.collect()]


def score(slim: DataFrame, lexicon: list[str]) -> DataFrame:
    """(id, stratum, content, rules) of rows (id, stratum, content, text); texts without words are left out."""
    schema = T.StructType([slim.schema["id"], slim.schema["stratum"], slim.schema["content"], *[T.StructField(r, T.DoubleType()) for r in GRIDS]])

    def run(items):
        scorer = Scorer(lexicon)
        for b in batches(items, nbytes=2 << 20):
            some, rules = scorer.many(b.column(3))
            some = pa.array(some)
            yield pa.RecordBatch.from_arrays([*(b.column(k).filter(some) for k in range(3)), *map(pa.array, rules)], ["id", "stratum", "content", *GRIDS])

    return slim.select("id", "stratum", "content", "text").mapInArrow(run, schema)


def _merged(rows: DataFrame, *by: str, **more) -> DataFrame:
    """Labels of rows that are equal in ``by`` as one: least quality, most toxic; with good, bad, and whether the text fits the lexicon."""
    one = rows.groupBy(*by).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"), *[f.alias(k) for k, f in more.items()])
    toxic = F.coalesce("toxic", F.lit(0))
    good, bad = (F.col("quality") == 1) & (toxic == 0), (F.col("quality") == 0) | (toxic == 1)
    order = F.xxhash64("content", F.lit("lexicon"))
    return one.select(*by, *more, toxic.alias("toxic"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(bad, F.lit(False)).alias("bad"), order.alias("order"), (F.pmod(order, F.lit(5)) == 0).alias("fit"))


def _stratum(stratum_col: str):
    return F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit(NO_STRATUM))


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_STRATA else table


def calibrate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = 0.05, delta: float = 0.05, fit_docs: int = 20_000) -> tuple[Policy, DataFrame]:
    """The policy, and the scores (id, stratum, content, rules) of all documents as a written table."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), _stratum(stratum_col).alias("stratum"), F.unhex(F.md5(text.cast("binary"))).alias("content"))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marks = written(slim.where("content is not null").select("id", "content").join(known, "id"), "marks")
    lexicon = fit_lexicon(slim, _merged(marks, "content", id=F.min("id")).where("fit"), fit_docs)
    table = written(score(slim, lexicon), "scores")
    rows = table.join(marks, ["id", "content"])
    # A text counts once in a stratum however many copies it has, and a copy of a fitting text is one as well.
    held = _merged(rows, "stratum", "content", **{r: F.first(r) for r in GRIDS}).where("not fit and (good or bad)")
    below = [F.struct(F.lit(r).alias("rule"), sum(((F.col(r) > c).cast("int") for c in g), F.lit(0)).alias("bucket")) for r, g in GRIDS.items()]
    counts = held.select("stratum", "good", F.explode(F.array(*below)).alias("b")).groupBy("stratum", "b.rule", "b.bucket", "good").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "holdout-counts")
    strata = counts.select("stratum").distinct().count()

    def certify(part):  # at most rules x grid x 2 rows a stratum
        stratum, by = part["stratum"].iloc[0], {}
        for rule, bucket, good, n in zip(part["rule"], part["bucket"], part["good"], part["n"]):
            pair = by.setdefault((stratum, rule), tuple(np.zeros(len(GRIDS[rule]) + 1, np.int64) for _ in range(2)))
            pair[0 if good else 1][bucket] += n
        cutoffs, _ = choose(by, strata, alpha, delta)
        return pd.DataFrame([{"stratum": stratum} | {r: cutoffs.get((stratum, r)) for r in GRIDS}]).astype({r: float for r in GRIDS})

    cuts = counts.groupBy("stratum").applyInPandas(certify, "stratum string, " + ", ".join(f"{r} double" for r in GRIDS))
    cuts = cuts.select("stratum", *[F.when(~F.isnan(r), F.col(r)).alias(r) for r in GRIDS])
    policy = Policy(lexicon, written(cuts, "cutoffs"))
    discard(marks, counts)
    return policy, table


def accepted_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, stratum, scores) of the documents that pass."""
    policy, table = calibrate(docs, labels, **options)
    cuts = policy.table.select("stratum", *[F.col(r).alias(f"cut_{r}") for r in GRIDS])
    fine = F.lit(True)
    for r in GRIDS:
        fine = fine & F.coalesce(F.col(r) <= F.col(f"cut_{r}"), F.lit(True))
    passing = table.join(_few(cuts), "stratum", "left").where(fine)
    return passing.select(F.col("id").alias("doc_id"), "stratum", *GRIDS)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """The rows of docs that pass, in its columns. Texts are scored again instead of shuffled."""
    policy, scores = calibrate(docs, labels, id_col, text_col, stratum_col, **options)
    discard(scores)
    c_stratum, c_text, *c_cuts = spare(docs, "stratum", "text_", *[f"cut_{r}" for r in GRIDS])
    cuts = policy.table.select(F.col("stratum").alias(c_stratum), *[F.col(r).alias(c) for r, c in zip(GRIDS, c_cuts)])
    judged = docs.withColumn(c_stratum, _stratum(stratum_col)).join(_few(cuts), c_stratum, "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{text_col}`").cast("string").alias(c_text), *c_cuts)
    own, names, lexicon = len(docs.columns), docs.columns, policy.lexicon

    def run(items):
        scorer = Scorer(lexicon)
        for b in batches(items, nbytes=2 << 20):
            keep, rules = scorer.many(b.column(own))
            keep = keep.copy()
            at = np.flatnonzero(keep)
            for k, x in enumerate(rules):
                cut = b.column(own + 1 + k).cast(pa.float64()).fill_null(math.inf).to_numpy()
                keep[at[x > cut[at]]] = False
            yield pa.RecordBatch.from_arrays(b.columns[:own], names).filter(pa.array(keep, pa.bool_()))

    # by place: a name with a dot couldn't be given to the function
    return judged.toDF(*[f"c{k}" for k in range(len(judged.columns))]).mapInArrow(run, docs.schema)
