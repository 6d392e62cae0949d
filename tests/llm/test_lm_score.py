import collections
import math

import numpy as np
import pytest

from hushframe.llm.elias_fano import EliasFano, build, bundle, unbundle
from hushframe.llm.lm_score import BEGIN, END, STEP, granularity, lm_scores, train
from hushframe.llm.sstable import token_ids

SF = "/root/testdata/sf0.001"


def sequence(values, universe):
    return EliasFano(np.frombuffer(build(np.array(values), universe), np.uint8))


@pytest.mark.parametrize("n,universe,seed", [(1, 1, 0), (1, 10**9, 1), (1000, 1001, 2), (5000, 10**12, 3), (3000, 700, 4), (0, 50, 5)])
def test_elias_fano_against_bisection(n, universe, seed):
    rng = np.random.default_rng(seed)
    values = np.sort(rng.integers(0, universe, n))
    ef = sequence(values, universe)
    if n:
        assert (ef.access(np.arange(n)) == values).all()
    x = rng.integers(0, universe, 2000)
    x[: min(n, 1000)] = values[:1000]
    at, same = ef.successor(x)
    assert (at == np.searchsorted(values, x)).all()
    assert (same == np.isin(x, values)).all()


def test_bundle():
    got = unbundle(np.frombuffer(bundle({"a": b"xyz", "b": b"", "c": b"12345678"}), np.uint8))
    assert {k: bytes(v) for k, v in got.items()} == {"a": b"xyz", "b": b"", "c": b"12345678"}


class Brute:
    def __init__(self, texts, keep=1):
        self.code = token_ids()
        self.c3 = collections.Counter()
        for t in texts:
            if t is not None:
                x = self.tokens(t)
                self.c3.update(zip(x, x[1:], x[2:]))
        self.keep, self.size = keep, self.code.pieces.size
        self.c2, self.n2, self.kept = collections.Counter(), collections.Counter(), collections.Counter()
        for (a, b, _), n in self.c3.items():
            self.c2[a, b] += n
            self.n2[a, b] += 1
        for (a, b, _), n in self.c3.items():
            if n >= keep:
                self.kept[a, b] += n / (self.c2[a, b] + self.n2[a, b])
        self.c1, self.n1, self.last = collections.Counter(), collections.Counter(), collections.Counter()
        for (a, b), n in self.c2.items():
            self.c1[a] += n
            self.n1[a] += 1
            self.last[b] += n if b != BEGIN else 0
        self.seen = max(1, sum(n > 0 for n in self.last.values()))
        self.total = sum(self.last.values())

    def tokens(self, text):
        return [BEGIN, BEGIN, *np.frombuffer(self.code.encode(text), self.code.type).tolist(), END, END]

    def p(self, u, v, w):
        p = (self.last[w] + self.seen / self.size) / (self.total + self.seen)
        if self.c1[v]:
            p = (self.c2[v, w] + self.n1[v] * p) / (self.c1[v] + self.n1[v])
        if self.c2[u, v]:
            n = self.c3[u, v, w]
            p = (n / (self.c2[u, v] + self.n2[u, v]) if n >= self.keep else 0) + (1 - self.kept[u, v]) * p
        return p

    def score(self, text):
        x = self.tokens(text)[:-1]
        return sum(math.log(self.p(*g)) for g in zip(x, x[1:], x[2:])), len(x) - 2


def test_scores_against_brute_force(spark):
    import __spark_entry__ as e

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    brute = Brute([r.text for r in rows])
    got = {r.doc_id: r for r in e.queries()["op5_lm_score"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows[:80]:
        lp, n = brute.score(r.text)
        assert got[r.doc_id].n_tokens == n
        assert abs(got[r.doc_id].log_prob - lp) / n < 0.04
        assert abs(math.exp(-got[r.doc_id].log_prob / n) / got[r.doc_id].perplexity - 1) < 1e-9


def test_contexts_sum_to_about_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs)()
    brute = Brute([r.text for r in docs.collect()])
    w = np.arange(model.shape.size)
    for u, v in [*list(brute.c2)[:5], (BEGIN, BEGIN), (7, 31000)]:
        assert abs(np.exp(model.log_probs(np.full(len(w), u), np.full(len(w), v), w)).sum() - 1) < 0.05


def test_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b", None), (2, None, "x"), (3, "", "x"), (4, "z " * 50000, "y"), (5, "▁ ퟿ 漢字", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = {(r.doc_id, r.n_tokens): r for r in lm_scores(df).collect()}
    assert got[2, None].log_prob is None and got[2, None].perplexity is None
    assert got[3, 1].log_prob < 0
    brute = Brute([r[1] for r in rows])
    for i, t, _ in rows:
        if t is not None:
            lp, n = brute.score(t)
            # two codes, each off by half a step at most, make a token's probability
            assert abs(got[i, n].log_prob - lp) / n <= STEP
    assert lm_scores(df.where("false")).count() == 0


def test_blocks_stay_in_proportion():
    for chars in (0, 10**6, 10**9, 3 * 10**10, 10**12, 10**14):
        shards, chunk = granularity(chars)
        tokens = chars / 2
        assert shards >= 4 and chunk >= 1 << 19
        if chars > 10**9:
            assert chunk * (tokens / shards) / tokens >= 19  # n-grams a block
    assert granularity(10**14)[1] < 1 << 25


@pytest.mark.parametrize("shard_chars,chunk", [(300, 64), (10**6, 200)])
def test_any_granularity_gives_the_same_scores(spark, monkeypatch, shard_chars, chunk):
    from hushframe.llm import lm_score

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    want = {r.doc_id: r.log_prob for r in lm_scores(docs).collect()}
    monkeypatch.setattr(lm_score, "granularity", lambda chars: (max(4, min(40, chars // shard_chars)), chunk))
    got = {r.doc_id: r.log_prob for r in lm_scores(docs.repartition(3)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * (1 + abs(want[i])) for i in want)
