import itertools

from pyspark.sql import functions as F

from hushframe.llm.mixing import facets, min_cost_flow, mix, mixed, route, smoothed_quotas, word_count

SF = "/root/testdata/sf0.01"


def test_flow_against_enumeration():
    arcs = [(0, 1, 2, 0), (0, 1, 2, 1), (0, 2, 2, 0), (0, 2, 1, 3), (1, 3, 4, 0), (1, 4, 4, 0), (2, 4, 3, 0), (3, 5, 3, 0), (4, 5, 3, 0)]
    best = (0, 0)
    for f in itertools.product(*[range(c + 1) for _, _, c, _ in arcs]):
        net = [0] * 6
        for x, (u, v, _, _) in zip(f, arcs):
            net[u] -= x
            net[v] += x
        if not any(net[1:5]):
            best = max(best, (net[5], -sum(x * w for x, (_, _, _, w) in zip(f, arcs))))
    flow, total, cost = min_cost_flow(6, arcs, 0, 5)
    assert (total, -cost) == best and all(0 <= x <= c for x, (_, _, c, _) in zip(flow, arcs))


def test_route_spreads_repetition():
    carried = route([(("a",), 10), (("b",), 10), (("a", "b"), 10)], {"a": 30, "b": 10}, 4)
    assert sum(carried) == 40 and carried[0] == 20 and carried[2] in (10, 20)
    assert route([(("a",), 5)], {"a": 100, "z": 7}, 4) == [20]


def test_query_takes_the_hash_prefix_that_fits(spark):
    import __spark_entry__ as e

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    h = F.xxhash64(F.lit(4), F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "source", "lang", word_count(F.col("text")).alias("t"), h.alias("h"), facets(docs).alias("m")).collect()
    by = {}
    for r in rows:
        by.setdefault(tuple(sorted(set(r.m))), []).append(r)
    patterns = [(p, sum(r.t for r in rs)) for p, rs in sorted(by.items(), key=lambda x: "\x1f".join(x[0]))]
    carried = route(patterns, smoothed_quotas(patterns, sum(t for _, t in patterns), 0.7), 4)
    want = {}
    for (p, t), f in zip(patterns, carried):
        left, open_ = f % t, True
        for r in sorted(by[p], key=lambda r: r.h):
            open_ = open_ and r.t <= left
            left -= r.t if open_ else 0
            if n := f // t + open_ * (f % t > 0):
                want[r.doc_id] = n
    got = {r.doc_id: r.n_epochs for r in e.queries()["op4_mixing"](spark, SF).collect()}
    assert got == want


def test_edges(spark):
    rows = [(1, "a b c", "s", "en", 1), (1, "a b c", "s", "en", 1), (None, "x y", None, "en", 2), (2, None, "s", None, 3), (3, "", "t", "de", 4), (4, "w " * 100_000, "u", "en", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_epochs int")
    marked, plan = mix(df, facets(df), word_count(F.col("text")))
    assert marked.count() == len(rows) and plan.count() == 5
    out = mixed(df, facets(df), word_count(F.col("text")), seed=1)
    assert out.columns == df.columns
    marked = [r for r in mix(df, facets(df), word_count(F.col("text")), seed=1)[0].collect() for _ in range(r[-1])]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted((tuple(r)[: len(df.columns)] for r in marked), key=repr) and marked
    empty = mixed(df.where("false"), facets(df), word_count(F.col("text")))
    assert empty.count() == 0


def test_same_seed_same_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b, c = (sorted(r.doc_id for r in mixed(docs.repartition(k), facets(docs), word_count(F.col("text")), seed=s, budget_share=0.5).select("doc_id").collect()) for k, s in ((1, 1), (7, 1), (3, 2)))
    assert a == b != c


def test_extra_columns_of_any_name(spark):
    names = ["pattern", "order", "n_epochs", "cut_pattern", "base", "last", "_p", "again", "_again", "bucket", "rest", "tokens", "t", "a.b"]
    df = spark.createDataFrame([(k, "a b c", f"s{k % 2}\x1fx", "en", *[k] * len(names)) for k in range(20)], ["doc_id", "text", "source", "lang", *names])
    out = mixed(df, facets(df), word_count(F.col("text")))
    assert out.columns == df.columns and 0 < out.count() <= 80
    _, plan = mix(df, facets(df), word_count(F.col("text")))
    assert plan.count() == 2


def test_flow_over_many_patterns_is_quick():
    """Against the plain successive shortest paths' total and cost on a small net, and in time on a large one."""
    import random
    import time

    rng = random.Random(4)
    sources = [f"s{k}" for k in range(30)]
    patterns = [(tuple(rng.sample(sources, rng.randrange(1, 4))), rng.randrange(1, 1000)) for _ in range(20_000)]
    quotas = smoothed_quotas(patterns, sum(t for _, t in patterns), 0.7)
    began = time.time()
    carried = route(patterns, quotas, 4)
    assert time.time() - began < 60
    assert sum(carried) <= sum(quotas.values()) and all(0 <= f <= 4 * t for f, (_, t) in zip(carried, patterns))
    assert sum(carried) > 0.99 * sum(quotas.values())
