import itertools

from pyspark.sql import functions as F

import corpus_pipeline as cp
from hushframe.llm import piece_codec as pc
from hushframe.llm.mixing import route, smoothed_quotas
from hushframe.llm.quality_rules import GRIDS, Scorer, calibrate

SF = "/root/testdata/sf0.001"


def near_groups(rows):
    sets = {}
    for r in rows:
        w = r.text.split()
        sets[r.doc_id] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or {tuple(w)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.5:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in sets if find(i) == i}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("*", F.xxhash64(F.lit(4), F.col("doc_id").cast("string")).alias("h")).collect()
    policy, _ = calibrate(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = Scorer(policy.lexicon)
    rows = [r for r in rows if (s := scorer(r.text)) and all(x <= policy.cutoffs.get((r.lang, k), float("inf")) for x, k in zip(s, GRIDS))]
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.text, r)
    rows = list(first.values())
    keep = near_groups(rows)
    by = {}
    for r in rows:
        if r.doc_id in keep:
            by.setdefault("\x1f".join(sorted({f"source:{r.source}"} | ({f"lang:{r.lang}"} if r.lang != "en" else set()))), []).append((r.h, len(r.text.split()), r))
    patterns = [(tuple(p.split("\x1f")), sum(t for _, t, _ in x)) for p, x in sorted(by.items())]
    carried = route(patterns, smoothed_quotas(patterns, sum(t for _, t in patterns), 0.7), 4)
    want = []
    for (p, t), f in zip(patterns, carried):
        left, open_ = f % t, True
        for _, n, r in sorted(by["\x1f".join(p)], key=lambda x: x[0]):
            open_ = open_ and n <= left
            left -= n if open_ else 0
            want += [r] * (f // t + (open_ and f % t > 0))
    got = cp.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in want)
    pieces = {r.doc_id: r.pieces for r in got}
    for r in want:
        assert pc.decode(pieces[r.doc_id]) == r.text
        assert pieces[r.doc_id] == pc.encode_batch([r.doc_id], [r.text], dropout=0.1, seed=20)[0].tolist()


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert cp.STAGES[-1][1](spark, docs, SF).count() == 0 and cp.ORACLE_SQL is None
