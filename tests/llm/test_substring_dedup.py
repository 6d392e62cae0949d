import random

import numpy as np

from hushframe.llm.substring_dedup import cut, looked_at, parse, repeats, substring_spans

SF = "/root/testdata/sf0.001"


def brute(rows, least):
    """Runs of words that lie in a window of ``least`` words which another document has too."""
    where = {}
    rows = {(i, t) for i, t in rows if t is not None}
    for key in rows:
        w = key[1].split()
        for k in range(len(w) - least + 1):
            where.setdefault(tuple(w[k : k + least]), set()).add(key)
    out = []
    for key in rows:
        w = key[1].split()
        start = end = None
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                if end is not None and k > end:
                    out.append((key[0], start, end))
                    start = None
                start = k if start is None else start
                end = k + least
        if start is not None:
            out.append((key[0], start, end))
    return sorted(out, key=repr)


def spans(df, **o):
    return sorted(((r.doc_id, r.start_word, r.end_word) for r in substring_spans(df, **o).collect()), key=repr)


def test_documents_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()], 50)
    assert want and spans(df) == want


def test_query(spark):
    import __spark_entry__ as e

    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(((r.doc_id, r.start_word, r.end_word) for r in e.queries()["op1_substring_dedup"](spark, SF).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], 50)


def mosaic(seed, docs=60, alphabet=40):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(alphabet)}" for _ in range(rng.randrange(5, 40))] for _ in range(8)]
    return [(k, " ".join(w for _ in range(rng.randrange(1, 6)) for w in (rng.choice(pool) if rng.random() < 0.7 else [f"u{rng.random()}"] * 3))) for k in range(docs)]


def test_mosaics_against_brute_force(spark):
    for seed, least in ((1, 12), (2, 20), (3, 31)):
        rows = mosaic(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert spans(df, least=least) == brute(rows, least), (seed, least)


def test_hot_minimizers_split_without_loss(spark):
    rows = mosaic(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.start, r.end) for r in repeats(df, least=20, hot=1).collect()), key=repr)
    assert got == brute(rows, 20)


def test_edges(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a b {p} c", "x"), (2, f"{p}", None), (None, f"z {p}", "x"), (3, None, "x"), (4, "", "x"), (5, "short", "y"), (6, f"{'rep ' * 200}", "y"), (6, f"{'rep ' * 200}", "y"), (7, "q " * 30000 + p, "l"), (8, f"x {p}", "t"), (8, f"y y {p}", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    want = brute([r[:2] for r in rows], 50)
    assert spans(df) == want and (None, 1, 61) in want and not [s for s in want if s[0] == 6]
    assert substring_spans(df.where("false")).count() == 0
    out = {(r.doc_id, r.text) for r in cut(df).collect()}
    assert cut(df).columns == df.columns and {(1, "a b c"), (2, ""), (3, None), (4, ""), (8, "y y")} <= out


def test_greedy_factors_with_boundary_checks_cover_every_long_match():
    """Against all starts, on lengths as matches make them (one start on, a match is one shorter at most)."""
    rng = np.random.default_rng(5)
    for least, starts in ((5, 6), (50, 41), (3, 20)):
        width = starts + least - 1  # every start that can hold a long match is one
        length = np.zeros((4000, starts), np.int32)
        for k in range(len(length)):
            ends = np.zeros(starts, np.int64)
            for _ in range(rng.integers(0, 5)):
                s = rng.integers(0, starts)
                ends[s] = max(ends[s], min(width, s + rng.integers(1, 2 * least)))
            reach = np.maximum.accumulate(ends)
            length[k] = np.maximum(0, reach - np.arange(starts))
        cover = np.zeros((len(length), width), bool)
        for c, s in zip(*np.nonzero(length >= least)):
            cover[c, s : s + length[c, s]] = True
        found = np.zeros_like(cover)
        for c, b, e in zip(*parse(length, least, width)):
            found[c, b:e] = True
        assert (found == cover).all()
        assert looked_at(length, least).mean() < 1
