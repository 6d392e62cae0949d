import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm.ngram_join import depths, near_classes, near_dedup, representative_pairs, stop_depth

SF = "/root/testdata/sf0.01"


def sets_of(rows, n=3):
    out = {}
    for i, t in rows:
        w = (t or "").split()
        if w and i is not None:
            out.setdefault(i, []).append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)})
    return out


def brute(rows, threshold=0.5):
    sets, where, shared = sets_of(rows), {}, {}
    for i, (s,) in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    for ids in where.values():
        for a, b in itertools.combinations(sorted(ids), 2):
            shared[a, b] = shared.get((a, b), 0) + 1
    jac = {(a, b): c / (len(sets[a][0]) + len(sets[b][0]) - c) for (a, b), c in shared.items()}
    return {p: j for p, j in jac.items() if j >= threshold}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def links_of(rows, pairs):
    """Rows, class (least id of the connected group) and number of other rows linked, by brute force over (position, text)."""
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, least.get(find(k), i) if links[k] else i, links[k]) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def truth(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    return rows, brute(rows)


@pytest.mark.parametrize("crowd", [4096, 12])
def test_recall_and_exact_values(documents, truth, crowd):
    rows, want = truth
    sets, least = sets_of(rows), {}
    for i, (s,) in sorted(sets.items()):
        least.setdefault(frozenset(s), i)
    want = {(a, b): j for (a, b), j in want.items() if least[frozenset(sets[a][0])] == a and least[frozenset(sets[b][0])] == b and sets[a] != sets[b]}
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in representative_pairs(documents, crowd=crowd).collect()}
    assert set(got) <= set(want)
    assert all(abs(want[p] - j) < 1e-12 for p, j in got.items())
    assert len(got) >= 0.95 * len(want)


def test_query_against_brute_force(spark, truth):
    import __spark_entry__ as e

    rows, pairs = truth
    place = {i: k for k, (i, _) in enumerate(rows)}
    want = {r[0]: r for r in links_of(rows, [(place[a], place[b]) for a, b in pairs])}
    got = {r.doc_id: tuple(r) for r in e.queries()["op3_ngram_join"](spark, SF).collect()}
    assert set(got) == set(want)
    assert all(got[i][2] <= want[i][2] for i in want)
    assert sum(r[2] for r in got.values()) >= 0.95 * sum(r[2] for r in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_depths_keep_the_recall():
    for full in (0, 1, 7, 24, 40, 48):
        d = depths(np.arange(48) < full, 4, 0.5, 0.95)
        assert 1 - np.prod(1 - 0.5 ** d.astype(float)) >= 0.95
        assert set(d[:full]) <= {4, 5} and set(d[full:]) <= {3, 4}
        assert full > 7 or set(d[:full]) <= {5}


def test_crowded_nodes_are_never_held_and_lose_nothing(spark):
    """A passage that a third of all texts share makes crowded prefixes; links stay."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = [(k, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(20)])) for k in range(150)]
    rows += [(150 + k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(80))) for k in range(300)]
    pairs = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for crowd in (4, 60):
        got = near_classes(df, crowd=crowd).collect()
        assert len(got) == 450 and sum(r.n_links for r in got) >= 0.95 * 2 * len(pairs)


def test_stop_depth():
    d = stop_depth(0.5, 48, 0.95)
    assert 1 - (1 - 0.5**d) ** 48 >= 0.95 > 1 - (1 - 0.5 ** (d + 1)) ** 48
    with pytest.raises(ValueError):
        stop_depth(0.1, 2, 0.95)


def test_large_cluster_is_complete(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(base[:k % 100] + [f"x{k}"] + base[k % 100 + 1 :])) for k in range(400)]
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400 and all(r.class_id == 0 and r.n_links == 399 for r in got)


EDGE = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "a b c d e", None), (None, "a b c d e", "y"), (3, None, "x"), (4, "", "x"), (5, "  ", "x"), (6, "one", "x"), (7, "one", "x"), (8, "z " * 50000 + "end", "q"), (9, "alone in here now", None)]


def test_edges(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in EDGE], "doc_id long, text string, node string, content int, class_id int")
    got = sorted((tuple(r) for r in near_classes(df).collect()), key=repr)
    want = [(1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 1), (7, 6, 1), (8, 8, 0), (9, 9, 0), (None, 1, 3)]
    assert got == sorted(want, key=repr)
    assert near_classes(df.where("false")).count() == 0
    assert representative_pairs(df).count() == 0


def test_near_dedup_edges(spark):
    schema = "doc_id long, text string, content_hash string, root string"
    df = spark.createDataFrame([(*r, "e") for r in EDGE], schema)
    kept = near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect())) == [1, 3, 4, 5, 6, 8, 9]
    assert near_dedup(df.where("false")).count() == 0


def test_near_dedup_follows_groups(spark, documents):
    rows = documents.collect()
    root = {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in representative_pairs(documents).collect():
        a, b = sorted((find(r.doc_id_a), find(r.doc_id_b)))
        root[b] = a
    first = {}
    for r in rows:
        key = frozenset(next(iter(sets_of([(r.doc_id, r.text)]).values()), [{r.doc_id}])[0])
        a, b = sorted((find(first.setdefault(key, r.doc_id)), find(r.doc_id)))
        root[b] = a
    assert {r.doc_id for r in near_dedup(documents).select("doc_id").collect()} == {i for i in root if find(i) == i}
    assert near_dedup(documents).exceptAll(documents).count() == 0
    assert documents.select(F.lit(1)).count() > 0
