"""Runs a registered query and its SQL over the same tables and compares their rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, sf_dir=DATA):
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    cur = duck(sf_dir).execute(e.oracle_sql()[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]), [x for x in got[1] if x not in want[1]][:3], [x for x in want[1] if x not in got[1]][:3])
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    return len(got[1])
