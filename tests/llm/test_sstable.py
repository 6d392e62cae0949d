import mmap

import numpy as np
import pytest

from hushframe.llm.sstable import Reader, lookup, shards, token_ids, write_shards

SF = "/root/testdata/sf0.001"


def files(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.shard, r.seq)):
        out.setdefault(r.shard, bytearray()).extend(r.bytes)
    return {k: Reader(bytes(v)) for k, v in out.items()}


def test_query_round_trip(spark):
    import __spark_entry__ as e

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = files(e.queries()["op8_sstable"](spark, SF).collect())
    for r in docs:
        assert [x.text(r.doc_id) for x in found.values() if x.get(r.doc_id) is not None] == [r.text]
    assert sum(x.entries for x in found.values()) == len(docs)
    assert all(x.get(10**9 + k) is None for x in found.values() for k in range(100))


def test_bloom_filter_spares_most_searches(spark):
    df = spark.range(3000).selectExpr("id * 2 AS doc_id", "concat('text ', id) AS text")
    (x,) = files(shards(df).collect()).values()
    from hushframe.llm.sstable import key_of

    assert all(x.may_have(key_of(2 * k)) for k in range(3000))
    assert sum(x.may_have(key_of(2 * k + 1)) for k in range(3000)) < 100


def test_files_map_into_memory(spark, tmp_path):
    df = spark.range(5000).selectExpr("id * 7 - 9000 AS doc_id", "concat('text of ', id, ' ', repeat('w ', 30)) AS text")
    made = write_shards(shards(df, docs_per_shard=1000), str(tmp_path / "sst")).collect()
    assert len(made) >= 4
    got = {}
    for r in made:
        with open(r.file, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            x = Reader(data)
            got |= {k: x.text(k) for k in range(-9000, 26000, 7) if x.get(k) is not None}
    assert len(got) == 5000 and got[-9000].startswith("text of 0 ")


def test_edges(spark):
    rows = [(5, "b", "x"), (5, "a", "x"), (-3, None, "x"), (None, "lost", "x"), (0, "", "x"), (7, "long ▁ 漢 " * 30_000, "x"), (2**62, "z\t\n  z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    (x,) = files(shards(df).collect()).values()
    code = token_ids()
    assert sorted(code.decode(v) for v in x.get_all(5)) == ["a", "b"] and x.get_all(-3) == [None] and x.get(0) == b""
    assert x.text(7) == rows[5][1] and x.text(2**62) == "z\t\n  z" and x.entries == 6
    assert shards(df.where("false")).count() == 0
    names = spark.createDataFrame([("b/1", "t1"), ("a", "t2"), ("b/10", "t3"), (None, "t4")], "doc_id string, text string")
    (y,) = files(shards(names).collect()).values()
    assert [y.text(k) for k in ("a", "b/1", "b/10", "c")] == ["t2", "t1", "t3", None]
    assert np.dtype("<u2") == code.type


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "string"])
def test_lookups_of_any_key_type(spark, tmp_path, kind):
    df = spark.range(-60, 60).selectExpr(f"cast(id * 2 AS {kind}) AS `doc.id`", "concat('text ', id) AS text", "1 AS shard", "2 AS ids")
    df = df.union(df.where("`doc.id` = 10").selectExpr("`doc.id`", "cast(null AS string)", "1", "2")).toDF("doc_id", "text", "shard", "ids")
    found = shards(df, docs_per_shard=25)
    made = write_shards(found, str(tmp_path / kind))
    wanted = spark.range(-125, 126).selectExpr(f"cast(id AS {kind}) AS doc_id").where("doc_id is not null")
    assert found.select("shard").distinct().count() > 3
    got = sorted((str(r.doc_id), r.found, r.text or "") for r in lookup(found, made, wanted).collect())
    have = {str(r.doc_id): r.text for r in df.where("text is not null").collect()}
    want = [(str(r.doc_id), str(r.doc_id) in have, have.get(str(r.doc_id), "")) for r in wanted.distinct().collect()] + [("10", True, "")]
    assert got == sorted(want)


def test_other_keys_are_refused(spark):
    for kind in ("decimal(10,2)", "double", "date"):
        with pytest.raises(TypeError, match="integers or strings"):
            shards(spark.createDataFrame([], f"doc_id {kind}, text string"))
