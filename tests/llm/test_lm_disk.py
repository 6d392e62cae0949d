"""What op5 puts on disk: each table and shuffle once, compressed, and none of it longer than it is needed."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import lm_score as lm
from hushframe.llm.common import batches

SMALL = "/root/testdata/sf0.001"


def shuffle_files(spark):
    """Names of shuffle files that lie in this application's local folders (local mode has one block manager)."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(found.size()) if (n := found.apply(k).getName()).startswith("shuffle_")}


def test_counts_leave_no_shuffle(spark):
    """The shuffle of the counts is gone once the shards are written, without a collection of the driver's garbage."""
    removed, merged = [], lm.merged

    def watched(*args):
        old = shuffle_files(spark)
        out = merged(*args)
        end = time.time() + 20
        while (left := shuffle_files(spark) - old) and time.time() < end:
            time.sleep(0.1)
        removed.append(not left)
        return out

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm, "merged", watched)
        lm.Trained(docs, "doc_id", "text", lm.PIECES, lm.KEEP)
    assert removed == [True]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_tokens_are_not_shuffled(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    trained = lm.Trained(df, "doc_id", "text", lm.PIECES, lm.KEEP)
    assert "binary" not in dict(trained.chunks.dtypes).values()
    shape = trained.shape_of()
    rows = trained.chunks.orderBy("chunk").collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in rows:
        want = shape.tokens([texts[i] for i, n in zip(r.ids, r.lens) if n is not None])[0]
        assert (lm.tokens_of(shape, r.file, r.start, r.size) == want).all()
    assert sum(len(r.ids) for r in rows) == len(texts)


@pytest.mark.parametrize("n", [0, 1, 5, 200, 100_000])
def test_blocks_are_compressed(n):
    rng = np.random.default_rng(n)
    keys, counts = lm.distinct(rng.zipf(1.3, n) % (1 << 45))
    counts = np.where(rng.random(len(counts)) < 0.01, 1 << 40, counts)
    assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all() and (lm.unpack_small(lm.pack_small(counts), len(counts)) == counts).all()
    steps = np.sort(rng.integers(0, (n << 12) + 1, n))
    assert n < 1000 or len(lm.pack_keys(steps)) < 3 * n


def test_chunk_of_nulls(spark):
    """A chunk of nulls alone has no tokens, and scores to nulls."""
    df = spark.createDataFrame([(i, None) for i in range(5)], "doc_id long, text string")
    assert lm.lm_scores(df).where(F.col("log_prob").isNull()).count() == 5


def test_groups_of_chunks_share_blocks(spark, monkeypatch):
    """Chunks that follow each other in a task send a shard one block for all of them, with each n-gram once."""
    monkeypatch.setattr(lm, "granularity", lambda chars: (4, 500))
    monkeypatch.setattr(lm, "batches", lambda items, rows, nbytes: batches(items, 1))  # a chunk ends at any document
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3, "doc_id")
    trained = lm.Trained(docs, "doc_id", "text", lm.PIECES, lm.KEEP)
    rows = trained.chunks.select("chunk", "group", "file", "start", "size", trained.task.alias("task")).collect()
    members = {}
    for r in rows:
        members.setdefault(r.group, []).append(r)
    assert len(members) == trained.parts < len(rows) / 2
    for of in members.values():
        seq = sorted(r.chunk for r in of)
        assert len(seq) <= lm.GROUP and seq == list(range(seq[0], seq[0] + len(seq))) and len({(r.file, r.task) for r in of}) == 1
    assert all(0 <= r.task < trained.parts for r in rows)
    shape = trained.shape_of()
    want = {g: len(np.unique(np.concatenate([shape.grams(lm.tokens_of(shape, r.file, r.start, r.size))[0] for r in of]))) for g, of in members.items()}
    got, total = {}, 0
    for r in lm.blocks(trained.chunks, trained.shape_of, trained.parts, trained.task).collect():
        keys = lm.unpack_keys(bytes(r["keys"]))
        if r.shard < 4:
            got[r.group] = got.get(r.group, 0) + len(keys)
            total += int(lm.unpack_small(bytes(r.counts), len(keys)).sum())
    assert got == want and total == sum(len(shape.grams(lm.tokens_of(shape, r.file, r.start, r.size))[0]) for r in rows)
    scores = {r.doc_id: r.log_prob for r in lm.lm_scores(docs).collect()}
    monkeypatch.undo()
    assert scores == pytest.approx({r.doc_id: r.log_prob for r in lm.lm_scores(docs).collect()}, rel=1e-9)


def test_long_chunks_stand_alone(spark, monkeypatch):
    """A group's tokens are bounded but for its last chunk, however long documents are."""
    monkeypatch.setattr(lm, "granularity", lambda chars: (4, 10))
    monkeypatch.setattr(lm, "batches", lambda items, rows, nbytes: batches(items, 1))
    df = spark.createDataFrame([(i, f"w{i} " * 500) for i in range(12)], "doc_id long, text string").coalesce(1)
    trained = lm.Trained(df, "doc_id", "text", lm.PIECES, lm.KEEP)
    assert trained.parts == trained.chunks.select("group").distinct().count() == 12
