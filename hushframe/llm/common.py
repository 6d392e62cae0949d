"""What the operators share: shared-folder tables, word hashes, batching of Arrow input.

Every written table lies in the folder that ``spark.checkpoint.dir`` names, which all
executors share, so a lost executor never loses it. Only where the setting is absent (a
local test session) a folder under the system's temporary one is used.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.common import spread, table

__all__ = ["spread", "table"]

#: Words kept in a worker's memo before it is emptied; results don't depend on it.
MEMO_WORDS = 150_000
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the cluster's shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="hushframe-"))
    return f"{root.rstrip('/')}/hushframe-{app}"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile removes the files of its own shuffles as it ends; else they lie there until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*frames: DataFrame) -> None:
    """Removes the shared-folder tables behind frames of ``written``, which nothing reads any more: what came of them is written itself."""
    for df in frames:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/hushframe-" in name:
                remove(df.sparkSession, name)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that don't clash with the columns df has (compared without case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def struct_of(df: DataFrame, *drop: str) -> F.Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in drop])


class WordHashes(dict):
    """word -> 64-bit hash, memoised."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = h
        return h


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct white-space separated words of texts; for all words end to end their places in that list; the words of each text.

    Arrow splits at the same characters as Python does. A null text has no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    split = pc.utf8_split_whitespace(texts)
    counts = pc.list_value_length(split).fill_null(0).to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # at a text's ends
        words[blank] = "-"
        none = np.append(0, np.cumsum(at == blank))
        ends = np.cumsum(counts)
        counts = counts - none[ends] + none[ends - counts]
        at = at[at != blank]
    return words, at, counts


def word_hashes(texts: pa.Array | list[str | None], memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of all texts, end to end, and the words of each text."""
    words, at, counts = words_of(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string()))
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))[at], counts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that arithmetic structure of sums doesn't show in the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = np.cumprod(np.full(1 << max(16, int(n).bit_length()), np.uint64(base), np.uint64))
    return have[:n]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes (len(words) - n + 1 of them), by prefix sums modulo 2**64."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    k = len(words)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, k), dtype=np.uint64)])
    return mix((sums[n:] - sums[:-n]) * _powers(_INVERSE, k - n + 1))


def release() -> None:
    """Gives memory that earlier tasks of this worker freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def batches(items: Iterator[pa.RecordBatch], rows: int = 2000, nbytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches so small that work on them holds little memory."""
    release()
    for b in items:
        step = max(1, min(rows, int(b.num_rows * nbytes / max(1, b.nbytes))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def map_arrow(df: DataFrame, f: Callable, schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(f, schema)
