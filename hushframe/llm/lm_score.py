"""Operator 5: LM scoring with a trigram model in Elias-Fano tries.

Tokens are the pieces of ``sstable`` (words cut into longest pieces), with begin and end marks.
The model interpolates by Witten and Bell: with c a context's occurrences and T its different
successors, ``P(w | h) = count(h w) / (c + T) + rest * P(w | shorter h)``. All documents and all
n-grams count. With ``keep`` above 1 trigrams seen less often are counted in c and T and then left
out; ``rest`` is what the kept ones leave, so each context still sums to one.

1. *Chunks.* One pass tokenises the documents into chunks of about ``CHUNK`` tokens (more for very
   large corpora, see ``granularity``), which are written; everything later reads ids and no text.
   A task's tokens are a file of compressed chunks, and the written rows say where a chunk stands in it, so
   tokens are never shuffled.
2. *Counts.* A task's chunks form groups of up to ``GROUP``, of fewer if they are very long. Each group sorts its n-grams and sends every
   shard one block of distinct keys and counts, so blocks are long though a chunk is small. A
   shard merges its blocks; it remembers which of its keys each group has. A context
   (u, v) and its successors lie in one shard. This shuffle's files are removed once the shards are written. A word's contexts and bigrams are dealt over
   ``Shape.split`` parts, more with more shards, so a frequent word makes no hot shard; what
   one context can hold is bounded by the vocabulary.
3. *Level 2* of a shard is its bigrams (v, w) as one ascending Elias-Fano sequence, with codes of
   8 bits for the smoothed probability.
4. *Level 3* of a shard: its contexts, ordered by (v, u), with a code for what each leaves
   to shorter ones and a monotone pointer to the place of its list. A successor's number is its
   rank among the shard's successors of v (context-relative), made ascending over the level by
   adding the end of the list before it. All four are Elias-Fano sequences.
5. *Queries.* A shard's levels are mapped into memory and each of its distinct n-grams is looked up
   once, by successor search in the contexts, in v's successors and in the list. Codes go back to
   the groups that hold the n-gram (1 to 2 bytes each), and a group sums its documents' logarithms.
   So a task holds one shard or one group at a time, never the model.

Shards are files in the cluster's shared folder, mapped into memory if it is a file path and
read otherwise. Keys, counts, places and codes are compressed block by block. Only one row a vocabulary entry comes to the driver (unigrams). Chunk numbers are
made by the job that writes them, so a task that is repeated sends the same blocks; each attempt at
that job's tasks has a file of its own, and the rows that are kept name theirs.

Edges: a null text has null scores; an empty text has only its end mark to score; a very long
text is one chunk whole; null ids, tied ids and repeated rows are scored row by row, and count
row by row; an empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, fresh_path, mix, release, shuffles_removed, written
from .elias_fano import EliasFano, build, bundle, unbundle
from .sstable import token_ids
from .vocab import PIECES
from .warc import open_fs

BEGIN, END = 1, 2
KEEP = 1
#: Characters of text a shard and tokens a chunk, at least; results don't depend on either.
SHARD_CHARS = 4 << 20
CHUNK = 1 << 19
#: N-grams that a chunk has for a shard, about and at least (a group has several times as many): both grow with the square root of the input beyond.
BLOCK_GRAMS = 20
#: Chunks of a group at most; fewer, if that makes fewer groups than cores.
GROUP = 8
#: Bytes from which a block is compressed by itself; shorter ones are left to the shuffle's own compression.
PRESSED = 1 << 10
_ZSTD = pa.Codec("zstd", 1)
#: Most partitions of the counting shuffle; beyond, a task takes several shards one after another.
MAX_PARTITIONS = 20_000
STEP = 0.08  # of the codes, in natural logarithms
NONE = 255  # the code of probability 0


class Shape:
    """How keys are packed for a vocabulary, and where they go."""

    def __init__(self, vocab: str, shards: int) -> None:
        self.codec = token_ids(vocab)
        self.size = self.codec.pieces.size
        self.bits = (self.size - 1).bit_length()
        if 3 * self.bits > 62:
            raise ValueError("the vocabulary is too large for packed trigrams")
        self.shards, self.mask = shards, (1 << self.bits) - 1
        self.split = min(self.size, max(16, shards // 8))

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Begin, begin, ids, end, end of each text, and the lengths."""
        ids, lens = self.codec.encode_many(texts)
        full = lens + 4
        out = np.full(int(full.sum()), END, self.codec.type)
        first = np.cumsum(full) - full
        out[first], out[first + 1] = BEGIN, BEGIN
        out[np.arange(len(ids)) + np.repeat(first + 2 - (np.cumsum(lens) - lens), lens)] = ids
        return out, full

    def _part(self, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (mix((v * self.split + x % self.split).astype(np.uint64) + np.uint64(1)) % np.uint64(self.shards)).astype(np.int64)

    def trigram(self, u, v, w) -> np.ndarray:
        return v << 2 * self.bits | u << self.bits | w

    def shard3(self, key: np.ndarray) -> np.ndarray:
        return self._part(key >> 2 * self.bits, key >> self.bits & self.mask)

    def shard2(self, key: np.ndarray) -> np.ndarray:
        """Shards of bigrams are numbered after those of trigrams."""
        return self.shards + self._part(key >> self.bits, key & self.mask)

    def grams(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk's tokens: trigram keys, the places of their last tokens, bigram keys."""
        x = x.astype(np.int64)
        at = np.flatnonzero((x[:-2] != END) & (x[1:-1] != END)) + 2
        pairs = (x[:-1] << self.bits | x[1:])[x[:-1] != END]
        return self.trigram(x[at - 2], x[at - 1], x[at]), at, pairs


def codes(p: np.ndarray) -> np.ndarray:
    return np.minimum(NONE - 1, np.rint(-np.log(np.maximum(p, 1e-12)) / STEP)).astype(np.uint8)


CODEBOOK = np.exp(-STEP * np.arange(256))
CODEBOOK[NONE] = 0


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def press(raw: bytes) -> bytes:
    """raw, compressed if it is long; its length stands before it (0: as it is)."""
    if len(raw) < PRESSED:
        return bytes(8) + raw
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpress(raw: bytes) -> bytes:
    n = int.from_bytes(raw[:8], "little")
    return _ZSTD.decompress(memoryview(raw)[8:], n, asbytes=True) if n else raw[8:]


def united(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct keys of all of parts, which are sorted."""
    return parts[0] if len(parts) == 1 else distinct(np.concatenate(parts))[0]


def pack_small(x: np.ndarray) -> bytes:
    """Numbers that are mostly small, a byte each; larger ones follow in full."""
    big = x >= 255
    return press(np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype("<i8").tobytes())


def unpack_small(raw: bytes, n: int) -> np.ndarray:
    raw = unpress(raw)
    x = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    if len(raw) > n:
        x[x == 255] = np.frombuffer(raw, "<i8", offset=n)
    return x


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: their number, then the steps between them, bytes of equal weight together."""
    steps = np.diff(keys, prepend=0).astype("<u8")
    return press(len(keys).to_bytes(8, "little") + steps.view(np.uint16).reshape(-1, 4).T.tobytes())


def unpack_keys(raw: bytes) -> np.ndarray:
    raw = unpress(raw)
    n = int.from_bytes(raw[:8], "little")
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint16, 4 * n, 8).reshape(4, n).T).view("<u8").ravel().astype(np.int64))


def _by(shard: np.ndarray):
    """(value, places) of each value, in ascending order; places keep their order."""
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)] if len(s) else []
    for i, j in zip(cuts, cuts[1:]):
        yield int(s[i]), order[i:j]


def granularity(chars: int) -> tuple[int, int]:
    """(shards, tokens a chunk) for so many characters.

    With n tokens there were n / chunk times n / shard blocks of chunk * shard / n n-grams, if groups were chunks; that stays at ``BLOCK_GRAMS`` or more,
    so the number of blocks is in proportion to the input at any size.
    """
    side = math.isqrt(BLOCK_GRAMS * (chars // 2))  # some two characters a token
    return max(4, -(-chars // max(SHARD_CHARS, 2 * side))), max(CHUNK, side)


def chunks(rows: DataFrame, shape_of, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """(chunk, nth, ids, lens, file, start, size) of rows (id, text); lens holds a null for a null text. Written, with its tokens in files.

    nth is the chunk's group of those of its task: ``group`` chunks, or fewer with twice the tokens that so many should have.
    """
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("lens", T.ArrayType(T.IntegerType())), T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("size", T.LongType())])
    folder = fresh_path(rows.sparkSession, "lm-tokens")

    def run(items):
        task = TaskContext.get()
        shape, seq = shape_of(), task.partitionId() << 33
        ids, lens, parts, size, at = [], [], [], 0, 0
        nth, members, together = 0, 0, 0
        file, out = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", None

        def row():
            nonlocal out, at, nth, members, together
            if members == group or together >= 2 * group * chunk:
                nth, members, together = nth + 1, 0, 0
            members, together = members + 1, together + size
            if out is None:
                fs, base = open_fs(folder)
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{file.rsplit('/', 1)[1]}")
            data = press(b"".join(parts))
            out.write(data)
            at += len(data)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([nth], pa.int64()), one(pa.concat_arrays(ids)), one(pa.concat_arrays(lens)), pa.array([file]), pa.array([at - len(data)], pa.int64()), pa.array([len(data)], pa.int64())], ["chunk", "nth", "ids", "lens", "file", "start", "size"])

        for b in batches(items, 4000, 1 << 20):
            texts = b.column(1)
            some = texts.is_valid().to_numpy(zero_copy_only=False)
            x, n = shape.tokens(texts.drop_null().to_pylist())
            length = np.zeros(len(some), np.int32)
            length[some] = n
            ids.append(b.column(0)), lens.append(pa.array(length, pa.int32(), mask=~some)), parts.append(x.tobytes())
            size += len(x)
            if size >= chunk or sum(map(len, ids)) >= chunk:
                yield row()
                ids, lens, parts, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield row()
        if out:
            out.close()
        shape.codec.memo.clear()  # the worker's later tasks read ids and no words

    return written(rows.select("id", "text").mapInArrow(run, schema), "lm-chunks")


def tokens_of(shape: Shape, file: str, start: int, size: int) -> np.ndarray:
    """A chunk's tokens, of its task's file."""
    fs, path = open_fs(file)
    with fs.open_input_file(path) as f:
        return np.frombuffer(unpress(f.read_at(size, start)), shape.codec.type)


def grouped(table: DataFrame) -> tuple[DataFrame, int, F.Column]:
    """Chunks with their ``group``, a number that chunks of one task have that follow each other; the number of groups; the task of a group."""
    maker = F.shiftright("chunk", 33)
    last = [r[1] for r in table.groupBy(maker).agg(F.max("nth")).collect()]  # a row a task that made chunks
    parts = max(1, sum(n + 1 for n in last))
    return table.withColumn("group", maker * (max(last, default=0) + 1) + F.col("nth")), parts, F.pmod("group", F.lit(parts)).cast("int")


def blocks(table: DataFrame, shape_of, parts: int, task: F.Column) -> DataFrame:
    """(shard, group, keys, counts): what each group of chunks has for each shard."""
    schema = pa.schema([("shard", pa.int32()), ("group", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(items):
        shape = shape_of()
        for group, rows in _groups(items, 0):
            threes, twos = [], []
            for _, _, *where in rows:
                three, _, two = shape.grams(tokens_of(shape, *where))
                threes.append(distinct(three)), twos.append(distinct(two))
            for held, shard in ((threes, shape.shard3), (twos, shape.shard2)):
                keys = united([k for k, _ in held])
                n = np.zeros(len(keys), np.int64)
                for k, c in held:
                    n[np.searchsorted(keys, k)] += c
                held.clear()
                out = [(s, group, pack_keys(keys[i]), pack_small(n[i])) for s, i in _by(shard(keys))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    placed = table.select("group", "chunk", "file", "start", "size").repartitionById(parts, task).sortWithinPartitions("group", "chunk")
    return placed.mapInArrow(run, "shard int, group long, keys binary, counts binary")


def _groups(items, of: int):
    """(value, rows) of rows that come sorted by their column ``of``."""
    release()
    at, rows = None, []
    for b in items:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[of] != at:
                if rows:
                    yield at, rows
                at, rows = row[of], []
            rows.append(row)
    if rows:
        yield at, rows


def merged(found: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, counts, groups, places): a shard's distinct keys, and which of them each group has. Written."""
    schema = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("groups", pa.list_(pa.int64())), ("places", pa.list_(pa.binary()))])

    def run(items):
        for shard, rows in _groups(items, 0):
            held = [unpack_keys(r[2]) for r in rows]
            keys = distinct(np.concatenate(held))[0]
            n, places = np.zeros(len(keys), np.int64), []
            for r, k in zip(rows, held):
                at = np.searchsorted(keys, k)
                n[at] += unpack_small(r[3], len(k))
                places.append(len(k).to_bytes(8, "little") + pack_small(np.diff(at, prepend=-1)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([shard], [pack_keys(keys)], [pack_small(n)], [[r[1] for r in rows]], [places]), schema)], schema=schema)

    parts = min(shards, MAX_PARTITIONS)  # a task takes its shards one after another
    placed = found.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "group")
    with shuffles_removed(found.sparkSession):
        return written(placed.mapInArrow(run, "shard int, keys binary, counts binary, groups array<long>, places array<binary>"), "lm-shards")


def _put(folder: str, name: str, data: bytes) -> None:
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    temp = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(temp) as out:
        out.write(data)
    fs.move(temp, f"{base}/{name}")


def _open(folder: str, name: str) -> dict | None:
    """A level: its sequences, mapped into memory where the folder allows it; None if no shard of that name was written."""
    from pyarrow import fs as pafs

    fs, base = open_fs(folder)
    path = f"{base}/{name}"
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            raw = np.memmap(path, np.uint8, "r")
        except FileNotFoundError:
            return None
    else:
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with fs.open_input_stream(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    return {k: v if k in ("taken", "rest") else EliasFano(v) for k, v in unbundle(raw).items()}


def level_two(shape: Shape, key: np.ndarray, n: np.ndarray, whole: np.ndarray) -> bytes:
    return bundle({"ids": build(key, 1 << 2 * shape.bits), "taken": codes(n / whole[key >> shape.bits]).tobytes()})


def level_three(shape: Shape, key: np.ndarray, n: np.ndarray, keep: int) -> bytes:
    bits, context = shape.bits, key >> shape.bits
    new = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    t = np.diff(np.append(new, len(key)))
    whole = np.repeat(np.add.reduceat(n, new) + t, t)
    good = n >= keep
    kept = np.add.reduceat(np.where(good, n / whole, 0.0), new)
    of = np.repeat(np.arange(len(new)), t)[good]
    follow = (key >> 2 * bits << bits | key & shape.mask)[good]
    after = distinct(follow)[0]
    rank = np.searchsorted(after, follow) - np.searchsorted(after, follow & ~shape.mask)
    last = np.append(of[1:] != of[:-1], True)[: len(of)]
    ends = np.cumsum(np.where(last, rank + 1, 0))  # each list begins where the one before ends
    x = np.append(0, ends[:-1])[: len(of)] + rank
    top = int(ends[-1]) + 1 if len(of) else 1
    return bundle({
        "contexts": build(context[new], 1 << 2 * bits), "after": build(after, 1 << 2 * bits), "pointers": build(np.searchsorted(of, np.arange(len(new) + 1)), len(x) + 1),
        "ids": build(x, top), "taken": codes(n[good] / whole[good]).tobytes(), "rest": codes(1 - kept).tobytes(),
    })


def ask_two(level: dict, key: np.ndarray) -> np.ndarray:
    """Codes of bigrams, NONE where there is none."""
    at, same = level["ids"].successor(key)
    out = np.full(len(key), NONE, np.uint8)
    out[same] = level["taken"][at[same]]
    return out


def ask_three(shape: Shape, level: dict, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of trigrams (NONE if it isn't kept) and of what their contexts leave (0, all of it, for an unseen one)."""
    bits = shape.bits
    taken, rest = np.full(len(key), NONE, np.uint8), np.zeros(len(key), np.uint8)
    context, where = np.unique(key >> bits, return_inverse=True)
    at, same = level["contexts"].successor(context)
    at, same = at[where], same[where]
    rest[same] = level["rest"][at[same]]
    v, w = key >> 2 * bits, key & shape.mask
    pair, where = np.unique(v << bits | w, return_inverse=True)
    place, known = level["after"].successor(pair)
    first, back = np.unique(pair >> bits, return_inverse=True)
    rank = (place - level["after"].successor(first << bits)[0][back])[where]
    i = np.flatnonzero(same & known[where])
    if not len(i):
        return taken, rest
    begin, end = level["pointers"].access(at[i]), level["pointers"].access(at[i] + 1)
    some = end > begin
    i, begin, end = i[some], begin[some], end[some]
    x = np.where(begin > 0, level["ids"].access(np.maximum(begin - 1, 0)) + 1, 0) + rank[i]
    ok = x <= level["ids"].access(end - 1)
    i, x = i[ok], x[ok]
    p, same = level["ids"].successor(x)
    taken[i[same]] = level["taken"][p[same]]
    return taken, rest


class Model:
    """Lookups of any n-grams in the shards of a folder, one shard at a time."""

    def __init__(self, folder: str, shape: Shape, first: np.ndarray, rest: np.ndarray) -> None:
        self.folder, self.shape, self.first, self.rest = folder, shape, first, rest

    def combined(self, key: np.ndarray, taken: np.ndarray, rest: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Logarithms of trigrams' probabilities from the codes of the levels; low: of the bigrams."""
        v, w = key >> 2 * self.shape.bits, key & self.shape.mask
        return np.log(CODEBOOK[taken] + CODEBOOK[rest] * (CODEBOOK[low] + self.rest[v] * self.first[w]))

    def log_probs(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(w | u v)."""
        shape = self.shape
        key, pair = shape.trigram(u, v, w), v << shape.bits | w
        taken, rest, low = np.full(len(key), NONE, np.uint8), np.zeros(len(key), np.uint8), np.full(len(key), NONE, np.uint8)
        for s, i in _by(shape.shard3(key)):
            if level := _open(self.folder, f"three-{s:06d}"):
                taken[i], rest[i] = ask_three(shape, level, key[i])
        for s, i in _by(shape.shard2(pair)):
            if level := _open(self.folder, f"two-{s - shape.shards:06d}"):
                low[i] = ask_two(level, pair[i])
        return self.combined(key, taken, rest, low)


class Trained:
    """The counts of a corpus: chunks and shards as written tables, unigrams, and a folder for the levels."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, vocab: str, keep: int) -> None:
        spark: SparkSession = docs.sparkSession
        text = F.col(f"`{text_col}`").cast("string")
        chars = int(docs.agg(F.sum(F.length(text))).first()[0] or 0)
        shards, chunk = granularity(chars)
        group = max(1, min(GROUP, chars // (4 * chunk) // spark.sparkContext.defaultParallelism))

        def shape_of() -> Shape:
            return Shape(vocab, shards)

        self.shards, self.shape_of, self.keep, self.folder = shards, shape_of, keep, fresh_path(spark, "lm")
        shape = shape_of()
        bits, mask = shape.bits, shape.mask
        self.chunks = chunks(docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")), shape_of, chunk, group)
        self.chunks, self.parts, self.task = grouped(self.chunks)
        self.table = merged(blocks(self.chunks, shape_of, self.parts, self.task), shards)

        def unigrams(items):
            for b in items:
                for raw, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    key = unpack_keys(raw)
                    n = unpack_small(n, len(key))
                    v, t = distinct(key >> bits)
                    c = np.bincount(np.searchsorted(v, key >> bits), n, len(v)).astype(np.int64)
                    w = distinct(key & mask)[0]
                    m = np.bincount(np.searchsorted(w, key & mask), n, len(w)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([True, False], [len(v), len(w)])), pa.array(np.append(v, w)), pa.array(np.append(c, m)), pa.array(np.append(t, np.zeros(len(w), np.int64)))], ["before", "id", "c", "t"])

        sums = self.table.where(F.col("shard") >= shards).select("keys", "counts").mapInArrow(unigrams, "before boolean, id long, c long, t long")
        count, self.rest, self.whole = np.zeros(shape.size), np.ones(shape.size), np.ones(shape.size)
        for r in sums.groupBy("before", "id").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect():  # two rows a vocabulary entry at most
            if r["before"]:
                self.rest[r["id"]], self.whole[r["id"]] = r["t"] / (r["c"] + r["t"]), r["c"] + r["t"]
            else:
                count[r["id"]] = r["c"]
        count[BEGIN] = 0
        seen = max(1, int((count > 0).sum()))
        self.first = (count + seen / shape.size) / (count.sum() + seen)

    def answers(self) -> DataFrame:
        """(group, shard, codes): each shard's levels are written, and asked for all keys of each group."""
        shape_of, shards, folder, keep, whole = self.shape_of, self.shards, self.folder, self.keep, self.whole
        schema = pa.schema([("group", pa.int64()), ("shard", pa.int32()), ("codes", pa.binary())])

        def run(items):
            shape = shape_of()
            release()
            for b in items:
                for shard, raw, counts, at, places in zip(*(c.to_pylist() for c in b.columns)):
                    key = unpack_keys(raw)
                    n = unpack_small(counts, len(key))
                    if shard < shards:
                        _put(folder, name := f"three-{shard:06d}", level_three(shape, key, n, keep))
                        found = np.stack(ask_three(shape, _open(folder, name), key))
                    else:
                        _put(folder, name := f"two-{shard - shards:06d}", level_two(shape, key, n, whole))
                        found = ask_two(_open(folder, name), key)[None]
                    out = []
                    for p in places:
                        m = int.from_bytes(p[:8], "little")
                        out.append(press(found[:, np.cumsum(unpack_small(p[8:], m)) - 1].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([shard] * len(at), pa.int32()), pa.array(out, pa.binary())], schema=schema)

        return self.table.select("shard", "keys", "counts", "groups", "places").mapInArrow(run, "group long, shard int, codes binary")

    def model_of(self):
        """A function to the model for tasks or the driver, once ``answers`` has run."""
        folder, shape_of, first, rest = self.folder, self.shape_of, self.first, self.rest
        return lambda: Model(folder, shape_of(), first, rest)


def train(docs: DataFrame, text_col: str = "text", vocab: str = PIECES, keep: int = KEEP):
    """Counts all documents, writes the shards, and gives a function to the model for tasks."""
    trained = Trained(docs, text_col, text_col, vocab, keep)
    trained.answers().agg(F.count("codes")).collect()
    return trained.model_of()


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = PIECES, keep: int = KEEP) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row under the model of all rows; the end mark counts as a token."""
    trained = Trained(docs, id_col, text_col, vocab, keep)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perplexity", T.DoubleType())])
    model_of = trained.model_of()
    none = F.lit(None)
    own = ("chunk", "ids", "lens", "file", "start", "size")
    held = trained.chunks.select("group", F.lit(-1).alias("shard"), none.cast("binary").alias("codes"), *own)
    codes_ = trained.answers().select("group", "shard", "codes", *[none.cast(trained.chunks.schema[c].dataType).alias(c) for c in own])
    rows = held.unionByName(codes_).repartitionById(trained.parts, trained.task).sortWithinPartitions("group", "shard", "chunk")

    def looked_up(model: Model, threes: list[np.ndarray], twos: list[np.ndarray], found: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A group's distinct trigrams and the logarithms of their probabilities; threes and twos: those of its chunks."""
        shape, key, two = model.shape, united(threes), united(twos)
        taken, rest, low = np.empty(len(key), np.uint8), np.empty(len(key), np.uint8), np.empty(len(two), np.uint8)
        for s, i in _by(shape.shard3(key)):
            taken[i], rest[i] = np.frombuffer(unpress(found[s]), np.uint8).reshape(2, -1)
        for s, i in _by(shape.shard2(two)):
            low[i] = np.frombuffer(unpress(found[s]), np.uint8)
        pair = key >> 2 * shape.bits << shape.bits | key & shape.mask
        return key, model.combined(key, taken, rest, low[np.searchsorted(two, pair)])

    def scored(model: Model, chunks_: list[tuple], found: dict[int, bytes]):
        shape, threes, twos, places = model.shape, [], [], []
        for _, _, *where in chunks_:
            key, at, two = shape.grams(tokens_of(shape, *where))
            order = np.argsort(key)
            s = key[order]
            new = np.append(True, s[1:] != s[:-1])[: len(s)]
            back = np.empty(len(key), np.int32)
            back[order] = np.cumsum(new) - 1
            threes.append(s[new]), twos.append(distinct(two)[0]), places.append((at.astype(np.int32), back))
        keys, logs = looked_up(model, threes, twos, found)
        for (ids, lens, *_), three, (at, back) in zip(chunks_, threes, places):
            null = lens.is_null().to_numpy(zero_copy_only=False)
            n = lens.fill_null(0).to_numpy().astype(np.int64)
            total = np.zeros(len(n))
            if len(three):
                lp = np.zeros(int(n.sum()))
                lp[at] = logs[np.searchsorted(keys, three)][back]
                total[~null] = np.add.reduceat(lp, (np.cumsum(n) - n)[~null])
            n = n - 3
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64(), mask=null), pa.array(total, pa.float64(), mask=null), pa.array(np.exp(-total / np.maximum(n, 1)), pa.float64(), mask=null)], ["doc_id", "n_tokens", "log_prob", "perplexity"])

    def run(items):
        release()
        model, at, chunks_, found = model_of(), None, [], {}
        for b in items:
            codes = b.column(2)
            for k, (group, s) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if group != at:
                    if chunks_:
                        yield from scored(model, chunks_, found)
                    at, chunks_, found = group, [], {}
                if s < 0:
                    chunks_.append((b.column(4)[k].values, b.column(5)[k].values, *(b.column(c)[k].as_py() for c in (6, 7, 8))))
                else:
                    found[s] = codes[k].as_py()
        if chunks_:
            yield from scored(model, chunks_, found)

    return rows.select("group", "shard", "codes", *own).mapInArrow(run, schema)
