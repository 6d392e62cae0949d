"""Operator 8: sorted-string-table shards of token ids, keyed by document identifier.

A shard holds the documents of one range of identifiers in order:

* data blocks of about ``BLOCK`` bytes; an entry is (shared prefix length, rest of the key,
  value) in varints, and every 16th entry restarts with its whole key, so a block is binary
  searched over its restarts;
* a sparse index: last key, offset and length of each block, searched by bisection;
* a Bloom filter over the keys (10 bits a key, 7 probes);
* a footer with the places of index and filter, the number of entries, and a magic.

A key is the identifier in an encoding that sorts like it (integers of any width: 8 bytes,
big-endian, sign flipped; strings: UTF-8); other types are refused with a clear error. A value is
the text's token ids as little-endian uint16 (uint32 for vocabularies over 65,536): words led by
U+2581, split into the greedily longest pieces; ids decode to the text exactly.

``shards`` returns a shard as rows of segments (shard, seq, kind, bytes): their bytes in the
order of seq are the file. That is pure, so a lost task is simply repeated; ``write_shards``
puts the files into a folder, each by rename of a name of the task attempt's own; ``lookup`` finds
identifiers in them.

Shard bounds come from a range partitioning of the identifiers' column alone, one bound a shard,
so a range has about ``docs_per_shard`` documents; one shuffle brings each shard's encoded rows
to the partition of its number, ids at 2 bytes a token instead of text.

Edges: rows with a null id can't be keyed and are left out; a null text is kept as a null
value, an empty one as no tokens, a very long one as one value; repeated ids are all kept in one
shard, in order of their values, and ``get`` returns the first, ``get_all`` each. An empty table
gives no shards. Extra columns are not stored.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, written
from .vocab import PIECES, SPACE, loaded, settled
from .warc import open_fs

BLOCK = 32 << 10
RESTART = 16
PROBES, BITS = 7, 10
MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQQQ8s")
MEMO_WORDS = 300_000
#: Most partitions of the shuffle; beyond, a task makes several neighbouring shards one after another.
MAX_PARTITIONS = 20_000
SEGMENT = "shard int, seq long, kind string, first_doc_id {id}, entries long, bytes binary"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[i]
        n, i, shift = n | (c & 127) << shift, i + 1, shift + 7
        if c < 128:
            return n, i


def key_of(identifier) -> bytes:
    if isinstance(identifier, str):
        return identifier.encode("utf-8", "surrogatepass")
    return struct.pack(">Q", (int(identifier) + (1 << 63)) & ((1 << 64) - 1))


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class TokenIds:
    """Texts to token ids as bytes and back."""

    def __init__(self, path: str = PIECES) -> None:
        self.pieces, self.auto = loaded(path)
        self.type = np.dtype("<u2" if self.pieces.size <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.one = [np.array([i], self.type).tobytes() for i in range(self.pieces.size)]
        self.popped = [b"".join([self.one[i] for i in ids]) for ids in self.auto.popped_ids]
        self.begin = self.auto.child[0][SPACE]
        self.raw = [b""] * self.pieces.size
        for t, i in self.pieces.normal.items():
            self.raw[i] = t.replace(SPACE, " ").encode()
        for b, i in self.pieces.bytes.items():
            self.raw[i] = bytes([b])

    def word(self, w: str) -> bytes:
        """Ids of a blank and a word: the automaton's walk, with the popped ids as ready bytes."""
        if SPACE in w:  # a literal U+2581 goes as bytes, not as a blank
            ids = []
            for k, part in enumerate(w.split(SPACE)):
                ids += self.auto.ids(SPACE + part) if not k else [self.pieces.bytes[x] for x in SPACE.encode()] + self.auto.ids(part)
            out = np.array(ids, self.type).tobytes()
        else:
            child, fail, popped, v, parts = self.auto.child, self.auto.fail, self.popped, self.begin, []
            for ch in w:
                u = child[v].get(ch)
                while u is None and v:
                    parts.append(popped[v])
                    v = fail[v]
                    u = child[v].get(ch)
                if u is None:
                    parts.append(b"".join([self.one[x] for x in self.auto._fallback(ch)]))
                else:
                    v = u
            while v:
                parts.append(popped[v])
                v = fail[v]
            out = b"".join(parts)
        if len(w) <= 64:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[w] = out
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        memo, word = self.memo, self.word
        words = text.split(" ")
        parts = list(map(memo.get, words))
        if None in parts:
            parts = [p if p is not None else word(w) for p, w in zip(parts, words)]
        return b"".join(parts)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the number of each; a word that comes again is looked up once."""
        lens = np.zeros(len(texts), np.int64)
        some = [k for k, t in enumerate(texts) if t]
        if not some:
            return np.zeros(0, self.type), lens
        try:
            split = pc.split_pattern(pa.array([texts[k] for k in some], pa.large_string()), " ")
        except UnicodeEncodeError:  # lone surrogates
            parts = [self.encode(texts[k]) for k in some]
            lens[some] = [len(p) // self.type.itemsize for p in parts]
            return np.frombuffer(b"".join(parts), self.type), lens
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        parts = list(map(self.memo.get, words))
        if None in parts:
            parts = [p if p is not None else self.word(w) for p, w in zip(parts, words)]
        ids, size = np.frombuffer(b"".join(parts), self.type), np.fromiter(map(len, parts), np.int64, len(parts)) // self.type.itemsize
        at = coded.indices.to_numpy()
        count = size[at]
        out = np.cumsum(count)
        lens[some] = np.diff(np.append(0, out)[split.offsets.to_numpy()])
        return ids[np.arange(out[-1]) + np.repeat((np.cumsum(size) - size)[at] - out + count, count)], lens

    def decode(self, value: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(value, self.type).tolist()))[1:].decode("utf-8", "surrogatepass")


_IDS: dict[str, TokenIds] = {}


def token_ids(path: str = PIECES) -> TokenIds:
    if path not in _IDS:
        _IDS[path] = TokenIds(path)
        settled()
    return _IDS[path]


class Builder:
    """Segments of a shard from its entries in key order."""

    def __init__(self) -> None:
        self.offset, self.entries, self.index, self.hashes = 0, 0, [], []
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.n, self.last, self.first = bytearray(), [], 0, b"", None

    def add(self, key: bytes, value: bytes | None, doc_id) -> Iterator[tuple]:
        shared = 0
        if self.n % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        body = value or b""
        self.block += varint(shared) + varint(len(key) - shared) + varint(0 if value is None else len(body) + 1) + key[shared:] + body
        if self.first is None:
            self.first = doc_id
        self.last, self.n, self.entries = key, self.n + 1, self.entries + 1
        self.hashes.append(key)
        if len(self.block) >= BLOCK:
            yield self._cut()

    def _cut(self) -> tuple:
        data = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        out = ("data", self.first, self.n, data)
        self.index.append((self.last, self.offset, len(data)))
        self.offset += len(data)
        self._fresh()
        return out

    def finish(self) -> Iterator[tuple]:
        if self.n:
            yield self._cut()
        bits = max(64, len(self.hashes) * BITS)
        field = np.zeros((bits + 7) // 8, np.uint8)
        at = np.array([p for k in self.hashes for p in probes(k, bits)], np.int64)
        np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
        bloom = struct.pack("<Q", bits) + field.tobytes()
        yield "filter", None, self.entries, bloom
        index = struct.pack("<I", len(self.index)) + b"".join(varint(len(k)) + k + varint(o) + varint(n) for k, o, n in self.index)
        yield "index", None, len(self.index), index
        at = self.offset
        yield "footer", None, self.entries, FOOTER.pack(at + len(bloom), len(index), at, len(bloom), self.entries, MAGIC)


class Reader:
    """Lookups in a shard's bytes (anything that slices, such as a memory map)."""

    def __init__(self, data, vocab: str = PIECES) -> None:
        self.data, self.codec = data, token_ids(vocab)
        io, il, fo, fl, self.entries, magic = FOOTER.unpack(bytes(data[len(data) - FOOTER.size :]))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.bits = struct.unpack("<Q", bytes(data[fo : fo + 8]))[0]
        self.filter = bytes(data[fo + 8 : fo + fl])
        raw, i = bytes(data[io : io + il]), 4
        self.last, self.where = [], []
        for _ in range(struct.unpack("<I", raw[:4])[0]):
            n, i = read_varint(raw, i)
            self.last.append(raw[i : i + n])
            o, i = read_varint(raw, i + n)
            n, i = read_varint(raw, i)
            self.where.append((o, n))

    def may_have(self, key: bytes) -> bool:
        return all(self.filter[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits))

    @staticmethod
    def _entry(b: bytes, i: int, last: bytes) -> tuple[bytes, bytes | None, int]:
        shared, i = read_varint(b, i)
        rest, i = read_varint(b, i)
        size, i = read_varint(b, i)
        key = last[:shared] + b[i : i + rest]
        i += rest
        return (key, None, i) if not size else (key, b[i : i + size - 1], i + size - 1)

    def _values(self, identifier) -> Iterator[bytes | None]:
        key = key_of(identifier)
        if not self.may_have(key):
            return
        for k in range(bisect_left(self.last, key), len(self.last)):
            o, n = self.where[k]
            b = bytes(self.data[o : o + n])
            count = struct.unpack("<I", b[-4:])[0]
            restarts = struct.unpack(f"<{count}I", b[-4 - 4 * count : -4])
            lo, hi = 0, count - 1  # the last restart whose key is less
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if self._entry(b, restarts[mid], b"")[0] < key:
                    lo = mid
                else:
                    hi = mid - 1
            i, last, end = restarts[lo], b"", n - 4 - 4 * count
            while i < end:
                last, value, i = self._entry(b, i, last)
                if last == key:
                    yield value
                elif last > key:
                    return

    def get(self, identifier) -> bytes | None:
        return next(self._values(identifier), None)

    def get_all(self, identifier) -> list[bytes | None]:
        return list(self._values(identifier))

    def text(self, identifier) -> str | None:
        value = self.get(identifier)
        return None if value is None else self.codec.decode(value)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = PIECES, cuts: list | None = None) -> DataFrame:
    """(doc_id, ids, shard): token ids of each keyed document, and its range of identifiers.

    Rows equal to a cut go to the range below it, so a repeated id stays in one shard.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("shard", T.IntegerType())])
    cuts = cuts or []

    def run(items):
        codec = token_ids(vocab)
        for b in batches(items, nbytes=1 << 20):
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            lens = np.zeros(b.num_rows, np.int64)
            ids, lens[~null] = codec.encode_many(b.column(1).drop_null().to_pylist())
            ends = np.append(0, np.cumsum(lens) * codec.type.itemsize).astype(np.int32)
            valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None
            values = pa.Array.from_buffers(pa.binary(), b.num_rows, [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())])
            at = pa.array([bisect_left(cuts, k) for k in b.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), values, at], ["doc_id", "ids", "shard"])

    return docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)


def bounds(docs: DataFrame, id_col: str, n: int) -> list:
    """The last identifier of each of about n ranges but the highest, ascending: one row a shard comes to the driver."""
    keys = docs.select(F.col(f"`{id_col}`").alias("k")).where("k is not null").repartitionByRange(n, "k")
    last = keys.select("k", F.spark_partition_id().alias("p")).groupBy("p").agg(F.max("k").alias("k"))
    return sorted(r["k"] for r in last.collect())[:-1]


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs_per_shard: int = 10_000, vocab: str = PIECES) -> DataFrame:
    """Segments (shard, seq, kind, first_doc_id, entries, bytes) of all shards."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.StringType, T.IntegralType)):
        raise TypeError(f"identifiers must be integers or strings, not {kind.simpleString()}")
    total = docs.where(F.col(f"`{id_col}`").isNotNull()).count()
    n = max(1, -(-total // docs_per_shard))
    cuts = bounds(docs, id_col, n) if n > 1 else []
    n = len(cuts) + 1
    parts = min(n, MAX_PARTITIONS)
    placed = encoded(docs, id_col, text_col, vocab, cuts).repartitionById(parts, F.floor(F.col("shard").cast("long") * parts / n).cast("int")).sortWithinPartitions("shard", "doc_id", "ids")
    schema = SEGMENT.format(id=kind.simpleString())
    arrow = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("kind", pa.string()), ("first_doc_id", to_arrow_type(kind)), ("entries", pa.int64()), ("bytes", pa.binary())])

    def run(items):
        build, at, seq = None, None, 0

        def emit(found):
            nonlocal seq
            rows = []
            for what, first, entries, data in found:
                rows.append((at, seq, what, first, entries, data))
                seq += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for b in batches(items, 1000, 4 << 20):
            for doc, ids, s in zip(*(c.to_pylist() for c in b.select(["doc_id", "ids", "shard"]).columns)):
                if s != at:
                    if build:
                        yield from emit(build.finish())
                    build, at, seq = Builder(), s, 0
                yield from emit(build.add(key_of(doc), ids, doc))
        if build:
            yield from emit(build.finish())

    return placed.mapInArrow(run, schema)


def write_shards(segments: DataFrame, folder: str) -> DataFrame:
    """Files shard-N.sst of the segments; (shard, file, size). Each appears by rename, whole."""

    def run(items):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        at, out, size, done, own = None, None, 0, [], TaskContext.get().taskAttemptId()

        def close():
            out.close()
            fs.move(f"{base}/.shard-{at:06d}.{own}", f"{base}/shard-{at:06d}.sst")
            done.append((at, f"{folder}/shard-{at:06d}.sst", size))

        for b in items:
            for s, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != at:
                    if out:
                        close()
                    at, size, out = s, 0, fs.open_output_stream(f"{base}/.shard-{s:06d}.{own}")
                out.write(data)
                size += len(data)
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("shard", "file", "size"), map(list, zip(*done)))), pa.schema([("shard", pa.int32()), ("file", pa.string()), ("size", pa.int64())]))

    placed = segments.select("shard", "bytes", "seq").repartition("shard").sortWithinPartitions("shard", "seq")
    return placed.select("shard", "bytes").mapInArrow(run, "shard int, file string, size long")


def lookup(segments: DataFrame, made: DataFrame, wanted: DataFrame, id_col: str = "doc_id", vocab: str = PIECES) -> DataFrame:
    """(doc_id, found, text) of wanted identifiers in written shards: each goes to the shard of its range, which is searched in its mapped file.

    made: (shard, file) of ``write_shards``. An identifier in several rows has a row for each; an absent or null one has found = false.
    """
    kind = wanted.schema[id_col].dataType
    first = segments.where("kind = 'data'").groupBy("shard").agg(F.min("first_doc_id").alias("first"))
    keys = wanted.select(F.col(f"`{id_col}`").alias("doc_id")).distinct()
    rows = keys.select(F.col("doc_id").alias("k"), F.lit(1).alias("asks"), F.lit(None).cast("int").alias("shard"))
    rows = rows.unionByName(first.select(F.col("first").cast(kind).alias("k"), F.lit(0).alias("asks"), "shard"))
    # The last shard that begins at or before a key, by one sorted pass over ranges of keys and a carry between ranges.
    parts = max(1, keys.sparkSession.sparkContext.defaultParallelism)
    ranged = written(rows.repartitionByRange(parts, "k").withColumn("p", F.spark_partition_id()), "lookups")
    carry = ranged.groupBy("p").agg(F.max("shard").alias("top")).withColumn("before", F.max("top").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))  # one row a range
    here = F.max("shard").over(Window.partitionBy("p").orderBy("k", "asks").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("here", here).where("asks = 1").join(F.broadcast(carry.select("p", "before")), "p").select(F.col("k").alias("doc_id"), F.coalesce("here", "before").alias("shard"))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("found", T.BooleanType()), T.StructField("text", T.StringType())])

    def run(items):
        at, reader = None, None
        for b in items:
            out: list[tuple] = []
            for key, file in zip(*(c.to_pylist() for c in b.columns)):
                if file != at:
                    at, reader = file, None if file is None else Reader(_mapped(file), vocab)
                values = reader.get_all(key) if reader and key is not None else []
                out += [(key, True, None if v is None else reader.codec.decode(v)) for v in values] or [(key, False, None)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (b.column(0).type, pa.bool_(), pa.string()))], ["doc_id", "found", "text"])

    asked = placed.join(made.select("shard", "file"), "shard", "left").repartition("file").sortWithinPartitions("file", "doc_id")
    return asked.select("doc_id", "file").mapInArrow(run, schema)


def _mapped(file: str):
    from pyarrow import fs as pafs

    fs, path = open_fs(file)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with fs.open_input_stream(path) as f:
        return f.read()
