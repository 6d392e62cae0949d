"""Operator 9: SentencePiece encoding and decoding with seeded merge-dropout.

Encoding is merge-type (BPE): the symbols of a word are merged pairwise, best rank first and
leftmost among equals. Every candidate merge, two neighbouring symbols at given places of a
document, is skipped for good with probability ``dropout``: a hash keyed by the seed, the
document's id and the candidate's three boundaries decides. As the key names the candidate
itself and not the moment it comes up, the outcome is the same in any order of processing,
batching or partitioning. A different seed gives a different segmentation; every one
decodes to the same text.

Two equal ways do the agenda's work. ``_lockstep`` merges one pair in each of very many
short words at a time in NumPy; words longer than ``LONG`` symbols go through a priority
queue one by one, in O(n log n). Neither a word nor a text is ever cut.

Losslessness: a blank becomes U+2581, led by one dummy as the model has it; characters without a
piece, and a literal U+2581, become byte pieces. Other white space is kept as it is.

Edges: a null text has null tokens; an empty text has none and decodes to itself; a very long
text is encoded whole; a null id is a key like any other; repeated rows, and rows of equal id and
text, are encoded alike; an empty table gives no rows. Only id and text are read.
One scan, no shuffle.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, mix
from .vocab import PIECES, SPACE, pieces, settled

LONG = 64
NONE = np.int32(2**31 - 1)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_U32 = np.int64(0xFFFFFFFF)


class Merges:
    """Merge tables of a vocabulary in flat arrays."""

    def __init__(self, path: str = PIECES) -> None:
        p = pieces(path)
        self.pieces = p
        order = {s: r for r, s in enumerate(sorted({p.score[i] for i in p.normal.values()}, reverse=True))}
        self.rank = np.full(p.size, NONE, np.int32)
        for i in p.normal.values():
            self.rank[i] = order[p.score[i]]
        self.char = np.full(0x110000, -1, np.int32)
        for t, i in p.normal.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        self.space = p.normal[SPACE]
        self.char[ord(SPACE)] = -1  # a literal one isn't a blank
        self.char[32] = self.space
        pairs = {}
        for t, i in p.normal.items():
            for k in range(1, len(t)):
                a, b = p.normal.get(t[:k]), p.normal.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.pairs = pairs
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        keys, vals = np.full(size + 64, -1, np.int64), np.full(size + 64, -1, np.int32)
        at = self._slot(np.fromiter(pairs, np.int64, len(pairs)))
        for h, (k, v) in zip(at.tolist(), pairs.items()):
            while keys[h] >= 0:
                h += 1
            keys[h], vals[h] = k, v
        self.keys, self.vals = keys, vals
        self.byte_piece = np.array([p.bytes[b] for b in range(256)], np.int32)
        self.raw = [b""] * p.size
        for t, i in p.normal.items():
            self.raw[i] = t.replace(SPACE, " ").encode()
        for b, i in p.bytes.items():
            self.raw[i] = bytes([b])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _A) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that two pieces make, or -1."""
        key = left.astype(np.int64) << 20 | right
        h = self._slot(key)
        found = self.keys[h]
        out = np.where(found == key, self.vals[h], np.int32(-1))
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            h[open_] += 1
            found = self.keys[h[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.vals[h[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


_MERGES: dict[str, Merges] = {}


def merges(path: str = PIECES) -> Merges:
    if path not in _MERGES:
        _MERGES[path] = Merges(path)
        settled()
    return _MERGES[path]


def _candidates(m: Merges, sym_l, sym_r, s, mid, e, noise, limit):
    """Rank of each candidate merge, NONE where there is none or it is skipped."""
    new = m.merged(sym_l, sym_r)
    rank = np.where(new >= 0, m.rank[new], NONE)
    if limit:
        h = (noise[s] * _B + noise[mid] * _C + noise[e] * _D) ^ (noise[mid] >> np.uint64(29))
        rank[(h * _A) < limit] = NONE
    return rank


def _lockstep(m: Merges, sym, st, en, starts, noise, limit, flat) -> None:
    """Merges the chunks that begin at ``starts`` and writes their pieces to ``flat`` by place."""
    n = len(sym)
    rank = np.full(n, NONE, np.int32)
    if n > 1:
        last = np.zeros(n, bool)
        last[starts[1:] - 1] = True
        last[-1] = True
        i = np.flatnonzero(~last)
        rank[i] = _candidates(m, sym[i], sym[i + 1], st[i], en[i], en[i + 1], noise, limit)
    while len(starts):
        key = (rank.astype(np.int64) << 32) | np.arange(len(rank), dtype=np.int64)
        best = np.minimum.reduceat(key, starts)
        go = best < (np.int64(NONE) << 32)
        keep = np.ones(len(sym), bool)
        lens = np.diff(np.append(starts, len(sym)))
        if not go.all():
            done = np.repeat(~go, lens)
            flat[st[done]] = sym[done]
            keep[done] = False
            lens = lens[go]
            if not len(lens):
                return
        i = best[go] & _U32
        j = i + 1
        sym[i] = m.merged(sym[i], sym[j])
        en[i] = en[j]
        keep[j] = False
        place = np.cumsum(keep) - 1
        sym, st, en, rank = sym[keep], st[keep], en[keep], rank[keep]
        i = place[i]
        lens = lens - 1
        starts = np.cumsum(lens) - lens
        ends = starts + lens
        a = i > starts
        b = i + 1 < ends
        rank[i] = NONE
        left = np.concatenate([i[a] - 1, i[b]])
        if len(left):
            right = left + 1
            rank[left] = _candidates(m, sym[left], sym[right], st[left], en[left], en[right], noise, limit)


def _agenda(m: Merges, sym, first: int, noise, limit, flat) -> None:
    """One long chunk by priority queue; places count from ``first``."""
    n, ids = len(sym), sym.tolist()
    prev, nxt, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    rank, pairs, alive = m.rank, m.pairs, [True] * n
    z = noise[first : first + n + 1].tolist()
    mask, heap = (1 << 64) - 1, []

    def offer(a: int) -> None:
        b = nxt[a]
        if b >= n or (new := pairs.get(ids[a] << 20 | ids[b])) is None:
            return
        if limit:
            h = ((z[a] * int(_B) + z[b] * int(_C) + z[end[b]] * int(_D)) & mask) ^ (z[b] >> 29)
            if (h * int(_A)) & mask < int(limit):
                return
        heapq.heappush(heap, (int(rank[new]), a, b, end[b], new))

    for a in range(n):
        offer(a)
    while heap:
        _, a, b, e, new = heapq.heappop(heap)
        if not alive[a] or not (b < n and alive[b]) or nxt[a] != b or end[b] != e:
            continue
        alive[b], ids[a], end[a], nxt[a] = False, new, e, nxt[b]
        if nxt[a] < n:
            prev[nxt[a]] = a
        if prev[a] >= 0:
            offer(prev[a])
        offer(a)
    for a in range(n):
        if alive[a]:
            flat[first + a] = ids[a]


def encode_batch(keys: list, texts: list[str | None], path: str = PIECES, dropout: float = 0.1, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts, end to end, and the number of each text's pieces."""
    m = merges(path)
    whole = [" " + t if t else "" for t in texts]
    lens = np.fromiter(map(len, whole), np.int64, len(whole))
    cps = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    counts = np.zeros(len(texts), np.int64)
    if not len(cps):
        return np.zeros(0, np.int32), counts
    sym = m.char[cps]
    bounds = np.cumsum(lens)
    odd = np.flatnonzero(sym < 0)
    wide = sym < 0
    if len(odd):  # byte fallback: such characters take several places
        enc = [chr(c).encode("utf-8", "surrogatepass") for c in cps[odd].tolist()]
        size = np.ones(len(sym), np.int64)
        size[odd] = list(map(len, enc))
        new = np.repeat(sym, size)
        wide = new < 0
        new[wide] = m.byte_piece[np.frombuffer(b"".join(enc), np.uint8)]
        bounds = np.cumsum(size)[bounds - 1] * (bounds > 0)
        sym = new
    n = len(sym)
    begins = np.concatenate([[0], bounds[:-1]])
    dk = np.fromiter((xxhash.xxh64_intdigest(f"{seed}\x1f{k!r}".encode("utf-8", "surrogatepass")) for k in keys), np.uint64, len(keys))
    size = bounds - begins
    place = np.arange(n, dtype=np.int64) - np.repeat(begins, size)
    noise = mix(np.append(np.repeat(dk, size) + place.astype(np.uint64) * _A, np.uint64(0)))
    limit = np.uint64(min(1.0, max(0.0, dropout)) * (2**64 - 2048)) if dropout > 0 else 0
    blank = sym == m.space
    start = wide.copy()
    start[1:] |= wide[:-1] | (blank[1:] & ~blank[:-1])
    start[begins[size > 0]] = True
    starts = np.flatnonzero(start)
    # A place that ends a document is the next document's first: give ends their own noise.
    clen = np.diff(np.append(starts, n))
    flat = np.full(n, -1, np.int32)
    one = clen == 1
    flat[starts[one]] = sym[starts[one]]
    ends_doc = np.zeros(n + 1, bool)
    ends_doc[bounds] = True
    noise_end = noise.copy()
    noise_end[ends_doc] = _D
    long = np.flatnonzero(clen > LONG)
    for c in long.tolist():
        s, e = int(starts[c]), int(starts[c] + clen[c])
        local = noise[s : e + 1].copy()
        local[-1] = noise_end[e]
        out = np.full(e - s, -1, np.int32)
        _agenda(m, sym[s:e], 0, local, limit, out)
        flat[s:e] = out
    short = (clen > 1) & (clen <= LONG)
    if short.any():
        take = np.repeat(short, clen)
        st = np.flatnonzero(take).astype(np.int32)
        lens_ = clen[short]
        # chunk ends that are document ends use noise past the array's proper places
        ext = np.concatenate([noise, noise_end[bounds]])
        en = st + np.int32(1)
        closing = np.cumsum(lens_) - 1
        e = en[closing]
        doc_end = ends_doc[e]
        where = np.searchsorted(bounds, e[doc_end])
        en[closing[doc_end]] = (n + 1 + where).astype(np.int32)
        _lockstep(m, sym[take], st, en, np.cumsum(lens_) - lens_, ext, limit, flat)
    at = np.concatenate([[0], np.cumsum(flat >= 0)])
    return flat[flat >= 0], at[bounds] - at[begins]


def decode(ids, path: str = PIECES) -> str:
    """The text of its pieces."""
    raw = merges(path).raw
    return b"".join(map(raw.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = PIECES, dropout: float = 0.1, seed: int = 0, verify: bool = True) -> DataFrame:
    """(doc_id, n_pieces, pieces, lossless); ``lossless`` tells that decoding gave back the text."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_pieces", T.LongType()), T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())]
    )

    def run(items):
        raw = merges(vocab).raw
        for b in batches(items, 500, 384 << 10):
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            ids, counts = encode_batch(keys, texts, vocab, dropout, seed)
            null = np.array([t is None for t in texts])
            ends = np.cumsum(counts)
            offsets = pa.array(np.append(0, ends), pa.int32(), mask=np.append(null, False))
            pieces = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            same = None
            if verify:
                parts = list(map(raw.__getitem__, ids.tolist()))
                same = [None if t is None else b"".join(parts[e - c : e])[1:] == t.encode("utf-8", "surrogatepass") for t, c, e in zip(texts, counts.tolist(), ends.tolist())]
            lossless = pa.array(same if verify else [None] * len(texts), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64(), mask=null), pieces, lossless], ["doc_id", "n_pieces", "pieces", "lossless"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, vocab: str = PIECES) -> DataFrame:
    """(doc_id, text) of rows with doc_id and pieces; null pieces give a null text."""
    schema = T.StructType([T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def run(items):
        for b in items:
            texts = [None if p is None else decode(p, vocab) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, schema)
