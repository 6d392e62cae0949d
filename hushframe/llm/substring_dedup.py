"""Operator 1: substring dedup by relative Lempel-Ziv factors against routed reference blocks.

Documents are sequences of words (cut at white space) and are factored against reference
blocks made of all the other documents; factors of at least ``least`` words become spans.

*Routing.* Every run of ``least`` words has a minimizer: the smallest hash among its runs of
``ANCHOR`` words. Equal runs have equal minimizers. A document's context around a minimizer
(all words that a run of ``least`` words with it can hold) goes to the block that the
minimizer's hash names, if the minimizer occurs twice at all. So the one block that a context
meets holds each sufficiently long match that it has anywhere, and factoring against it finds
what factoring against every block would, at a cost that grows with the input and not with
its square.

*Factors.* A block is indexed by the sorted suffixes of its contexts. The longest match of a
suffix in another document is with its nearest neighbour of another document in that order.
A context is factored greedily from the left: a factor is the longest match at its start, or
one word. Factors of at least ``least`` words are spans. A greedy factor may end inside a longer
match that began within it, so each factor boundary is checked: the longest matches at the ``least``
starts up to it count as well, if they are long enough. A long match lies in a long factor or
crosses a boundary, so nothing is missed (see ``looked_at``). Spans of a document that overlap or
touch are joined.

*Skew.* Equal contexts are indexed once. A minimizer with more than ``HOT`` places is split by
its context: a match of 50 words with a 10-word anchor holds 20 words more on the right or on
the left, so each place goes to the part of its next 20 and to that of its last 20 words.

The result (doc_id, start_word, end_word, n_words) lists all spans of all documents, the first
holder's too; ``cut`` removes them from texts.

Edges: null texts and texts below ``least`` words have no spans; a very long text is factored whole; a null id's spans are listed under
a null id; rows equal in id and text are one document, and repeats inside one document only
don't count; equal ids with different texts are different documents; an empty table gives no
rows. Extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, batches, gram_hashes, mix, spare, word_hashes, written

LEAST, ANCHOR = 50, 10
#: Places of a minimizer above which its contexts are split.
HOT = 50_000
#: Contexts that are indexed at a time, where a minimizer ends.
BLOCK_ROWS = 20_000


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost least hash of every window."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def anchors(texts: DataFrame, least: int) -> DataFrame:
    """(h, row, pos) of every minimizer of rows (row, text)."""
    schema = pa.schema([("h", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())])
    window = least - ANCHOR + 1

    def run(items):
        memo = WordHashes()
        for b in batches(items, 2000, 4 << 20):
            words, counts = word_hashes(b.column(1), memo)
            grams, rows, hs, ps, ends = gram_hashes(words, ANCHOR), [], [], [], np.cumsum(counts)
            for row, e, c in zip(b.column(0).to_pylist(), ends.tolist(), counts.tolist()):
                if c >= least:
                    own = grams[e - c : e - ANCHOR + 1]
                    at = minimizers(own, window)
                    hs.append(own[at]), ps.append(at), rows.append(np.full(len(at), row, np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(rows)), pa.array(np.concatenate(ps).astype(np.int32))], schema=schema)

    return texts.select("row", "text").mapInArrow(run, "h long, row long, pos int")


def contexts(held: DataFrame, least: int) -> DataFrame:
    """(h, row, id, pos, tokens) of rows (row, id, text, places); a place is 2 * pos, plus 1 if it is hot."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("row", T.LongType()), held.schema["id"], T.StructField("pos", T.IntegerType()), T.StructField("tokens", T.BinaryType())])
    before, width = least - ANCHOR, 2 * least - ANCHOR
    near = before // 2

    def run(items):
        memo = WordHashes()
        for b in batches(items, 500, 2 << 20):
            ids = b.column(1)
            out: list[list] = [[] for _ in range(4)]
            which = []
            every, counts = word_hashes(b.column(2), memo)
            ends = np.cumsum(counts)
            for k, (row, end, count, places) in enumerate(zip(b.column(0).to_pylist(), ends.tolist(), counts.tolist(), b.column(3).to_pylist())):
                words = every[end - count : end]
                place = np.array(sorted(set(places)), np.int64)
                at, hot = place >> 1, (place & 1).astype(bool)
                h = gram_hashes(words, ANCHOR)[at]
                where = at[:, None] + np.arange(-before, least)
                inside = (where >= 0) & (where < len(words))
                tokens = np.where(inside, (words[np.clip(where, 0, len(words) - 1)] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
                if hot.any():
                    weights = mix(np.arange(1, near + 1, dtype=np.uint64)) | np.uint64(1)
                    left = (tokens[hot, before - near : before] * weights).sum(axis=1, dtype=np.uint64)
                    right = (tokens[hot, before + ANCHOR : before + ANCHOR + near] * weights).sum(axis=1, dtype=np.uint64)
                    h = np.concatenate([h[~hot], mix(h[hot] + left), mix(h[hot] ^ mix(right))])
                    at = np.concatenate([at[~hot], at[hot], at[hot]])
                    tokens = np.concatenate([tokens[~hot], tokens[hot], tokens[hot]])
                out[0].append(h), out[1].append(np.full(len(h), row, np.int64)), out[2].append(at), out[3].append(tokens)
                which.append(np.full(len(h), k))
            if which:
                tokens = np.ascontiguousarray(np.concatenate(out[3]))
                n = len(tokens)
                offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * (4 * width)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(out[0]).view(np.int64)),
                        pa.array(np.concatenate(out[1])),
                        ids.take(pa.array(np.concatenate(which))),
                        pa.array(np.concatenate(out[2]).astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(tokens.tobytes())]),
                    ],
                    ["h", "row", "id", "pos", "tokens"],
                )

    return held.select("row", "id", "text", "places").mapInArrow(run, schema)


def longest_factors(tokens: np.ndarray, group: np.ndarray, owner: np.ndarray, starts: int) -> np.ndarray:
    """For each context and start the length of its longest match in a context of another owner of its group.

    Owner -1 stands for several documents with this very context: it matches itself.
    """
    n, width = tokens.shape
    rank = np.zeros(n, np.uint64)
    out = np.zeros((n, starts), np.int32)
    shared = owner < 0
    for s in range(width - 1, -1, -1):
        rank = np.unique(tokens[:, s].astype(np.uint64) << np.uint64(32) | rank, return_inverse=True)[1].astype(np.uint64)
        if s >= starts:
            continue
        order = np.argsort(group.astype(np.uint64) << np.uint64(32) | rank, kind="stable")
        a = tokens[order][:, s:]
        same = np.zeros((n, a.shape[1] + 1), bool)
        same[1:, :-1] = (a[1:] == a[:-1]) & (a[1:] != 0)
        same[1:][group[order][1:] != group[order][:-1]] = False
        lcp = same.argmin(axis=1).astype(np.int32)  # with the one before
        own = owner[order]
        alike = np.zeros(n, bool)
        alike[1:] = (own[1:] == own[:-1]) & (own[1:] >= 0)
        back, ahead = lcp.copy(), np.append(lcp[1:], 0).astype(np.int32)
        if alike.any():  # over neighbours of the same document: on to the nearest of another one
            for i in np.flatnonzero(alike):
                back[i] = min(lcp[i], back[i - 1])
            for i in np.flatnonzero(alike)[::-1]:
                ahead[i - 1] = min(lcp[i], ahead[i])
        best = np.maximum(back, ahead)
        full = (np.concatenate([a != 0, np.zeros((n, 1), bool)], axis=1)).argmin(axis=1)
        mine = shared[order]
        best[mine] = full[mine]
        out[order, s] = best
    return out


def looked_at(length: np.ndarray, least: int) -> np.ndarray:
    """Starts of greedy factors, and the ``least`` starts up to each boundary between factors.

    Let a match of ``least`` words or more begin in the factor from p to b. If it ends by b, that factor
    is as long. If it ends later and begins after b - ``least``, its start is looked at. Else the factor is
    long, and so is what is left of the match from b - ``least`` + 1 on: together they cover it. A row has
    all starts that can hold ``least`` words of its context.
    """
    n, starts = length.shape
    begins = np.zeros((n, starts), bool)
    edge = np.zeros((n, starts + 1), np.int32)
    live, at = np.arange(n), np.zeros(n, np.int64)
    while len(live):
        begins[live, at] = True
        at = at + np.maximum(1, length[live, at])
        first = np.maximum(0, at - least + 1)
        np.add.at(edge, (live, np.minimum(first, starts)), 1)
        np.add.at(edge, (live, np.minimum(at + 1, starts)), -1)
        live, at = live[at < starts], at[at < starts]
    return begins | (edge.cumsum(axis=1)[:, :starts] > 0)


def parse(length: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the long factors, joined within each context."""
    n, starts = length.shape
    edge = np.zeros((n, width + 1), np.int32)
    c, s = np.nonzero((length >= least) & looked_at(length, least))
    np.add.at(edge, (c, s), 1)
    np.add.at(edge, (c, s + length[c, s]), -1)
    cover = np.zeros((n, width + 2), np.int8)
    cover[:, 1:] = edge.cumsum(axis=1) > 0
    step = np.diff(cover, axis=1)
    c, begin = np.nonzero(step > 0)
    return c, begin, np.nonzero(step < 0)[1]


def factored(placed: DataFrame, least: int) -> DataFrame:
    """(id, row, start, end) of the spans of contexts that come sorted by (h, tokens, row)."""
    schema = T.StructType([placed.schema["id"], *[T.StructField(c, T.LongType()) for c in ("row", "start", "end")]])
    before, width = least - ANCHOR, 2 * least - ANCHOR

    def index(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        h, row, pos = (t.column(c).to_numpy() for c in ("h", "row", "pos"))
        raw = t.column("tokens").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        tokens = np.frombuffer(raw.buffers()[2], np.uint32, count=len(h) * width, offset=raw.offset * 4 * width).reshape(len(h), width)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (tokens[1:] != tokens[:-1]).any(axis=1)
        of = np.cumsum(new) - 1  # the distinct context of each place
        owner = np.unique(row, return_inverse=True)[1].astype(np.int64)
        own = owner[new]
        other = owner != own[of]
        own[of[other]] = -1
        group = np.cumsum(np.append(True, h[new][1:] != h[new][:-1])) - 1
        lone = np.bincount(group) == 1  # a minimizer with one context of one document
        live = ~(lone[group] & (own >= 0))
        length = np.zeros((len(own), before + 1), np.int32)
        if live.any():
            length[live] = longest_factors(tokens[new][live], group[live], own[live], before + 1)
        c, begin, end = parse(length, least, width)
        count = np.bincount(c, minlength=len(own))
        first = np.cumsum(count) - count
        times = count[of]
        k = np.repeat(np.arange(len(of)), times)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
        at = first[of[k]] + nth
        base = pos[k].astype(np.int64) - before
        yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks().take(pa.array(k)) if not isinstance(t.column("id").combine_chunks(), pa.ChunkedArray) else pa.concat_arrays(t.column("id").take(pa.array(k)).chunks), pa.array(row[k]), pa.array(base + begin[at]), pa.array(base + end[at])], ["id", "row", "start", "end"])

    def run(items):
        held, n = [], 0
        for b in batches(items, BLOCK_ROWS, 1 << 30):
            if not b.num_rows:
                continue
            if n >= BLOCK_ROWS:  # close the block where the minimizer changes
                h, last = b.column(0).to_numpy(), held[-1].column(0)[-1].as_py()
                k = int((h == last).argmin()) if (h != last).any() else b.num_rows
                if k < b.num_rows:
                    if k:
                        held.append(b.slice(0, k))
                    yield from index(held)
                    held, n, b = [], 0, b.slice(k)
            held.append(b)
            n += b.num_rows
        if held:
            yield from index(held)

    return placed.select("h", "row", "id", "pos", "tokens").mapInArrow(run, schema)


def joined(spans: DataFrame) -> DataFrame:
    """Spans (id, row, start, end) of a document that overlap or touch become one."""
    w = Window.partitionBy("id", "row").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("id", "row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(id, row, start, end) of all spans, ``row`` telling apart documents of one id by their text."""
    if least <= ANCHOR:
        raise ValueError(f"least must be more than {ANCHOR}")
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    rows = docs.where(text.isNotNull()).select(F.xxhash64(key, text).alias("row"), key.alias("id"), text.alias("text"))
    n = F.count(F.lit(1)).over(Window.partitionBy("h"))
    again = anchors(rows, least).withColumn("n", n).where("n > 1")
    places = again.groupBy("row").agg(F.collect_list((F.col("pos") * 2 + (F.col("n") > hot).cast("int")).cast("int")).alias("places"))
    held = rows.join(written(places, "places"), "row")
    placed = contexts(held, least).repartition("h").sortWithinPartitions("h", "tokens", "row")
    return joined(factored(placed, least).distinct())


def substring_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    found = repeats(docs, id_col, text_col, least)
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"))


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with the words of all spans removed from their texts; other texts stay as they are."""
    c_row, c_found, c_spans = spare(docs, "row", "found", "spans")
    found = repeats(docs, id_col, text_col, least).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(c_spans)).withColumnRenamed("row", c_found)
    text = F.col(f"`{text_col}`")
    tagged = docs.withColumn(c_row, F.xxhash64(F.col(f"`{id_col}`"), text.cast("string"))).join(found, (F.col(c_row) == F.col(c_found)) & text.isNotNull(), "left")
    words = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")
    inside = lambda i: F.exists(F.col(c_spans), lambda s: (s["start"] <= i) & (i < s["end"]))
    rest = F.array_join(F.filter(words, lambda w, i: ~inside(i)), " ")
    return tagged.select(*[F.when(F.col(c_spans).isNotNull(), rest).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
