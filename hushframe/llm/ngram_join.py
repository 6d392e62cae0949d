"""Operator 3: n-gram Jaccard join by a MinHash LSH forest, verified exactly.

A text is the set of its runs of ``n`` words (a shorter text is one run). Texts with the
same set form a class; classes are the rows of the forest.

* Each of ``trees`` tries holds every class under a label of MinHash values. A trie is its
  labels sorted by prefix, so the members of a node lie side by side; tasks take whole nodes.
* A query (every class is one) shortens its matched prefixes step by step until the recall
  that it is then sure of, ``1 - prod(1 - t**depth_i)`` over the tries for pairs at the threshold t
  (more above it), reaches ``recall``. With all tries alike this ends at ``stop_depth``. Where the node
  at that depth is crowded (more than ``crowd`` classes), the query keeps one value more of that
  trie's label, and shortens its prefixes in uncrowded tries by one instead, until the
  recall is reached again (``depths``). So a prefix that a third of the corpus shares costs
  no pairs that another trie can find cheaper. A pair is met where either's prefix allows it.
* A pair met in several tries is taken once. Pairs whose sketches (low bytes of all MinHash
  values of their labels) agree in fewer places than a pair at the threshold would, with a chance
  of one in a billion, are dropped; against the target recall that is nothing.
* What is left is verified exactly on 64-bit hashes of all n-grams of the whole texts. A
  class's *home* is the least class among itself and its partners; the classes of a home are
  dealt into blocks of about ``BLOCK``, and a task gets two blocks with the pairs between
  them, so in a large cluster a text moves once a block and not once a partner.

No node, partner list or candidate list is capped. Only classes that have a candidate are
read again.

``near_classes`` gives one row a document (doc_id, class_id, n_links): the least id of its connected
group, and how many other rows are at or above the threshold, counted by class and not listed.
``representative_pairs`` gives (doc_id_a, doc_id_b, jaccard), a < b, for the classes' least ids;
``near_dedup`` keeps one row of each connected group.

Edges: null, empty and blank texts have no n-grams and match nothing; rows with a null id count as
rows and links, and their class is the least id that isn't null, if there is one; repeated rows
and rows of equal id count each; a very long text is one set like any other. ``near_dedup`` keeps the
row of the least id (nulls last, then by the remaining columns as JSON). An empty table gives no
rows. Extra columns are carried along by ``near_dedup``, whatever their names, and not read otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batches, discard, gram_hashes, mix, spare, word_hashes, written

NGRAM, THRESHOLD, RECALL, TREES = 3, 0.5, 0.95, 48
BLOCK = 128
#: Most rows of a lookup table (about 50 bytes each) that is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Classes in a trie's node from which on it is crowded.
CROWD = 4096
_SIGMAS = 6.0


def stop_depth(threshold: float, trees: int, recall: float) -> int:
    """The deepest prefix at which pairs at the threshold are found with the wanted probability."""
    depth = 1
    while 1 - (1 - threshold ** (depth + 1)) ** trees >= recall:
        depth += 1
    if 1 - (1 - threshold**depth) ** trees < recall:
        raise ValueError("more trees are needed for this recall")
    return depth


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    z = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return z[:k] | np.uint64(1), z[k:]


def gram_sets(texts, n: int, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts end to end, and how many each has."""
    words, counts = word_hashes(texts, memo)
    ends = np.cumsum(counts)
    grams = gram_hashes(words, n)
    parts = []
    for e, c in zip(ends.tolist(), counts.tolist()):
        if c >= n:
            parts.append(np.unique(grams[e - c : e - n + 1]))
        elif c:
            parts.append(mix(np.array([int(sum(int(w) * (2 * i + 3) for i, w in enumerate(words[e - c : e]))) & ((1 << 64) - 1)], np.uint64)))
        else:
            parts.append(np.zeros(0, np.uint64))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.fromiter(map(len, parts), np.int64, len(parts))


def depths(crowded: np.ndarray, stop: int, threshold: float, recall: float) -> np.ndarray:
    """The prefix length of each trie of a query: one more than ``stop`` in crowded tries, one less in as many others as the recall needs."""
    out = np.where(crowded, stop + 1, stop)
    miss = float(np.prod(1 - threshold**out.astype(float)))
    for down in ([~crowded, crowded] if stop > 1 else [crowded]):  # if others don't do, crowded ones come back
        for i in np.flatnonzero(down):
            if 1 - miss >= recall:
                return out
            miss *= (1 - threshold ** float(out[i] - 1)) / (1 - threshold ** float(out[i]))
            out[i] -= 1
    return out


def minhashes(grams: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """k 32-bit MinHash values of each set (sets begin at ``starts`` and aren't empty), one row a value."""
    a, b = (x.astype(np.uint32) for x in _multipliers(k))
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((k, len(starts)), np.uint32)
    held = np.empty_like(low)
    for i in range(k):
        np.bitwise_xor(low, b[i], out=held)
        np.multiply(held, a[i] | np.uint32(1), out=held)
        out[i] = np.minimum.reduceat(held, starts)
    return out


SIG = "content binary, h1 long, h2 long, grams int, label binary"


def signatures(texts: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """Of rows (content, text): the class hashes, set size, and the labels of all tries (16 bits of each of ``depth`` MinHash values)."""
    schema = pa.schema([("content", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64()), ("grams", pa.int32()), ("label", pa.binary())])

    def run(items):
        memo = WordHashes()
        for b in batches(items, 2000, 1 << 20):
            grams, counts = gram_sets(b.column(1), n, memo)
            some = counts > 0
            if not some.any():
                continue
            sizes = counts[some]
            starts = np.cumsum(sizes) - sizes
            label = np.ascontiguousarray((minhashes(grams, starts, trees * depth) >> np.uint32(8)).astype("<u2").T)
            h1 = np.add.reduceat(mix(grams), starts)
            h2 = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), starts)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(sizes.astype(np.int32)), _binaries(label)], schema=schema)

    return texts.select("content", "text").mapInArrow(run, SIG)


def _binaries(rows: np.ndarray) -> pa.Array:
    """A binary value a row of a contiguous array."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def prefixes(label: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Keys of the tries' nodes at a depth, a column a trie; the lowest byte is the trie's number."""
    label = label.reshape(len(label), trees, -1).astype(np.uint64)
    out = np.full((len(label), trees), depth, np.uint64)
    for d in range(depth):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + label[:, :, d] + np.uint64(1))
    return (out & ~np.uint64(255) | np.arange(trees, dtype=np.uint64)).view(np.int64)


NODES = "key long, node long, grams int"


def trie_rows(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(key, node, grams) of every class in every trie, at a depth."""

    def run(items):
        for b in batches(items, 4000):
            key = prefixes(_matrix(b.column(2), "<u2"), trees, depth)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(pa.array(np.repeat(b.column(k).to_numpy(), trees)) for k in (0, 1))], ["key", "node", "grams"])

    return classes.select("node", "grams", "label").mapInArrow(run, NODES)


def met(rows: DataFrame, threshold: float, crowd: float) -> DataFrame:
    """(a, b) of the pairs in each trie node whose sizes allow the threshold; (class, -1 - trie) of the members of crowded nodes instead.

    Nodes stream by in sorted order, so a crowded one is never held.
    """

    def pairs(key, node, grams):
        i = np.flatnonzero(key[1:] == key[:-1])
        step = 1
        while len(i):
            x, y = node[i], node[i + step]
            small, large = np.minimum(grams[i], grams[i + step]), np.maximum(grams[i], grams[i + step])
            ok = (x != y) & (small >= threshold * large)
            yield np.minimum(x, y)[ok], np.maximum(x, y)[ok]
            step += 1
            i = i[i + step < len(key)]
            i = i[key[i + step] == key[i]]

    def out(a, b):
        for k in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], ["a", "b"])

    def closed(part):
        """Whole nodes: pairs of the others, marks of the crowded."""
        key, node, grams = part
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(new, len(key)))
        many = np.repeat(size > crowd, size)
        if many.any():
            yield from out(node[many], -1 - (key[many] & 255))
        few = ~many & np.repeat(size > 1, size)
        for a, b in pairs(key[few], node[few], grams[few]):
            yield from out(a, b)

    def run(items):
        held, full = None, None
        for b in items:
            if not b.num_rows:
                continue
            part = [c.to_numpy() for c in b.columns]
            if full is not None:
                k = int(np.searchsorted(part[0] != full, True))
                yield from out(part[1][:k], -1 - (part[0][:k] & 255))
                part = [x[k:] for x in part]
                if not len(part[0]):
                    continue
                full = None
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part)]
            k = int(np.searchsorted(part[0] == part[0][-1], True))  # where the last node begins
            if k:
                yield from closed([x[:k] for x in part])
            held = [x[k:] for x in part]
            if len(held[0]) > crowd:
                full = int(held[0][0])
                yield from out(held[1], -1 - (held[0] & 255))
                held = None
        if held is not None:
            yield from closed(held)

    placed = rows.repartition("key").sortWithinPartitions("key", "node")
    return placed.mapInArrow(run, "a long, b long")


def similar_enough(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, sa, sb) whose sketches agree in a share ``least`` of their places."""

    def run(items):
        for b in items:
            if b.num_rows:
                good = pa.array((_matrix(b.column(2), np.uint8) == _matrix(b.column(3), np.uint8)).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def sketched(classes: DataFrame) -> DataFrame:
    """(node, sketch): the low byte of each MinHash value of the labels."""

    def run(items):
        for b in batches(items, 4000):
            yield pa.RecordBatch.from_arrays([b.column(0), _binaries(np.ascontiguousarray(_matrix(b.column(1), np.uint8)[:, ::2]))], ["node", "sketch"])

    return classes.select("node", "label").mapInArrow(run, "node long, sketch binary")


def _few(df: DataFrame) -> DataFrame:
    """A hint to broadcast a written table, if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, texts: DataFrame, content: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the class pairs at or above the threshold; content: a text's hash for each class."""
    both = pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("w")))
    homes = both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("home"))
    sizes = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    homes = written(homes.join(sizes, "home").select("v", F.concat_ws(":", "home", F.pmod(F.xxhash64("v"), "blocks")).alias("block")), "homes")
    ha, hb = (homes.select(F.col("v").alias(x), F.col("block").alias("b" + x)) for x in "ab")
    placed = pairs.join(ha, "a").join(hb, "b")
    task = F.xxhash64(F.least("ba", "bb"), F.greatest("ba", "bb"))
    placed = written(placed.select("a", "b", task.alias("task")), "placed-pairs")
    need = placed.select("task", F.explode(F.array("a", "b")).alias("v")).distinct()

    # Sets of the classes that have a partner, from one text each.
    wanted = written(homes.select("v").join(content, F.col("v") == F.col("node")).select("v", "content"), "wanted")
    held = texts.join(_few(wanted), "content").select("v", "text")

    def sets(items):
        memo = WordHashes()
        for b in batches(items):
            grams, counts = gram_sets(b.column(1), n, memo)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([grams[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())], pa.binary())], ["v", "grams"])

    found = held.mapInArrow(sets, "v long, grams binary").groupBy("v").agg(F.first("grams").alias("grams"))
    none = F.lit(None)
    rows = need.join(found, "v").select("task", "v", none.cast("long").alias("w"), "grams").unionByName(placed.select("task", F.col("a").alias("v"), F.col("b").alias("w"), none.cast("binary").alias("grams")))
    rows = rows.repartition("task").sortWithinPartitions("task", F.col("w").asc_nulls_first(), "v")

    def check(items):
        at, known = None, {}
        for b in batches(items, 4000, 16 << 20):
            out: list[tuple] = []
            for task, v, w, grams in zip(*(c.to_pylist() for c in b.columns)):
                if task != at:
                    at, known = task, {}
                if w is None:
                    known[v] = np.frombuffer(grams, np.uint64)
                    continue
                x, y = known[v], known[w]
                if len(x) > len(y):
                    x, y = y, x
                at_ = np.searchsorted(y, x)
                at_[at_ == len(y)] = 0
                both_ = int((y[at_] == x).sum())
                j = both_ / (len(x) + len(y) - both_)
                if j >= threshold:
                    out.append((v, w, j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["a", "b", "jaccard"])

    return rows.select("task", "v", "w", "grams").mapInArrow(check, "a long, b long, jaccard double")


def candidates(classes: DataFrame, threshold: float, recall: float, trees: int, crowd: int) -> DataFrame:
    """(a, b), a < b, of the classes that meet in a trie at the prefix either of them has. Written."""
    stop = stop_depth(threshold, trees, recall)
    first = written(met(trie_rows(classes, trees, stop), threshold, crowd), "met")
    marks = written(first.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.collect_set((-1 - F.col("b")).cast("int")).alias("tries")), "crowded")
    found = first.where("b >= 0")
    if not marks.isEmpty():
        marked = classes.join(_few(marks), "node").select("node", "grams", "label", "tries")

        def queries(items):  # keys by which crowded classes ask: deeper ones in crowded tries, shorter ones in others
            for b in batches(items, 4000):
                label, rows = _matrix(b.column(2), "<u2"), []
                keys = {d: prefixes(label, trees, d) for d in (stop - 1, stop, stop + 1) if d > 0}
                for k, tries in enumerate(b.column(3).to_pylist()):
                    full = np.zeros(trees, bool)
                    full[tries] = True
                    own = depths(full, stop, threshold, recall)
                    for d in keys:
                        rows += [(d - stop, int(keys[d][k, t]), k) for t in np.flatnonzero((own == d) & ((d != stop) | full))]
                side, key, at = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int32)), pa.array(key), pa.array(b.column(0).to_numpy()[at]), pa.array(b.column(1).to_numpy()[at])], ["side", "key", "node", "grams"])

        asked = written(marked.mapInArrow(queries, "side int, " + NODES), "asked")
        # A crowded node's members all ask one value deeper, so they meet among themselves; a class that
        # came back to the node or asks one value shorter meets every class there, crowded or not.
        deep = met(asked.where("side > 0").select("key", "node", "grams"), threshold, math.inf)
        found = found.unionByName(deep)
        for side in (0, -1):
            if stop + side > 0:
                wanted = asked.where(F.col("side") == side)
                there = trie_rows(classes, trees, stop + side).join(_few(written(wanted.select("key").distinct(), "asked-keys")), "key")
                x, y = wanted.select("key", F.col("node").alias("x"), F.col("grams").alias("gx")), there.select("key", F.col("node").alias("y"), F.col("grams").alias("gy"))
                length = (F.col("gx") >= threshold * F.col("gy")) & (F.col("gy") >= threshold * F.col("gx"))
                found = found.unionByName(x.join(y, "key").where((F.col("x") != F.col("y")) & length).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    out = written(found.distinct(), "candidates")
    discard(first, marks)
    return out


def class_pairs(texts: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Of rows (content, text), content telling texts apart: (content, node, rows) and (a, b, jaccard) with a < b of nodes, both written.

    A node numbers a class of texts with the same n-grams. The number is made by the job that
    writes it and only read afterwards, so a task that is repeated changes nothing.
    """
    if not 0 < trees <= 256:
        raise ValueError("trees must be from 1 to 256")
    depth = stop_depth(threshold, trees, recall) + 1
    sig = written(signatures(texts, n, trees, depth), "signatures")
    classes = sig.groupBy("h1", "h2").agg(F.min("content").alias("content"), F.first("grams").alias("grams"), F.first("label").alias("label"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    members = written(sig.groupBy("content", "h1", "h2").agg(F.count(F.lit(1)).alias("rows")).join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("content", "node", "rows"), "members")
    discard(sig)
    found = candidates(classes, threshold, recall, trees, crowd)
    agree = threshold + (1 - threshold) / 256
    least = agree - _SIGMAS * math.sqrt(agree * (1 - agree) / (trees * depth))
    sketches = sketched(classes)
    near = found.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    near = written(similar_enough(near, least), "near")
    discard(found)
    edges = written(verified(near, texts, classes.select("node", "content"), n, threshold), "edges")
    discard(near, classes)
    return members, edges


def _content(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.where(text.isNotNull()).select(_content(text).alias("content"), text.alias("text"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, n_links) of every row."""
    members, edges = class_pairs(_texts(docs, text_col), **options)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _content(text).alias("content"))
    held = rows.where("content is not null").groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    sizes = written(members.join(held, "content").groupBy("node").agg(F.sum("n").alias("n"), F.min("id").alias("id")), "class-sizes")
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    links = both.join(sizes.select(F.col("node").alias("w"), "n"), "w").groupBy("v").agg(F.sum("n").alias("others"))
    some = sizes.join(links, F.col("node") == F.col("v"), "left").where("n > 1 or others is not null").select("node", "n", "id", F.coalesce("others", F.lit(0)).alias("others"))
    rooted = written(some.join(components(edges).select(F.col("v").alias("node"), "root"), "node", "left").select("*", F.coalesce("root", "node").alias("group")), "linked-classes")
    least = rooted.groupBy("group").agg(F.min("id").alias("class_id"))
    touched = rooted.join(least, "group").select("node", "class_id", (F.col("n") - 1 + F.col("others")).alias("n_links"))
    named = written(members.join(touched, "node").select("content", "class_id", "n_links"), "linked-texts")
    return rows.join(_few(named), "content", "left").select(F.col("id").alias("doc_id"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representative_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of all pairs of different classes at or above the threshold, by the least id of each; classes without an id aren't listed."""
    members, edges = class_pairs(_texts(docs, text_col), **options)
    text = F.col(f"`{text_col}`").cast("string")
    held = docs.where(text.isNotNull()).groupBy(_content(text).alias("content")).agg(F.min(f"`{id_col}`").alias("id"))
    ids = written(members.join(held, "content").groupBy("node").agg(F.min("id").alias("id")).where("id is not null"), "representatives")
    a, b = (ids.select(F.col("node").alias(v), F.col("id").alias("id_" + v)) for v in "ab")
    return edges.join(a, "a").join(b, "b").select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b"), "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of the vertices of edges (a, b): the least vertex of each connected group, by alternating large and small stars."""
    now = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).where("v != w").distinct(), "stars")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("w").alias("v"), F.col("v").alias("w")))
        least = both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("m"))
        large = both.join(least, "v").where("w > v").select(F.col("w").alias("v"), F.col("m").alias("w")).where("v != w").distinct()
        large = written(large, "stars")
        discard(now)
        low = large.groupBy("v").agg(F.min("w").alias("m"))
        small = large.join(low, "v").select(F.col("w").alias("v"), F.col("m").alias("w")).unionByName(low.select("v", F.col("m").alias("w"))).where("v != w").distinct()
        now = written(small, "stars")
        discard(large)
        r = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)"))).first()
        if tuple(r) == state:
            return now.select("v", F.col("w").alias("root")).unionByName(now.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct())
        state = tuple(r)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, one of each connected group of near copies, in its columns."""
    members, edges = class_pairs(_texts(docs, text_col), **options)
    roots = components(edges)
    h, c, g, first = spare(docs, "content_hash", "content", "group_root", "first")
    rooted = members.join(roots, F.col("node") == F.col("v"), "left").select("content", "rows", F.coalesce("root", "node").alias("root"))
    many = rooted.groupBy("root").agg(F.sum("rows").alias("n")).where("n > 1").select("root")
    touched = written(rooted.join(many, "root").select(F.col("content").alias(c), F.col("root").alias(g)).distinct(), "near-groups")
    text = F.col(f"`{text_col}`")
    tagged = docs.withColumn(h, _content(text.cast("string"))).join(_few(touched), F.col(h) == F.col(c), "left")
    cols: list[Column] = [F.col(f"`{x}`") for x in docs.columns]
    key = F.col(f"`{id_col}`")
    order = F.struct(key.isNull(), key, F.to_json(F.struct(*[x for x, name in zip(cols, docs.columns) if name != id_col])))
    kept = tagged.where(F.col(g).isNotNull()).groupBy(g).agg(F.min_by(F.struct(*cols), order).alias(first)).select(*[F.col(first).getField(x).alias(x) for x in docs.columns])
    return tagged.where(F.col(g).isNull()).select(*cols).unionByName(kept)
