"""Operator 4: mixing overlapping sources to target weights by min-cost flow.

A document belongs to any number of sources; documents with the same set of sources form a
membership pattern. Only patterns reach the driver:

1. tokens are summed by pattern (distributed);
2. a min-cost flow routes each pattern's token capacity to the quotas of its sources. A
   pattern may be used ``max_epochs`` times; the e-th use of a token costs e(e-1)/2 more
   than the first, a convex price, so repetition comes only where a quota needs it and is
   spread before it is piled up. The flow is the largest possible and, of those, cheapest;
3. a pattern that carries r times its tokens gives each document floor(r) times, and one
   time more for documents in the order of a seeded hash until the fraction's tokens are
   reached. The cut in that order is found from token sums of 4096 hash ranges and then
   inside one range, so no pattern, however large, is sorted in one task.

Edges: a null source is the source "(null)"; a document without any token is neither
capacity nor cost and follows its hash; a pattern without tokens is kept once; repeated ids
share a hash and fare alike; a very long text is one document of many tokens; quotas no pattern can
fill stay unfilled; an empty table gives no rows. Extra columns are carried along, whatever their
names. The number of patterns isn't bounded: the driver holds one row for each.
"""

from __future__ import annotations

import heapq
import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, spare, written

#: Most patterns whose plan and cuts are broadcast; more are joined by shuffle.
BROADCAST_PATTERNS = 100_000


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> tuple[list[int], int, int]:
    """Flow on each arc (from, to, capacity, cost >= 0), total flow and cost.

    Primal-dual: shortest distances once a price level, then blocking flows over the arcs of that
    level, so the number of passes follows the number of prices and not that of arcs.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in arcs:
        out[u].append(len(to))
        to.append(v), cap.append(c), cost.append(w)
        out[v].append(len(to))
        to.append(u), cap.append(0), cost.append(-w)
    height, total, price = [0] * n, 0, 0
    while True:
        dist, heap = {source: 0}, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in out[u]:
                if cap[e] > 0:
                    v = to[e]
                    nd = d + cost[e] + height[u] - height[v]
                    if nd < dist.get(v, nd + 1):
                        dist[v] = nd
                        heapq.heappush(heap, (nd, v))
        if sink not in dist:
            return [cap[2 * k + 1] for k in range(len(arcs))], total, price
        far = max(dist.values())
        for v in range(n):
            height[v] += dist.get(v, far)
        while True:  # blocking flows on arcs without reduced cost
            level, queue = {source: 0}, deque([source])
            while queue:
                u = queue.popleft()
                for e in out[u]:
                    v = to[e]
                    if cap[e] > 0 and v not in level and cost[e] + height[u] == height[v]:
                        level[v] = level[u] + 1
                        queue.append(v)
            if sink not in level:
                break
            at, path, u = [0] * n, [], source
            while True:
                if u == sink:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    total, price = total + push, price + push * sum(cost[e] for e in path)
                    k = next(k for k, e in enumerate(path) if not cap[e])
                    u, path = to[path[k] ^ 1], path[:k]
                    continue
                while at[u] < len(out[u]):
                    e = out[u][at[u]]
                    if cap[e] > 0 and level.get(to[e]) == level[u] + 1 and cost[e] + height[u] == height[to[e]]:
                        break
                    at[u] += 1
                if at[u] < len(out[u]):
                    path.append(out[u][at[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


def route(patterns: list[tuple[tuple[str, ...], int]], quotas: dict[str, int], max_epochs: int) -> list[int]:
    """Tokens that each pattern (sources, tokens) carries."""
    sources = sorted(quotas)
    p, node = len(patterns), {s: 1 + len(patterns) + k for k, s in enumerate(sources)}
    sink = 1 + p + len(sources)
    arcs, mine = [], []
    for k, (members, tokens) in enumerate(patterns):
        mine.append([])
        for e in range(max_epochs):
            mine[-1].append(len(arcs))
            arcs.append((0, 1 + k, tokens, e * (e + 1) // 2))
        arcs += [(1 + k, node[s], tokens * max_epochs, 0) for s in sorted(set(members)) if s in node]
    arcs += [(node[s], sink, quotas[s], 0) for s in sources]
    flow, _, _ = min_cost_flow(sink + 1, arcs, 0, sink)
    return [sum(flow[a] for a in m) for m in mine]


def smoothed_quotas(patterns: list[tuple[tuple[str, ...], int]], budget: int, power: float) -> dict[str, int]:
    """Quotas that share the budget in proportion to a power of each source's tokens; below 1 it raises small sources and lowers large ones."""
    have: dict[str, int] = {}
    for members, tokens in patterns:
        for s in set(members):
            have[s] = have.get(s, 0) + tokens
    weight = {s: t**power if t else 0.0 for s, t in have.items()}
    whole = sum(weight.values()) or 1.0
    return {s: int(budget * w / whole) for s, w in weight.items()}


def word_count(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > 0, F.size(F.split(t, r"\s+"))).otherwise(0).cast("long")


def facets(docs: DataFrame, source: str = "source", lang: str = "lang", common: str = "en") -> Column:
    """Overlapping sources of a row: "source:x", and "lang:y" as well if its language isn't the common one.

    A row of the common language can only fill its source's quota, so a source that is large
    beyond its quota is thinned out, and small ones are repeated.
    """
    name = lambda c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("(null)")))
    other = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("(null)")) != common
    return F.when(other, F.array(name(source), name(lang))).otherwise(F.array(name(source)))


def mix(docs: DataFrame, members: Column, tokens: Column, id_col: str = "doc_id", quotas: dict[str, int] | None = None, budget_share: float = 1.0, power: float = 0.7, max_epochs: int = 4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """docs with a column of repetitions (0: left out), whose name is the first frame's last; and the plan by pattern."""
    c_pattern, c_hash, c_epochs, c_key, c_base, c_last = spare(docs, "pattern", "order", "n_epochs", "cut_pattern", "base", "last")
    pattern = F.to_json(F.array_sort(F.array_distinct(members)))
    hash_ = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"))
    slim = written(docs.select(pattern.alias("pattern"), hash_.alias("order"), tokens.alias("tokens")), "mixing")
    sums = [(r["pattern"], tuple(json.loads(r["pattern"])), int(r["tokens"] or 0)) for r in slim.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()]  # one row a pattern
    sums.sort(key=lambda r: "\x1f".join(r[1]))
    few = F.broadcast if len(sums) <= BROADCAST_PATTERNS else (lambda df: df)
    patterns = [(p, t) for _, p, t in sums]
    total = sum(t for _, t in patterns)
    want = quotas if quotas is not None else smoothed_quotas(patterns, int(total * budget_share), power)
    carried = route(patterns, want, max_epochs)
    spark = docs.sparkSession
    rows = [(p, t, f, *((f // t, f % t) if t else (1, 0))) for (p, _, t), f in zip(sums, carried)]
    plan = spark.createDataFrame(rows, "pattern string, tokens long, carried long, base long, rest long")
    small = few(plan.select("pattern", "base", "rest"))
    bucket = F.shiftright("order", 52)
    sized = slim.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("tokens").alias("t"))
    run = F.sum("t").over(Window.partitionBy("pattern").orderBy("bucket"))
    # the range in which the running sum passes the wanted rest
    cut = sized.withColumn("run", run).join(small, "pattern").where("run >= rest and run - t < rest").select("pattern", "bucket", (F.col("rest") - F.col("run") + F.col("t")).alias("left"))
    cut = written(cut, "cut-ranges")
    inside = slim.withColumn("bucket", bucket).join(few(cut), ["pattern", "bucket"]).groupBy("pattern", "order", "left").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("pattern").orderBy("order"))
    last = inside.withColumn("upto", upto).where("upto <= left").groupBy("pattern").agg(F.max("order").alias("last"))
    # no document of that range fits: everything below the range
    cuts = written(plan.join(cut, "pattern", "left").join(last, "pattern", "left").select(F.col("pattern").alias(c_key), F.col("base").alias(c_base), F.when(F.col("rest") > 0, F.coalesce("last", F.shiftleft(F.col("bucket"), 52) - 1)).alias(c_last)), "cuts")
    discard(slim, cut)
    marked = docs.withColumn(c_pattern, pattern).withColumn(c_hash, hash_).join(few(cuts), F.col(c_pattern) == F.col(c_key))
    epochs = F.col(c_base) + F.coalesce((F.col(c_hash) <= F.col(c_last)).cast("long"), F.lit(0))
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(c_pattern), epochs.alias(c_epochs)), plan


def mixed(docs: DataFrame, members: Column, tokens: Column, **options) -> DataFrame:
    """The chosen rows of docs, each as often as the mix wants it, in its columns."""
    marked, _ = mix(docs, members, tokens, **options)
    n = marked.columns[-1]
    (c_again,) = spare(docs, "again")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"`{n}`")))
    return marked.where(F.col(f"`{n}`") > 0).select(*[F.col(f"`{c}`") for c in docs.columns], again.alias(c_again)).select(*[F.col(f"`{c}`") for c in docs.columns])
