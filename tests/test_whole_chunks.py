"""pack_chunks against a plain fold, with conversations longer than a chunk."""

import collections

from hushframe import registry


def test_long_conversations_are_split(spark, tmp_path):
    rows = [(1, k, "u", "x" * (500 + 37 * (k * 7919 % 40))) for k in range(150)] + [(2, 0, "u", "y" * 48_000), (2, 1, "u", "z"), (3, 0, "u", "short")] + [(4, k, "u", "w" * 24_000) for k in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want, at = collections.Counter(), {}
    for c, _, _, t in sorted(rows):
        chunk, size = at.get(c, (0, 0))
        chunk, size = (chunk + 1, len(t)) if size + len(t) > 48_000 else (chunk, size + len(t))
        at[c] = chunk, size
        want[c, chunk] += 1
    assert max(chunk for c, chunk in want if c == 1) >= 2
    got = {(r.conv_id, r.chunk): r.n for r in registry.QUERIES["pack_chunks"](spark, str(tmp_path)).collect()}
    assert got == dict(want)
