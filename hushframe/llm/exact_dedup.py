"""Operator 7: exact dedup by 128-bit content hash, with bytes compared inside groups.

1. Each text becomes its MD5 (16 bytes). Only hashes are shuffled, and counted with
   map-side combination: hashes held by one row can't be copies.
2. Only rows whose hash occurs more than once are grouped by (hash, text): grouping by the
   text as well compares all bytes, so texts that only collide in the hash stay apart. A
   row is the smallest of its group by (id, nulls last, remaining columns); partial
   aggregation leaves one row a group and task, so a group of any number of copies never
   meets in one task.

The repeated hashes are broadcast while they are at most ``BROADCAST_HASHES`` (checked by
count, about 100 bytes each); beyond that both sides are joined by shuffle on the hash.

Edges: rows with a null text hold no content and are all kept; the empty text is content
like any other, and a very long one is hashed and compared whole. An empty table gives no rows. A null id is larger than any id. Of repeated rows, equal in id and text,
one stays: the smallest by its remaining columns as JSON. Extra columns are carried along,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare, written

#: Most repeated hashes that are broadcast.
BROADCAST_HASHES = 200_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_hashes: int = BROADCAST_HASHES, copies: bool = False) -> DataFrame:
    """The rows of docs that stay, in its columns; with ``copies`` also ``n_copies`` and ``content_hash``."""
    h, g, n, rest, first = spare(docs, "content_hash", "repeated_hash", "n_copies", "rest", "first")
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    digest = F.unhex(F.md5(text.cast("binary")))
    counted = docs.where(text.isNotNull()).groupBy(digest.alias(g)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(g)
    repeated = written(counted, "repeated-hashes")
    if repeated.count() <= broadcast_hashes:
        repeated = F.broadcast(repeated)
    others = [c for c in docs.columns if c != text_col]
    tagged = docs.withColumn(h, digest).join(repeated, F.col(h) == F.col(g), "left")
    single = tagged.where(F.col(g).isNull()).select("*", F.lit(1).cast("long").alias(n))
    order = F.struct(key.isNull(), key, F.to_json(F.struct(*[F.col(f"`{c}`") for c in others if c != id_col])) if len(others) > 1 else F.lit(""))
    grouped = (
        tagged.where(F.col(g).isNotNull())
        .groupBy(h, text.alias(text_col))
        .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), order).alias(first), F.count(F.lit(1)).alias(n))
    )
    pick = [text.alias(c) if c == text_col else F.col(first).getField(c).alias(c) for c in docs.columns]
    more = [F.col(n).alias("n_copies"), F.lower(F.hex(F.col(h))).alias("content_hash")] if copies else []
    return single.select(*[F.col(f"`{c}`") for c in docs.columns], *more).unionByName(grouped.select(*pick, *more))
