"""Operator 2: token counts by a linear longest-match automaton.

``token_counts(docs)`` gives each row's number of greedy word-piece tokens: words are
separated by white space and led by U+2581; each is split greedily into the longest pieces
of the vocabulary from left to right. The automaton of ``vocab`` reads each character once
and adds precomputed counts; no piece or id is built. A batch's words are told apart first, so
the automaton reads each of them once a batch, or not at all if a bounded memo has its count
(emptied when full, so it changes no result).

Edges: a null text has a null count, an empty or blank one 0; null ids, repeated rows and
tied ids are counted row by row; an empty table gives no rows; only the two named columns
are read, so extra columns don't matter. No row count, text length or vocabulary is capped.

One scan, no shuffle: the plan is scan -> Arrow -> result, at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, words_of
from .vocab import PIECES, SPACE, loaded


def count_tokens(text: str, path: str = PIECES) -> int:
    count = loaded(path)[1].count
    return sum(count(SPACE + w) for w in text.split())


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = PIECES) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])

    def run(items):
        auto = loaded(vocab)[1]

        class Memo(dict):
            def __missing__(self, w):
                n = auto.count(SPACE + w)
                if len(w) <= 64:
                    if len(self) >= auto.memo_words:
                        self.clear()
                    self[w] = n
                return n

        auto.memo_words = 1_000_000
        memo = auto.__dict__.setdefault("memo", Memo())
        get = memo.__getitem__
        for b in batches(items):
            words, at, n = words_of(b.column(1))
            sums = np.append(0, np.cumsum(np.fromiter(map(get, words), np.int64, len(words))[at]))
            ends = np.cumsum(n)
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums[ends] - sums[ends - n], pa.int64(), mask=null)], ["doc_id", "n_tokens"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)
