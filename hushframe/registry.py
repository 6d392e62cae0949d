"""The library's own queries and their SQL, gathered from the plans modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import corpus, detection, intervals, scoring, training

_MODULES = (detection, intervals, scoring, training, corpus)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
