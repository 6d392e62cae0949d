"""Redaction of text streams: a stateless map, and counts of findings in event-time windows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.patterns import DEFAULT
from ..operators.detect import detect_udf
from ..operators.redact import redact


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def redacted(stream: DataFrame, text: str = "text", names: Iterable[str] = tuple(DEFAULT)) -> DataFrame:
    """The stream's rows with their text redacted; the map to restore it doesn't travel with it."""
    return stream.withColumn(text, redact(F.col(text), names)["text"])


def findings(stream: DataFrame, ts: str, text: str = "text", window: str = "10 minutes", late: str = "30 minutes", names: Iterable[str] = tuple(DEFAULT)) -> DataFrame:
    """(start, label, n) of findings in event-time windows; rows later than the watermark are left out."""
    spans = stream.withWatermark(ts, late).select(ts, F.explode(detect_udf(names)(F.col(text))).alias("s"))
    return spans.groupBy(F.window(ts, window).alias("w"), F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "label", "n")


def write_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Everything there is, once; a later call goes on where this one ended."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
