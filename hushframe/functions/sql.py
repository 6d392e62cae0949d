"""The library's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions import text
from ..functions.patterns import DEFAULT
from ..operators import detect, redact


class _Detect:
    def eval(self, value: str):
        if value is not None:
            for d in detect.detect_text(value, DEFAULT):
                yield d["label"], d["start"], d["end"], d["value"]


def register(spark: SparkSession) -> None:
    """canonicalize, nfkc_lower, repair_mojibake, detect_spans, privacy_issues, restore_text, and the table function detect_pii(text)."""
    for name, f in {
        "canonicalize": text.canonicalize,
        "nfkc_lower": text.nfkc_lower,
        "repair_mojibake": text.repair_mojibake,
        "detect_spans": detect.detect_udf(),
        "privacy_issues": detect.privacy_issues,
        "restore_text": redact.restore,
    }.items():
        spark.udf.register(name, f)
    spark.udtf.register("detect_pii", udtf(_Detect, returnType="label string, start int, end int, value string"))
