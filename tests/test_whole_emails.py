"""detect_email and assign_placeholders with signs that fold to '@'."""

import pytest

from hushframe import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("emails"))
    docs = [(1, "Write to anna＠example.com or bo﹫example.com"), (2, "cy@example.com"), (3, "none"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_emails_with_other_signs(spark, folder):
    got = sorted((r.doc_id, r.value) for r in registry.QUERIES["detect_email"](spark, folder).collect())
    assert [d for d, _ in got] == [1, 1, 2]
    every = registry.QUERIES["detect_all"](spark, folder).where("label = 'EPOST'").collect()
    assert got == sorted((r.doc_id, r.value) for r in every)


def test_placeholders_with_other_signs(spark, folder):
    got = registry.QUERIES["assign_placeholders"](spark, folder).collect()
    assert sorted((r.doc_id, r.n, r.replacement) for r in got) == [(1, 1, "[EPOST_1]"), (1, 2, "[EPOST_2]"), (2, 1, "[EPOST_1]")]
