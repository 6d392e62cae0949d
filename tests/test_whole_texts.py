"""The text operators over documents' whole texts, against plain Python."""

import collections
import re
import unicodedata

import pytest
import regex

from hushframe import registry

SMALL = "/root/testdata/sf0.001"
INVISIBLE = regex.compile(r"[\p{Cf}\p{Me}͏︀-️\U000E0100-\U000E01EF⠀ᅟᅠㅤﾠ\x00-\x08\x0B\x0E-\x1F\x7F-\x9F]")
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[-'’][\p{L}\p{M}\p{N}]+)*|[^\s]")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = [(-1, "Привет мир 漢字 ｆｕｌｌ ﬁne"), (-2, None), (-3, ""), (-4, "a​b ﻿ x⁠y l'été"), (-5, "anna＠example.com och 192.0.2.7")]
    docs.where("doc_id < 60").union(spark.createDataFrame(odd, docs.schema)).repartition(8).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.mark.parametrize("name,column,fold", [("canonicalize_documents", "folded", True), ("strip_invisible_documents", "stripped", False)])
def test_folded(spark, folder, texts, name, column, fold):
    got = {r.doc_id: r[column] for r in registry.QUERIES[name](spark, folder).collect()}
    bare = {i: None if t is None else INVISIBLE.sub("", t) for i, t in texts.items()}
    assert got == {i: unicodedata.normalize("NFKC", t) if fold and t is not None else t for i, t in bare.items()}


def test_tokens(spark, folder, texts):
    want = sorted((i, m.start(), m.end(), m.group()) for i, t in texts.items() for m in TOKEN.finditer(t or ""))
    assert sorted(tuple(r) for r in registry.QUERIES["tokenize_documents"](spark, folder).collect()) == want


def test_labels_and_placeholders(spark, folder):
    labels = collections.Counter(r.label for r in registry.QUERIES["detect_all"](spark, folder).collect())
    assert labels and {r.label: r.n for r in registry.QUERIES["label_counts_documents"](spark, folder).collect()} == labels
    want = collections.Counter()
    for r in registry.QUERIES["redact_documents"](spark, folder).collect():
        want.update((r.doc_id, v) for v in re.findall(r"\[[A-ZÅÄÖ_]+_[0-9]+\]", r.redacted or ""))
    assert want and {(r.doc_id, r.value): r.n for r in registry.QUERIES["token_ranges_documents"](spark, folder).collect()} == want
