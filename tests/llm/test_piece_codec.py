import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import piece_codec as pc
from hushframe.llm.vocab import PIECES

SF = "/root/testdata/sf0.001"
TEXT = st.text(st.one_of(st.sampled_from("aethnio  .\n\t▁Ö漢"), st.characters()), max_size=120)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=5), st.sampled_from([0.0, 0.1, 0.5, 1.0]), st.integers(0, 5))
def test_round_trip(texts, dropout, seed):
    ids, counts = pc.encode_batch(list(range(len(texts))), texts, PIECES, dropout, seed)
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert pc.decode(ids[at : at + n].tolist()) == (t or "")
        at += n


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.sampled_from([0.0, 0.2]))
def test_lockstep_and_agenda_agree_at_any_batching(texts, dropout):
    keys = [f"k{i}" for i in range(len(texts))]
    whole = pc.encode_batch(keys, texts, PIECES, dropout, 3)[0].tolist()
    single = [x for k, t in zip(keys, texts) for x in pc.encode_batch([k], [t], PIECES, dropout, 3)[0].tolist()]
    long, pc.LONG = pc.LONG, 1
    try:
        agenda = pc.encode_batch(keys, texts, PIECES, dropout, 3)[0].tolist()
    finally:
        pc.LONG = long
    assert whole == single == agenda


def test_without_dropout_it_is_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ids, counts = pc.encode_batch(list(range(len(texts))), texts, PIECES, 0.0)
    at = same = 0
    for t, n in zip(texts, counts.tolist()):
        same += ids[at : at + n].tolist() == lib.encode(t)
        at += n
    assert same == len(texts)


def test_query_is_lossless_and_seeds_differ(spark):
    import __spark_entry__ as e

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = e.queries()["op9_piece_codec"](spark, SF).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(text) and all(r.lossless and pc.decode(r.pieces) == text[r.doc_id] and r.n_pieces == len(r.pieces) for r in rows)
    again = {r.doc_id: r.pieces for r in pc.encode_pieces(docs.repartition(5), dropout=0.1, seed=20).collect()}
    other = {r.doc_id: r.pieces for r in pc.encode_pieces(docs, dropout=0.1, seed=21).collect()}
    plain = {r.doc_id: r.pieces for r in pc.encode_pieces(docs, dropout=0.0).collect()}
    assert all(again[r.doc_id] == r.pieces for r in rows)
    assert sum(other[i] != again[i] for i in again) > 0.9 * len(again)
    assert sum(map(len, again.values())) > 1.05 * sum(map(len, plain.values()))


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_edges(spark, dropout):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "a b", None), (2, None, "x"), (3, "", "x"), (4, "x" * 200_000, "y"), (5, "word " * 50_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    enc = pc.encode_pieces(df, dropout=dropout)
    got = sorted(map(tuple, pc.decode_pieces(enc).collect()), key=repr)
    assert got == sorted([(i, t) for i, t, _ in rows], key=repr)
    by = {r.doc_id: r for r in enc.collect()}
    assert by[2].pieces is None and by[2].lossless is None and by[3].pieces == []
    assert enc.where("false").count() == 0 and pc.encode_pieces(df.where("false")).count() == 0
