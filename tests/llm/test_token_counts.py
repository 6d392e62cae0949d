from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm.token_counts import count_tokens, token_counts
from hushframe.llm.vocab import SPACE, loaded

SF = "/root/testdata/sf0.001"


def greedy(word):
    """Longest pieces from the left, building each."""
    pieces, bytes_ = loaded()[0].normal, loaded()[0].bytes
    out, i = [], 0
    while i < len(word):
        j = next((j for j in range(min(len(word), i + 64), i, -1) if word[i:j] in pieces), None)
        if j is None:
            out += [bytes_[b] for b in word[i].encode("utf-8", "surrogatepass")]
            j = i + 1
        else:
            out.append(pieces[word[i:j]])
        i = j
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.sampled_from("theaioning▁Ö漢"), st.characters()), max_size=30))
def test_automaton_against_greedy(word):
    auto = loaded()[1]
    assert auto.ids(word) == greedy(word)
    auto.counts.clear()
    assert auto.count(word) == len(greedy(word))


def test_query_over_all_documents(spark):
    import __spark_entry__ as e

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: sum(len(greedy(SPACE + w)) for w in r.text.split()) for r in rows}
    assert {r.doc_id: r.n_tokens for r in e.queries()["op2_token_counts"](spark, SF).collect()} == want


def test_edges(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "", None), (2, None, "x"), (3, " \t ", "x"), (4, "word " * 100_000, "y"), (5, "x" * 100_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_counts(df).collect(), key=repr)
    assert got == sorted([(i, None if t is None else count_tokens(t)) for i, t, _ in rows], key=repr)
    assert {r.n_tokens for r in got if r.doc_id in (None, 3)} == {0}
    assert token_counts(df.where("false")).count() == 0
