"""Converters, augmenters and readers, against plain expectations."""

import bz2

import pytest

from hushframe.functions import text as tx
from hushframe.operators import corpus as co
from hushframe.operators import score as sc
from hushframe.operators import training as tr
from hushframe.sources import readers as rd


def test_fillers_and_word_pieces(spark):
    df = spark.createDataFrame([('  "Hej,  Åsa_1!" (o-k) ... ',), ("",), (None,)], "t string")
    assert [r.x for r in df.select(tx.tokenize_filler(df.t).alias("x")).collect()] == [['"', "Hej", ",", "Åsa_1", "!", '"', "(", "o-k", ")", ".", ".", "."], [], None]
    words = spark.createDataFrame([("Berglund",), ("Bergx",), ("Berg",), ("",), (None,)], "w string")
    vocab = ["Berg", "B", "##lund", "##l", "##und", "##er"]
    assert [r.x for r in words.select(tx.wordpiece(words.w, vocab).alias("x")).collect()] == [["Berg", "##lund"], None, ["Berg"], [], None]
    names = spark.createDataFrame([("Berglund",), ("Berg",), ("Bergx",)], "name string")
    assert [(r.name, r.pieces) for r in co.decomposed_absent(names, spark.createDataFrame([("en text",)], "text string"), vocab).collect()] == [("Berglund", ["Berg", "##lund"])]


def test_character_spans_to_tags(spark):
    token, span = "array<struct<start:int,end:int>>", "array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame([([(0, 4), (5, 9), (10, 12)], [(0, 9, "PER")]), ([(0, 2)], None), (None, [])], f"k {token}, s {span}")
    assert [r.x for r in df.select(tr.char_spans_to_bio(df.k, df.s).alias("x")).collect()] == [["B-PER", "I-PER", "O"], ["O"], None]
    for bad in ([(0, 3, "PER")], [(4, 5, "PER")], [(0, 4, "PER"), (0, 9, "LOC")]):
        with pytest.raises(Exception, match="entit"):
            spark.createDataFrame([([(0, 4), (5, 9)], bad)], f"k {token}, s {span}").select(tr.char_spans_to_bio(tr.F.col("k"), tr.F.col("s"))).collect()


def test_class_conversion(spark):
    rows = [(1, ["Bo", "Ek", "i", "kommun"], ["B-Artist", "I-Artist", "O", "B-Place"]), (2, ["x"], ["B-Software"]), (3, ["flu"], ["B-Disease"]), (4, ["Nya", "kommun", "Bo"], ["B-Place", "I-Place", "I-Artist"]), (5, [], []), (6, ["kommun", "kommun"], ["B-Place", "B-Place"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, tags array<string>")
    args = {"Artist": "PER", "Place": "LOC"}, {"Software"}, {"Disease"}, {"kommun"}
    got = {r.id: r.tags for r in tr.convert_classes(df, *args).collect()}
    assert got == {1: ["B-PER", "I-PER", "O", "O"], 3: ["O"], 4: ["B-LOC", "I-LOC", "B-PER"], 5: [], 6: ["O", "O"]}
    with pytest.raises(Exception, match="isn't mapped"):
        tr.convert_classes(spark.createDataFrame([(1, ["x"], ["B-New"])], df.schema), *args).collect()


def test_case_augmentation(spark):
    df = spark.range(4000).selectExpr("id", "array('Bo', concat('Ek', id), '!') AS tokens", "array('B-PER', 'I-PER', 'O') AS tags")
    rows = tr.augment_cases(df, "id", drop_mark=0.5).collect()
    lower, upper = sum(r.tokens[0] == "bo" for r in rows) / 4000, sum(r.tokens[0] == "BO" for r in rows) / 4000
    assert len(rows) == 4000 and 0.32 < lower < 0.38 and 0.035 < upper < 0.065 and 0.45 < sum(len(r.tokens) == 2 for r in rows) / 4000 < 0.55
    assert all(len(r.tokens) == len(r.tags) for r in rows)
    same = tr.augment_cases(spark.range(50).selectExpr("id", "array('bo') AS tokens", "array('O') AS tags"), "id", upper=0.0)
    assert same.count() == 1


def test_release_figures(spark):
    c = spark.createDataFrame([("a", 3, 2, 1), ("b", 4, 4, 0)], "category string, entities int, hits int, junk int")
    assert [tuple(r) for r in sc.category_sums(c, {"care": ["a", "b"]}).collect()] == [("care", 7, 6, 1)]
    with pytest.raises(Exception, match="missing"):
        sc.category_sums(c, {"care": ["a", "z"]}).collect()
    assert sc.snapshot(spark.createDataFrame([(5, 0.98765)], "n int, recall double")).first().asDict() == {"n": 5, "recall_pct": 98.8}


def test_manifest_and_its_check(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, t string")
    m = tr.manifest(df, ["i", "t"])
    assert tuple(m.first()) == tuple(tr.manifest(df.repartition(3).orderBy(tr.F.desc("i")), ["i", "t"]).first()) and m.first().n == 3
    assert tr.manifest(df.distinct(), ["i", "t"]).first().sha256 != m.first().sha256
    assert tr.unverified(df, ["i", "t"], m).count() == 0 and tr.unverified(df.limit(2), ["i", "t"], m).count() == 1
    assert tr.manifest(df.where("false"), ["i", "t"]).first().n == 0


def test_names_of_held_out_rows(spark):
    df = spark.createDataFrame([("Hos ANNA",), ("Hanna",), ("ingen",), (None,), ("İanna",)], "t string")
    names = spark.createDataFrame([("Anna",), ("anna",), (None,), ("",)], "name string")
    assert [r.t for r in tr.without_held_out(df, "t", names).collect()] == ["ingen", None]
    assert tr.without_held_out(df, "t", names.where("false")).count() == 5


def test_sentence_streams_and_lists(spark, tmp_path):
    words = lambda ws: "".join(f'<token x="1">{w}</token>\n' for w in ws)
    good, few, link = ["Hej", "på", "dig", "&lt;3", "!"], ["Hej", "!"], ["se", "min", "sida", "http://x"]
    xml = "<corpus>\n" + "".join(f'<sentence id="{i}">\n{words(w)}</sentence>\n' for i, w in enumerate([good, few, link] * 50)) + "</corpus>\n"
    (tmp_path / "c.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    rows = rd.read_sentence_stream(spark, str(tmp_path / "c.xml.bz2"), "web").collect()
    assert len(rows) == 50 and all((r.tokens, r.src) == (["Hej", "på", "dig", "<3", "!"], "web") for r in rows)
    assert rd.read_sentence_stream(spark, str(tmp_path / "c.xml.bz2"), "web", most=7).count() == 7
    (tmp_path / "l.xml").write_text('<L><LexicalEntry><feat att="writtenForm" val="by"/><feat att="partOfSpeech" val="nn"/></LexicalEntry><LexicalEntry></LexicalEntry></L>')
    assert [tuple(r) for r in rd.read_lexicon_xml(spark, str(tmp_path / "l.xml")).collect()] == [("by", "nn")]
    (tmp_path / "r.txt").write_text("och 99\n\ni 50\n")
    assert sorted(tuple(r) for r in rd.read_ranks(spark, str(tmp_path / "r.txt")).collect()) == [("i", 2), ("och", 1)]


def test_survival_of_characters(spark):
    got = sc.survival("Ring Anna-Lo på 070 nu", "Ring [NAMN_1] på 0[X_1] nu", ["anna-lo", "på 070", "Ring", "070"])
    assert [(r["material"], r["retained"], r["outcome"]) for r in got] == [(6, 0, "hit"), (5, 3, "partial"), (4, 4, "miss"), (3, 1, "partial")]
    for text, masked, values in (("a b", "b a", ["a"]), ("a b", "a b", ["c"]), ("a - b", "a - b", [" - "])):
        with pytest.raises(ValueError):
            sc.survival(text, masked, values)
    df = spark.createDataFrame([("Anna", "[NAMN_1]", ["Anna"]), (None, "x", []), ("a", "a", None)], "t string, m string, v array<string>")
    assert [r.s and [tuple(x) for x in r.s] for r in df.select(sc.surviving(df.t, df.m, df.v).alias("s")).collect()] == [[("Anna", 4, 0, "hit")], None, []]


def test_redactions_that_nothing_asks_for(spark):
    rows = [(1, "NAMN", "Anna Berg"), (1, "NAMN", "anna"), (1, "POSTNUMMER", "123 45"), (1, "PLATS", "Umeå!"), (1, "TELEFON", "070"), (2, "NAMN", "Bo"), (2, "NAMN", "Bo")]
    found = spark.createDataFrame(rows, "doc_id int, label string, value string")
    expected = spark.createDataFrame([(1, "(umeå) kommun"), (1, "Bo")], "doc_id int, value string")
    got = sorted((r.doc_id, r.value, r.classification) for r in sc.unannotated(found, expected).collect())
    assert got == [(1, "070", "candidate"), (1, "123 45", "postcode"), (1, "Anna Berg", "name-like"), (1, "anna", "candidate"), (2, "Bo", "candidate"), (2, "Bo", "candidate")]
