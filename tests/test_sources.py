import datetime

from pyspark.sql import functions as F

from hushframe.functions.sql import register
from hushframe.sources import readers as rd
from hushframe.streaming import redaction as sr


def test_readers(spark, tmp_path):
    (tmp_path / "a.conll").write_text("Anna B-PER\nbor 0\n\nMalmö B-LOC\n\n\n")
    rows = rd.read_conll(spark, str(tmp_path / "a.conll")).orderBy("sentence").collect()
    assert [(r.tokens, r.tags) for r in rows] == [(["Anna", "bor"], ["B-PER", "O"]), (["Malmö"], ["B-LOC"])]
    (tmp_path / "a.jsonl").write_text('{"tokens":["a"],"tags":["O"]}\n\n')
    assert rd.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 1
    (tmp_path / "s.xml").write_text('<x><sentence id="1"><name type="person"><token>A</token><token>B</token></name><token>&lt;</token></sentence></x>')
    (r,) = rd.read_sentences_xml(spark, str(tmp_path / "s.xml")).collect()
    assert (r.tokens, r.tags) == (["A", "B", "<"], ["B-person", "I-person", "O"])
    (tmp_path / "t.tsv").write_text("a\tb\n\nc\td\te\n")
    assert [len(r.fields) for r in rd.read_tsv(spark, str(tmp_path / "t.tsv")).collect()] == [2, 3]
    (tmp_path / "g.txt").write_text("# c\nHej [PER:Anna]\n")
    assert rd.read_marked_up(spark, str(tmp_path / "g.txt")).first().text == "Hej Anna"
    (tmp_path / "c1.sysA.json").write_text('{"docs":[{"text":"x","spans":[{"start":0,"end":1,"label":"A"}]}]}')
    p = rd.read_predictions(spark, str(tmp_path / "*.json")).first()
    assert (p.corpus, p.system, p.doc_ix, p.text) == ("c1", "sysA", 0, "x")
    df = spark.createDataFrame([("[time : 5 pm] go [place : here]",)], "u string")
    assert rd.without_slots(df, "u", ["place"]).count() == 0 and rd.without_slots(df, "u", ["x"]).count() == 1
    assert "| a |" in rd.write_report(df.select(F.lit(1).alias("a")), str(tmp_path / "r.md"), "R")


def test_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0, "mejl a@example.com"), (t0 + datetime.timedelta(minutes=1), "inget")], "ts timestamp, text string")
    df.write.parquet(str(tmp_path / "in"))
    s = sr.read_stream(spark, str(tmp_path / "in"), "ts timestamp, text string")
    sr.write_stream(sr.redacted(s), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"mejl [EPOST_1]", "inget"}
    q = sr.findings(sr.read_stream(spark, str(tmp_path / "in"), "ts timestamp, text string"), "ts").writeStream.format("memory").queryName("found").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.label, r.n) for r in spark.table("found").collect()] == [("EPOST", 1)]


def test_sql_names(spark):
    register(spark)
    assert spark.sql("SELECT label, value FROM detect_pii('mejl a@example.com')").collect()[0].label == "EPOST"
    assert spark.sql("SELECT canonicalize('a\\u200bb') AS c").first().c == "ab"
