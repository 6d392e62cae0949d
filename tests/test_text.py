import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.functions import patterns
from hushframe.functions import validators as v
from hushframe.functions.text import Canonical
from hushframe.operators import corpus as co
from hushframe.operators import model_tokens as mt
from hushframe.operators import redact as rd
from hushframe.operators.detect import CUSTOM, detect_text, guard_issues, invalid_id_hints, register_detector
from hushframe.sources.readers import parse_marked_up

ALL = [*patterns.DEFAULT, *patterns.CONTEXTUAL, *patterns.HEURISTIC]
HITS = [
    ("PERSONNUMMER", "pnr 900101-2385.", "900101-2385"), ("PERSONNUMMER", "x19900101 2385y", "19900101 2385"), ("PERSONNUMMER", "9001012386", "9001012386"),
    ("SAMORDNINGSNUMMER", "nr 700178-2395", "700178-2395"), ("ORGANISATIONSNUMMER", "org 202100-4748", "202100-4748"), ("EPOST", "till anna@example.com.", "anna@example.com"),
    ("EPOST", "x" * 90 + "@example.com", "x" * 90 + "@example.com"), ("TELEFON", "ring 070-174 06 05", "070-174 06 05"), ("TELEFON", "+46 (0)70 174 06 05", "+46 (0)70 174 06 05"),
    ("POSTNUMMER", "123 45 Malmö", "123 45"), ("BANKGIRO", "bg 991-2346", "991-2346"), ("PLUSGIRO", "pg 92 01 00-5", "92 01 00-5"), ("IBAN", "se42 8000 0890 1191 4616 8423", "se42 8000 0890 1191 4616 8423"),
    ("KORTNUMMER", "kort 4242 4242 4242 4242", "4242 4242 4242 4242"), ("IP_ADRESS", "ip 192.0.2.7,", "192.0.2.7"), ("URL", "se https://x.example/a?b.", "https://x.example/a?b"),
    ("KONTONUMMER", "konto nr: 1234 567 890", "1234 567 890"), ("JOURNALNUMMER", "Journalnr AB-123/45", "AB-123/45"), ("ADRESS", "bor Provdatagatan 12B nu", "Provdatagatan 12B"),
    ("LAGENHETSNUMMER", "lgh 1101", "lgh 1101"), ("REGNUMMER", "bil ABC 12D", "ABC 12D"),
]
MISSES = [("PERSONNUMMER", "901301-2385"), ("PERSONNUMMER", "850230-1234"), ("ORGANISATIONSNUMMER", "202100 4748"), ("KORTNUMMER", "4242 4242 4242 4243"), ("IP_ADRESS", "256.1.1.1"), ("REGNUMMER", "SEK 100"), ("BANKGIRO", "991-2347")]


@pytest.mark.parametrize("label,text,value", HITS)
def test_hits(label, text, value):
    assert (label, value) in [(d["label"], d["value"]) for d in detect_text(text, ALL)]


@pytest.mark.parametrize("label,text", MISSES)
def test_misses(label, text):
    assert label not in [d["label"] for d in detect_text(text, ALL)]


def test_patterns_use_no_engine_dependent_classes():
    for p in patterns.PATTERNS.values():
        assert not any(c in p.regex for c in (r"\b", r"\d", r"\w", r"\s")), p.label


def test_invisible_inside_belongs_outside_does_not():
    t = "a ​900101​-2385​ b"
    (d,) = [d for d in detect_text(t, ["personal"])]
    assert d["value"] == "900101​-2385" and t[d["start"] : d["end"]] == d["value"]


PIECES = st.lists(st.sampled_from([*"aB1 .-@[]_åÅ", "́", "​", "­", "９", "900101-2385", "anna@example.com", "4242 4242 4242 4242", "[EPOST_1]", "070-174 06 05", "192.0.2.7", "ﬁ", "\x01"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_redaction_properties(t):
    r = rd.redact_text(t)
    assert rd.restore_text(r["text"], r["map"]) == t
    ends = [-1]
    for d in r["redactions"]:
        assert d["value"] == t[d["start"] : d["end"]] and d["start"] >= ends[-1]
        ends.append(d["end"])
    assert rd.redact_text(t) == r
    assert all(tok not in t for tok in r["map"])


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_canonical_properties(t):
    c = Canonical(t)
    assert Canonical(c.text).text == unicodedata.normalize("NFKC", c.text) or not c.identity
    for s in range(0, len(c.text), 3):
        a, b = c.span(s, min(len(c.text), s + 2))
        assert 0 <= a <= b <= len(t)


def test_overlaps_and_numbers():
    t = "4242 4242 4242 4242.anna@example.com"
    assert rd.redact_text(t)["text"] == "[KORTNUMMER_1].[EPOST_1]"
    assert rd.redact_text("a@example.com b@example.com a@example.com")["text"] == "[EPOST_1] [EPOST_2] [EPOST_1]"
    with pytest.raises(ValueError):
        rd.number([], "", template="x")
    assert rd.problems([{"start": 0, "end": 2, "value": "secret", "label": "A"}], "ab")[0].count("secret") == 0


def test_custom_detector_on_a_column(spark):
    register_detector("order", "ORDER", r"order-([0-9]+)", group=1)
    df = spark.createDataFrame([("se order-77",), (None,)], "text string")
    got = [r.r for r in df.select(rd.redact(df.text, ["order"]).alias("r")).collect()]
    assert got[0].text == "se order-[ORDER_1]" and got[0].map == {"[ORDER_1]": "77"}
    CUSTOM.pop("order")


def test_validators_agree_with_python(spark):
    values = ["900101-2385", "9001012385", "700178-2395", "202100-4748", "162021004748", "850229-1234", "000229-1234", "x", "", "4242424242424242"]
    df = spark.createDataFrame([(x,) for x in values], "v string")
    cols = {"personal": v.personal_valid, "coordination": v.coordination_valid, "organisation": v.organisation_valid, "luhn": v.luhn_valid, "personal_shape": v.personal_shape_valid}
    for r in df.select("v", *[f(df.v).alias(k) for k, f in cols.items()]).collect():
        for k in cols:
            assert bool(r[k]) == getattr(v, k)(r.v), (k, r.v)


def test_hints_guard_and_marks():
    assert invalid_id_hints("901301-2385 och 900101-2385", []) == ["901301-2385"]
    assert guard_issues("mejl a@example.com, ::1 och 1234567") == ["email", "ip", "number"]
    assert parse_marked_up("<use=a arm=b> Hej [PER:Anna], i [LOC:Malmö]") == ({"use": "a", "arm": "b"}, "Hej Anna, i Malmö", [(4, 8, "PER", "Anna"), (12, 17, "LOC", "Malmö")])


def test_model_tokens():
    t = "Anna Berg bor på Provdatagatan 12 i Malmö."
    tok = [{"word": w, "entity": e, "score": s} for w, e, s in [("Anna", "B-PER", 0.9), ("Be", "I-PER", 0.9), ("##rg", "I-PER", 0.9), ("Provdatagatan", "B-ADR", 0.8), ("Malmö", "B-LOC", 0.4)]]
    assert [(d["value"], d["label"]) for d in mt.reconstruct(t, tok)] == [("Anna Berg", "NAMN"), ("Provdatagatan 12", "ADRESS")]
    with pytest.raises(ValueError):
        mt.check_score(float("nan"))
    h = mt.hybrid("Anna 900101-2385 Berg", [{"start": 0, "end": 21, "value": "Anna 900101-2385 Berg", "label": "NAMN"}], patterns.HYBRID)
    assert h["text"] == "[NAMN_1] [PERSONNUMMER_1] [NAMN_2]"
    parts = list(mt.chunks("word " * 400, lambda s: len(s) <= 300))
    assert all(len(s) <= 300 for _, s in parts) and {k for o, s in parts for k in range(o, o + len(s))} == set(range(2000))


def test_html_negotiation_and_difference():
    md = co.to_markdown("<html><nav>x</nav><h1>A</h1><p>b <a href='/c'>d</a></p><ul><li>e<li>f</ul><table><tr><th>g<th>h<tr><td>1<td>2</table><pre>k  l</pre>", "https://x.example/y")
    assert "# A" in md and "[d](https://x.example/c)" in md and "- e" in md and "| --- | --- |" in md and "k  l" in md and "x" not in md.split("#")[0]
    assert co.negotiate("text/html;q=0.5, text/markdown", ["text/html", "text/markdown"]) == "text/markdown"
    assert co.negotiate("text/html;q=0", ["text/html"]) is None
    assert co.first_difference({"a": [1, 2]}, {"a": [1, 3]}) == "$.a[1]" and co.first_difference([1], [1]) is None


def test_unapproved_identifiers():
    from hushframe.operators.detect import unapproved

    t = "ip 192.0.2.7 mejl a@example.com ring 070-174 06 05\nip 11.1.2.3 org 202100-4748"
    assert [(d["label"], d["line"]) for d in unapproved(t, known=["202100-4748"])] == [("IP_ADRESS", 2)]
    assert unapproved(t, known=["202100-4748"], protected=[(50, 65)]) == []


def test_uncovered_terms(spark):
    from hushframe.operators.training import uncovered_terms

    rows = [(["Svea", "Bolags", "x"], ["B-ORG", "I-ORG", "O"]), (["svea", "bolags"], ["B-ORG", "O"]), (["svea"], ["O"]), ([], [])]
    df = spark.createDataFrame(rows, "tokens array<string>, tags array<string>")
    assert [r.u for r in df.select(uncovered_terms(df.tokens, df.tags, [["Svea", "Bolag"]]).alias("u")).collect()] == [False, True, False, False]


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("Anna bor i Malmö sedan 1990", []),
        ("ö192.0.2.1", ["ip"]),
        ("(2001:db8::1), tid 12:30:45", ["ip"]),
        ("ring 070-174 06 05", ["number", "phone"]),  # its postal-like 174 06 is part of the number
        ("nr 19900101-0017", ["identity", "number"]),  # 0101-0017 is protected
        ("SE45 5000 0000 0583 9825 7466", ["account", "number"]),
        ("till 123 45 Ort", ["postal"]),
        ("12345 eller 070-174 06 05", ["number", "phone", "postal"]),
        ("konto: 12345-6", ["payment", "postal"]),
        ("bankgiro nr 991-2346", ["number", "payment"]),
        ("BIC: ABCDSESS", ["payment"]),
        ("hej @anna_b", ["handle"]),
        ("a@b", []),
        ("abc 12d", ["vehicle"]),
        ("åäö12é", []),
        ("aa:bB:cc:Dd:ee-ff", ["device"]),
        ("123e4567-e89b-12d3-a456-426614174000", ["number", "record"]),
        ("0x" + "aB" * 20, ["wallet"]),
        ("se WWW.exempel.se", ["url"]),
    ],
)
def test_guard_kinds(text, kinds):
    assert [k for k in guard_issues(text)] == kinds


def toks(*rows, start=1):
    """(word, entity[, score[, index]]) with indices in a row."""
    out, at = [], start
    for r in rows:
        w, e, s, i = (*r, 0.9, None)[:4] if len(r) == 2 else (*r, None)[:4]
        at = i if i is not None else at
        out.append({"word": w, "entity": e, "score": s, "index": at, "start": None, "end": None})
        at += 1
    return out


def values(text, tokens, **options):
    return [(d["value"], d["label"]) for d in mt.reconstruct(text, tokens, **options)]


def test_reconstruction_rules():
    # a later like name: adjacency and the tokens before it show which one is meant
    t = "Ring Anna. Anna är sjuk"
    d = mt.reconstruct(t, toks(("Ring", "O"), ("Anna", "O"), (".", "O"), ("Anna", "B-PER"), ("är", "O")))
    assert [(x["start"], x["value"]) for x in d] == [(11, "Anna")]
    # an adjacent group that doesn't follow the cursor has no place at all
    assert values("Bo mötte Xena och Eva", toks(("Bo", "B-PER"), ("Eva", "B-PER"))) == [("Bo", "NAMN")]
    # pieces, connectors, genitive, inner pieces, whole words
    assert values("Karl-Gustav Berglunds hus", toks(("Karl", "B-PER"), ("-", "I-PER"), ("Gustav", "B-PER"), ("Berg", "I-PER"), ("##lund", "I-PER"))) == [("Karl-Gustav Berglunds", "NAMN")]
    assert values("Sofia imorgon", toks(("Sofia", "B-PER"), ("imorgon", "B-PER"))) == [("Sofia", "NAMN"), ("imorgon", "NAMN")]
    assert values("Motpart", toks(("##par", "B-PER"))) == [] and values("Motparten", toks(("par", "B-PER"))) == []
    assert values("14:20", toks(("14", "B-PER"), (":", "I-PER"), ("20", "I-PER"))) == []
    assert values("dr Svensson", toks(("##r", "B-PER"), ("Svensson", "I-PER"))) == [("dr Svensson", "NAMN")]
    # addresses: numbers, entrances, split streets
    assert values("på Provgatan 44 C nu", toks(("Provgatan", "B-ADR"), ("44", "I-ADR"))) == [("Provgatan 44 C", "ADRESS")]
    assert values("på Provs plats nr 1 nu", toks(("Provs", "B-ADR"), ("plats", "I-ADR"))) == [("Provs plats nr 1", "ADRESS")]
    assert values("Renas gata 22", toks(("Renas", "B-ORG"), ("gata", "B-ADR"), ("22", "I-ADR"))) == [("Renas gata 22", "ADRESS")]
    # label words, scores, labels, own places, denied words
    assert values("Kommun A, org.nr 1", toks(("Kommun", "B-ORG"), ("A", "I-ORG"), (",", "I-ORG"), ("org", "I-ORG"))) == [("Kommun A", "ORGANISATION")]
    assert values("Anna", toks(("Anna", "B-PER", 0.4))) == [] and values("Anna", toks(("Anna", "B-MISC x]"))) == [("Anna", "MISCX")]
    assert values("Kund Bo", toks(("Kund", "B-PER"), ("Bo", "B-PER")), denied=mt.DENIED) == [("Bo", "NAMN")]
    own = [{**x, "start": s, "end": e} for x, (s, e) in zip(toks(("Bo", "B-PER")), [(6, 8)])]
    assert [(d["start"], d["end"]) for d in mt.reconstruct("Bo, o Bo", own)] == [(6, 8)]
    assert values("ANNA", toks(("anna", "B-PER"))) == [("ANNA", "NAMN")]
    assert values("", []) == [] and values("Anna", toks(("Anna", "B-PER")), names={"PER": None}) == []
    assert mt.locate("Anna  är Åsa", ["", "Anna", "är", "å", "##sa", ""]) == [None, (0, 4), (6, 8), (9, 10), (10, 12), None]
    assert mt.locate("Anna är", ["Anna", "var"]) is None and mt.locate("a" + " " * 40 + "b", ["a", "b"]) is None


def test_reconstruction_as_column(spark):
    rows = [("Ring Bo", [(None, 0.9, 1, "Ring", None, None), ("B-PER", 0.9, 2, "Bo", None, None)]), (None, []), ("x", None)]
    df = spark.createDataFrame(rows, "t string, k array<struct<entity:string,score:double,index:int,word:string,start:int,end:int>>")
    assert [r.s and [tuple(x) for x in r.s] for r in df.select(mt.reconstructed(df.t, df.k).alias("s")).collect()] == [[(5, 7, "Bo", "NAMN")], None, None]


def test_packing_with_ties_and_limits(spark):
    df = spark.createDataFrame([(1, "aa"), (1, "aa"), (1, "b"), (2, "ccc"), (3, None), (4, "d")], "o int, text string")
    got = [(r.o, r.text, r.chunk) for r in co.pack_chunks(df, "o", most=5).collect()]
    assert got == [(1, "aa", 0), (1, "aa", 0), (1, "b", 0), (2, "ccc", 1), (3, None, 1), (4, "d", 1)]
    with pytest.raises(Exception, match="over the limit"):
        co.pack_chunks(df, "o", most=2).collect()
    assert co.pack_chunks(df.where("false"), "o").count() == 0


def test_wide_signs_and_hosts_without_dots(spark):
    from hushframe.operators.detect import detect_text, native_spans

    assert [d["value"] for d in detect_text("anna\uff20example.com http://localhost/x", ["email", "url"])] == ["anna\uff20example.com", "http://localhost/x"]
    df = spark.createDataFrame([(1, "se http://localhost/x nu")], "doc_id int, text string")
    assert [r.value for r in native_spans(df, "url").collect()] == ["http://localhost/x"]


def test_split_points(spark):
    texts = ["", "a", "ab", "x" * 9, "word " * 300, "y" * 1000 + " z", "a " + "b" * 500, "漢" * 700, "a\u00a0b" * 200, " " * 50, "q" * 401 + " " + "q" * 398]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: tuple(r.s) for r in df.select("k", mt.split_points(df.t).alias("s")).collect()}
    for k, t in enumerate(texts):
        end, start = mt.split_point(t)
        assert got[k] == (end, start)
        assert len(t) < 2 or (end < len(t) and 0 < start <= end)
    assert mt.split_point("word " * 300)[0] - 100 == max(i for i in range(751) if ("word " * 300)[i] == " ")
    deep = "x" * 100_000
    assert sum(1 for _ in mt.chunks(deep, lambda s: len(s) < 500)) > 200
