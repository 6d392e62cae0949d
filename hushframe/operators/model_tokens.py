"""From a tagger's tokens to spans, and the merge of its spans with those of rules.

A recognizer is any object with ``detect(texts) -> list of lists of spans``; ``recognize`` runs one
per worker process. ``gazetteer`` stands in for a model where none is at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.patterns import HYBRID, S
from ..functions.text import safe_lower_text as safe_lower
from .detect import CUSTOM, FIELDS, SPAN, detect_text, install
from .redact import RESULT, redact_found, results

_LETTER = regex.compile(r"[\p{L}\p{N}]")
_LETTERS, _NUMBERS = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
_AN = r"[\p{L}\p{N}]"
_END = f"(?!{_AN})"
#: What may follow a street: its number, perhaps with a letter.
_NUMBER = r"\s+(?:nr\s+)?[0-9]{1,4}(?:\s?[A-Da-d])?"
HOUSE_NUMBER = regex.compile(_NUMBER + _END)
_ENTRANCE = regex.compile(rf"\s+[A-Da-d]{_END}")
_LABEL_WORD = regex.compile(r"(?i)[\s,;:(]{1,16}(?:org|(?:org|p|person)?nr)\.?\Z")
_STREET_TAIL = regex.compile(r"(?i)(?:gata|gatan|väg|vägen|gränd|gränden|allé|allén|torg|torget|plan)\s+\p{N}")
_NAMES = {"PER": "NAMN", "ORG": "ORGANISATION", "LOC": "PLATS", "ADR": "ADRESS"}
MOST_GAP = 32
#: How far before the middle a text is searched for white space to cut at.
LOOK_BACK = 200
_BLANK = regex.compile(S)
#: Words a tagger takes for names where names use to stand; a span that is nothing else is dropped.
DENIED = frozenset(
    """anhörig anhöriga aw bankgiro bankgirot betalkonto buss bussen butik butiken byrå byrån dotter dottern dr e-post ekonomi epost gamla goddag
    halloj handläggare handläggaren hej hejhej hejsan hälsningar iban idag igår imorgon imorse inatt ip kandidat kandidaten klient klienten konto
    kontonummer kontot kortnummer kund kunden mail maila mailade mailar mailen maka makan make maken mejl mejla mejlade mejlar mejlen mobil
    mobilnummer motpart motparten mvh olåst ombud ombudet organisationsnummer oss patient patienten penicillin personnummer plusgiro plusgirot
    postgiro referens referensen sambo sambon swish sökande sökanden tel telefon telefonnummer tjena tjenare tåg tåget vaken vd vårdcentral
    vårdcentralen""".split()
) | {"betalkonto iban"}


def split_point(text: str) -> tuple[int, int]:
    """M2: where the first part of a text ends and the second begins: they overlap around the white space that is nearest before the middle, if one is
    near, and around the middle otherwise, so that both are shorter than the whole."""
    n = len(text)
    half, lap = n // 2, min(100, n // 8)
    mid = next((i for i in range(half, max(half - LOOK_BACK, 1), -1) if i < n and _BLANK.match(text[i])), half)
    mid = mid if lap < mid and mid + lap < n else half
    return mid + lap, mid - lap


def split_points(text: Column) -> Column:
    """M2 as an expression: struct(left_end, right_start)."""
    n = F.length(text)
    half, lap = F.floor(n / 2).cast("int"), F.least(F.lit(100), F.floor(n / 8).cast("int"))
    low = F.greatest(half - LOOK_BACK + 1, F.lit(2))
    near = F.substr(text, low + 1, F.greatest(half - low + 1, F.lit(0)))
    blank = F.when(near.rlike(S), low + F.length(F.regexp_extract(near, f"(?s)\\A(.*){S}", 1))).otherwise(half)
    mid = F.when((lap < blank) & (blank + lap < n), blank).otherwise(half)
    return F.struct((mid + lap).alias("left_end"), (mid - lap).alias("right_start"))


def chunks(text: str, fits: Callable[[str], bool], offset: int = 0) -> Iterator[tuple[int, str]]:
    """M1: pieces that fit, each with its place; both parts are shorter than the whole, so this ends."""
    todo = [(offset, text)]
    while todo:
        at, part = todo.pop()
        if len(part) < 2 or fits(part):
            yield at, part
            continue
        end, start = split_point(part)
        todo += [(at + start, part[start:]), (at, part[:end])]


def label_of(group: str, names: dict[str, str | None] | None = None) -> str | None:
    """A label for a tagger's group; None drops it."""
    key = regex.sub(r"[\s_]+", "", regex.sub(r"^[BI]-", "", group or "")).upper()
    table = _NAMES | (names or {})
    if key in table:
        return table[key]
    return regex.sub(r"[^A-Z0-9-]", "", key) or "PII"


def check_score(score: float) -> float:
    """M11."""
    if not isinstance(score, (int, float)) or score != score or not 0 <= score <= 1:
        raise ValueError("min_score must be from 0 to 1")
    return float(score)


def _piece(token: dict) -> str:
    return token["word"].removeprefix("##")


def _blank(text: str, start: int, end: int) -> bool:
    return start >= end or text[start:end].isspace()


def locate(text: str, pieces: list[str]) -> list[tuple[int, int] | None] | None:
    """M5: places of all pieces of a whole stream in order, with nothing but at most ``MOST_GAP`` blanks between (None for an empty piece); None if any is missing."""
    out, at, low = [], 0, safe_lower(text)
    for p in pieces:
        word = p.removeprefix("##")
        if not word:
            out.append(None)
            continue
        i = text.find(word, at)
        if i < 0:
            i = low.find(safe_lower(word), at)
        if i < 0 or i - at > MOST_GAP or not _blank(text, at, i):
            return None
        at = i + len(word)
        out.append((i, at))
    return out


def _own_span(group: list[dict], size: int) -> tuple[int, int] | None:
    """M6: from the first token's start to the last one's end, if all tokens have places that make sense."""
    if any(t.get("start") is None or t.get("end") is None for t in group):
        return None
    s, e = group[0]["start"], group[-1]["end"]
    return (s, e) if 0 <= s < e <= size else None


def _find_group(text: str, lower: Callable[[], str], group: list[dict], cursor: int, adjacent: bool, fold: bool, gone: set) -> tuple[int, int] | None:
    """M7: the first place from the cursor on where the group's pieces stand in a row, blanks allowed before whole words.

    An adjacent group follows the token that ended at the cursor, so only blanks may be skipped to it; where that finds
    nothing the group has no place, rather than that of a like word further on. ``gone``: groups without a place from an
    earlier cursor on, which have none from this one either and needn't be sought through the rest of the text again.
    """
    words = [_piece(t) for t in group]
    if not words[0]:
        return None
    key = fold, *(t["word"] for t in group)
    if key in gone:
        return None
    hay = text
    if fold:
        hay, words = lower(), list(map(safe_lower, words))
    last = len(hay)
    if adjacent:  # further places only skip more than blanks
        near = cursor
        while near < len(text) and text[near].isspace():
            near += 1
        last = near + len(words[0])
    start = hay.find(words[0], cursor, last)
    while start >= 0:
        at = start + len(words[0])
        for t, word in zip(group[1:], words[1:]):
            if not t["word"].startswith("##"):
                n = 0
                while n < MOST_GAP and at < len(text) and text[at].isspace():
                    at, n = at + 1, n + 1
            if not word or not hay.startswith(word, at):
                break
            at += len(word)
        else:
            return start, at
        start = hay.find(words[0], start + 1, last)
    if not adjacent:
        gone.add(key)
    return None


def _past(text: str, lower: Callable[[], str], word: str, cursor: int) -> int:
    """The end of a word's place from the cursor on, or the cursor: where it has none, or only one behind other text."""
    word = word.removeprefix("##")
    if not word:
        return cursor
    if text.startswith(word, cursor):
        return cursor + len(word)
    for fold in (False, True):
        hay, w = (lower(), safe_lower(word)) if fold else (text, word)
        i = hay.find(w, cursor, cursor + MOST_GAP + len(w))
        if i >= 0 and _blank(text, cursor, i):
            return i + len(w)
    return cursor


def is_whole(text: str, s: int, e: int) -> bool:
    """M9: no letter on either side."""
    return not (s > 0 and _LETTERS.match(text[s - 1])) and not (e < len(text) and _LETTERS.match(text[e]))


def whole_word(text: Column, start: Column, end: Column) -> Column:
    """M9 as an expression."""
    letter = lambda at: F.substr(text, at, F.lit(1)).rlike(r"\A\p{L}")
    return ~(((start > 0) & letter(start)) | letter(end + 1))


def _widened(text: str, s: int, e: int, kind: str) -> tuple[int, int]:
    """Whole words, a genitive's s, and an address's number and entrance; less words that introduce an identifier."""
    while s > 0 and _LETTERS.match(text[s - 1]):
        s -= 1
    if text[e : e + 1] in ("s", "S") and not (e + 1 < len(text) and _LETTERS.match(text[e + 1])):
        e += 1
    if kind == "ADR":
        if e and _NUMBERS.match(text[e - 1]) and (m := _ENTRANCE.match(text, e)):
            e = m.end()
        if e and _LETTERS.match(text[e - 1]) and (m := HOUSE_NUMBER.match(text, e)):
            e = m.end()
    while m := _LABEL_WORD.search(text[max(s, e - 25) : e]):
        e -= len(m.group())
    return s, e


class Stream:
    """A text's tokens as columns, of which only those of entities are made into dicts."""

    __slots__ = ("words", "tags", "indexes", "ends", "token")

    def __init__(self, words: list, tags: list, indexes: list, ends: list | None, token: Callable[[int], dict]) -> None:
        self.words, self.tags, self.indexes, self.ends, self.token = words, tags, indexes, ends, token


def _stream(tokens: list[dict]) -> Stream:
    column = lambda name: [t.get(name) for t in tokens]
    return Stream(column("word"), [t.get("entity") or t.get("entity_group") for t in tokens], column("index"), column("end"), tokens.__getitem__)


def _streams(each: pa.ListArray) -> Iterator[Stream | None]:
    """A stream a row of a column of ``TOKENS``; None for null."""
    flat, cuts = each.values, each.offsets.to_pylist()
    fields = {f.name: flat.field(f.name) for f in to_arrow_type(TOKENS).value_type}
    absent = {n for n, c in fields.items() if c.null_count == len(c)}
    text = {"entity", "word"}
    for valid, a, b in zip(each.is_valid().to_pylist(), cuts, cuts[1:]):
        if not valid:
            yield None
            continue

        def column(name: str) -> list:
            c = fields[name].slice(a, b - a)
            return c.to_numpy(zero_copy_only=False).tolist() if name in text or not c.null_count else c.to_pylist()

        own = {n: None if n in absent else column(n) for n in fields}
        none = [None] * (b - a)
        token = lambda k, own=own: {n: c and c[k] for n, c in own.items()}
        yield Stream(own["word"] or none, own["entity"] or none, own["index"] or none, own["end"], token)


def _kind(tag: str) -> str:
    return tag[2:] if tag.startswith(("B-", "I-")) else tag


def _group_end(s: Stream, i: int) -> int:
    """The end of the group that begins at an entity's token."""
    kind, k = _kind(s.tags[i]), i + 1
    while k < len(s.words):
        tag = s.tags[k] or ""
        same = _kind(tag) == kind
        index, before = (n if s.indexes[n] is None else s.indexes[n] for n in (k, k - 1))
        if index != before + 1 or not (s.words[k].startswith("##") or same and (tag.startswith("I-") or tag.startswith("B-") and not _has_letter(s.words[k - 1].removeprefix("##")))):
            break
        k += 1
    return k


@lru_cache(1 << 16)
def _has_letter(word: str) -> bool:
    return bool(_LETTERS.search(word))


def reconstruct(text: str, tokens: list[dict] | Stream, min_score: float = 0.5, names: dict | None = None, denied: frozenset[str] = frozenset()) -> list[dict]:
    """M8: spans of a tagger's tokens (word, score, entity, and index, start, end where known).

    Tokens are grouped (a word's pieces, I- after its kind, B- only after a connector), edges without letters are trimmed
    (an address keeps its number), the mean score is checked, the group is placed (``_own_span``, ``_find_group``), widened
    to whole words and joined with a neighbouring part of an address. A group of one word's inner piece, or one that
    isn't whole, is dropped. ``denied``: words that are no span on their own (M4). Time is linear in the text but for
    groups that aren't adjacent and are sought further on, each different one of which reads the rest of it once at most.
    """
    check_score(min_score)
    s = tokens if isinstance(tokens, Stream) else _stream(tokens)
    words, tags, ends, size, folded, gone, labels = s.words, s.tags, s.ends, len(text), [], set(), {}

    def low() -> str:
        if not folded:
            folded.append(safe_lower(text))
        return folded[0]

    cursor, last_index, exact, out, i = 0, None, False, [], 0
    while i < len(words):
        tag = tags[i] or "O"
        if tag == "O":
            if ends is not None and ends[i] is not None:
                now = max(cursor, min(ends[i], size))
            else:
                now = _past(text, low, words[i], cursor)
            exact, cursor, last_index = now != cursor, now, s.indexes[i]
            i += 1
            continue
        kind, end = _kind(tag), _group_end(s, i)
        group = [s.token(k) for k in range(i, end)]
        i = end
        while group and not (_has_letter(_piece(group[-1])) or kind == "ADR" and _NUMBERS.search(_piece(group[-1])) and any(_has_letter(_piece(t)) for t in group[:-1])):
            group = group[:-1]
        while group and not _has_letter(_piece(group[0])):
            group = group[1:]
        if not group:
            continue
        span = None
        if sum(t["score"] for t in group) / len(group) >= min_score:
            head = group[0].get("index")
            adjacent = exact and last_index is not None and head is not None and head == last_index + 1
            span = _own_span(group, len(text)) or _find_group(text, low, group, cursor, adjacent, False, gone) or _find_group(text, low, group, cursor, adjacent, True, gone)
        if span:
            b, e = _widened(text, *span, kind)
            if kind not in labels:
                labels[kind] = label_of(kind, names)
            label = labels[kind]
            if label and e > b and is_whole(text, b, e) and not (len(group) == 1 and group[0]["word"].startswith("##")):
                out.append({"start": b, "end": e, "value": text[b:e], "label": label})
            cursor = max(cursor, e)
            exact = cursor == e == span[1]
        else:
            exact = True
            for t in group:
                now = max(cursor, min(t["end"], size)) if t.get("end") is not None else _past(text, low, t["word"], cursor)
                exact, cursor = exact and now != cursor, now
        last_index = group[-1].get("index")
    address, joined = label_of("ADR", names), []
    for d in out:
        last = joined[-1] if joined else None
        tail = address is not None and d["label"] == address and _STREET_TAIL.match(d["value"])
        if last and address and d["start"] > last["end"] and _blank(text, last["end"], d["start"]) and (tail or d["label"] == address == last["label"]):
            last["end"], last["value"] = d["end"], text[last["start"] : d["end"]]
            last["label"] = address if tail else last["label"]
        else:
            joined.append(d)
    return [d for d in joined if len(d["value"]) > 1 and d["value"].lower() not in denied]


TOKENS = T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("index", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def reconstructed(text: Column, tokens: Column, min_score: float = 0.5, names: dict | None = None, denied: Iterable[str] = ()) -> Column:
    """M8 as a column: spans of a column of texts and one of ``TOKENS``; null where either is."""
    check_score(min_score)
    denied, kind = frozenset(denied), to_arrow_type(SPAN)

    @F.arrow_udf(SPAN)
    def run(texts: pa.Array, each: pa.Array) -> pa.Array:
        # tokens become Python objects a text at a time: a batch of them takes many times the memory of its texts
        return pa.array([None if t is None or x is None else reconstruct(t, x, min_score, names, denied) for t, x in zip((t.as_py() for t in texts), _streams(each))], kind)

    return run(text, tokens)


def merge_seams(spans: list[dict], text: str) -> list[dict]:
    """M3: overlapping spans of neighbouring chunks become one with the first label."""
    out: list[dict] = []
    for d in sorted(spans, key=lambda d: (d["start"], -d["end"])):
        if out and d["start"] < out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], d["end"])
            out[-1]["value"] = text[out[-1]["start"] : out[-1]["end"]]
        else:
            out.append(dict(d))
    return out


def subtract(text: str, model: list[dict], rules: list[dict], denied: frozenset[str] = frozenset()) -> list[dict]:
    """What rule spans leave of model spans, trimmed, of more than one character."""
    cuts, out = sorted((r["start"], r["end"]) for r in rules), []
    for d in model:
        at, clipped = d["start"], False
        pieces = []
        for s, e in cuts:
            if s >= d["end"]:
                break
            if e > at:
                clipped = True
                pieces.append((at, s))
                at = max(at, e)
        pieces.append((at, d["end"]))
        for s, e in pieces:
            while s < e and not _LETTER.match(text[s]):
                s += 1
            while e > s and not _LETTER.match(text[e - 1]):
                e -= 1
            if e - s > 1 and not (clipped and text[s:e].lower() in denied):
                out.append({**d, "start": s, "end": e, "value": text[s:e]})
    return out


def hybrid(text: str, model: list[dict], names: Iterable[str], keep: Callable[[dict], bool] | None = None) -> dict:
    """Rules first, then what is left of the model's spans that ``keep`` lets through."""
    rules = detect_text(text, names)
    return redact_found(rules + subtract(text, [d for d in model if keep is None or keep(d)], rules), text)


def redact_hybrid(text: Column, model: Column, names: Iterable[str] = tuple(HYBRID)) -> Column:
    """M14 as a column: struct(text, redactions, map) of texts and a recognizer's spans (null: none), rules first."""
    names, own = list(names), {n: CUSTOM[n] for n in names if n in CUSTOM}

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        install(own)
        return results([None if t is None else hybrid(t, s or [], names) for t, s in zip(texts.to_pylist(), spans.to_pylist())])

    return run(text, model)


CARE_TERMS = frozenset({"vaken", "penicillin", "pneumoni", "hemrehab", "ordinera hemrehab", "dietist", "diabetes", "vfu huvudtrauma"})
_READINGS = "puls|bt|blodtryck|temp|temperatur|sat|saturation|spo2|hb|crp|gcs|af|na|natrium|kalium|kreatinin|troponin|glukos|p-glukos|mottagning|vårdas[ \t]+avd"
MEASURE = rf"(?i)\A(?:{_READINGS})(?![A-Za-z0-9_])[\s:=/-]*x?[0-9]"
_PART, _NAME, _AMOUNT = f"{_AN}{{2,12}}", r"\p{L}(?:\p{L}|['’-])*", "[0-9]+(?:[.,][0-9]+)?"
JOURNAL = rf"(?i)\Ajournal(?:nummer|nr)(?![A-Za-z0-9_])[\s:#-]*(?:{_PART}(?:[-/]{_PART}){{1,3}}|[0-9]{{5,20}})\z"
DOSE = rf"\A{_NAME}(?:\s+{_NAME}){{0,2}}\s+{_AMOUNT}\z"
UNIT_AFTER = r"(?i)\A\s*(?:mikrogram|mg/ml|mmol/l|mmhg|mg|ml|ie|g|[µμ]g)(?![\p{L}])"


def clinical_filter(value: Column, source: Column, after: Column | None = None, terms: Iterable[str] = CARE_TERMS) -> Column:
    """Rules stay; a model's span goes if it is a care term, a reading with its value, a journal number with its label, or a
    medicine with its dose where ``after``, the text behind the span, begins with a unit."""
    v = F.trim(value)
    bad = F.lower(v).isin(*[t.lower() for t in terms]) | F.lower(v).rlike(MEASURE) | F.lower(v).rlike(JOURNAL)
    if after is not None:
        bad = bad | (v.rlike(DOSE) & F.coalesce(F.substring(after, 1, 24).rlike(UNIT_AFTER), F.lit(False)))
    return (source == "rule") | ~bad


TOWNS = frozenset(
    """lund borås falun gävle luleå malmö umeå visby växjö kalmar kiruna motala örebro halmstad karlstad uppsala västerås borlänge alingsås
    göteborg jönköping linköping nyköping stockholm sundsvall södertälje uddevalla östersund eskilstuna härnösand karlskrona norrköping
    helsingborg hudiksvall skellefteå trollhättan kristianstad örnsköldsvik""".split()
)
STREET = r"(?i)(?:gata|gatan|väg|vägen|gränd|gränden|gången|torg|torget|plan|allén|backen|kajen|leden|stigen|stranden|stråket|terrassen)\z"


def normalised(text: Column, start: Column, end: Column, label: Column, towns: Iterable[str] = TOWNS) -> Column:
    """struct(start, end, value, label) of a model's span: an organisation in lower case that is a town is a place, and an
    address, place or organisation that ends as streets do takes a house number behind it and is an address then."""
    value = F.substring(text, start + 1, end - start)
    town = (label == "ORGANISATION") & (value == F.lower(value)) & value.isin(*towns)
    named = F.when(town, F.lit("PLATS")).otherwise(label)
    number = F.regexp_extract(F.substring(text, end + 1, 64), rf"\A({_NUMBER}){_END}", 1)
    takes = named.isin("ADRESS", "PLATS", "ORGANISATION") & value.rlike(STREET) & (number != "")
    e = F.when(takes, end + F.length(number)).otherwise(end)
    return F.struct(start.alias("start"), e.alias("end"), F.substring(text, start + 1, e - start).alias("value"), F.when(takes, F.lit("ADRESS")).otherwise(named).alias("label"))


def gazetteer(first: Iterable[str], last: Iterable[str]) -> Callable[[str], list[dict]]:
    """Names by list, longest first, whole words, case as written."""
    either = lambda w: "|".join(map(regex.escape, sorted(w, key=len, reverse=True)))
    p = regex.compile(rf"(?<!\p{{L}})(?:(?:{either(first)})(?: (?:{either(last)}))?|(?:{either(last)}))(?!\p{{L}})")
    return lambda text: [{"start": m.start(), "end": m.end(), "value": m.group(), "label": "NAMN"} for m in p.finditer(text)]


def recognize(df: DataFrame, make: Callable[[], Callable[[str], list[dict]]], text: str = "text", keys=("doc_id",)) -> DataFrame:
    """(keys, spans) by a recognizer that each task makes once and keeps for its batches."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("spans", T.ArrayType(T.StructType(FIELDS)))])

    def run(items: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = make()
        for b in items:
            out = b[list(keys)].copy()
            out["spans"] = [None if t is None else find(t) for t in b[text]]
            yield out

    return df.select(*keys, text).mapInPandas(run, schema)
