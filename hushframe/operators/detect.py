"""Detection of identifiers in text: one pass over Arrow batches for many detectors, expressions for one.

``spans`` folds a text, runs detectors on the folded form, and maps what they find back; values are
cut from the original. No shuffle: a scan, one Arrow step, a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.patterns import _START, _W, DEFAULT, DIGIT_RUN, EDGE, LABELS, LEFT, PATTERNS, RIGHT, SPACE, D, Pattern, S
from ..functions.text import Canonical, matches
from ..functions.validators import _KEPT_DOMAIN, _KEPT_IP, CHECKS, COLUMN_CHECKS, FICTION_PHONES, TEST_VALUES, coordination_shape, organisation, personal_shape

FIELDS = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("label", T.StringType())]
SPAN = T.ArrayType(T.StructType(FIELDS))
Found = Iterator[tuple[int, int]]
_LOCAL, _DOMAIN, _ALNUM = regex.compile(r"[\p{L}\p{N}._%+-]"), regex.compile(r"[\p{L}\p{N}.-]"), regex.compile(r"[\p{L}\p{N}]")
_RUN = regex.compile(DIGIT_RUN)
CUSTOM: dict[str, tuple[str, Callable[[str], Iterable[tuple[int, int]]]]] = {}


def windows(text: str, accept: Callable[[str], bool], widths=(12, 10)) -> Found:
    """D-W: identifiers anywhere in a run of digits, widest first; white space may only stand four digits from the end."""
    least = min(widths)
    for run in _RUN.finditer(text):
        if run.end() - run.start() < least:
            continue
        s, base = run.group(), run.start()
        at = [k for k, ch in enumerate(s) if "0" <= ch <= "9"]
        number = "".join(s[k] for k in at)
        blank = [False] + [any(ch not in "+-" for ch in s[a + 1 : b]) for a, b in zip(at, at[1:])]
        i = 0
        while i < len(number):
            for w in widths:
                if i + w <= len(number) and not any(blank[k] and k != i + w - 4 for k in range(i + 1, i + w)) and accept(number[i : i + w]):
                    yield base + at[i], base + at[i + w - 1] + 1
                    i += w
                    break
            else:
                i += 1


def _emails(text: str) -> Found:
    for m in _compiled("email").finditer(text):
        s, e = m.span()
        while s and _LOCAL.match(text[s - 1]):
            s -= 1
        while e < len(text) and _DOMAIN.match(text[e]):
            e += 1
        while e > s and not _ALNUM.match(text[e - 1]):
            e -= 1
        yield s, e


_COMPILED: dict[str, re.Pattern | regex.Pattern] = {}


def _compiled(name: str) -> re.Pattern | regex.Pattern:
    """By the engine that is faster for it: the standard one skips to a pattern's first characters, the other to characters it must have."""
    if name not in _COMPILED:
        _COMPILED[name] = (re if name in ("phone", "postcode", "address") else regex).compile(PATTERNS[name].regex)
    return _COMPILED[name]


#: What a folded text must hold for a pattern to match at all.
_NEEDS: dict[str, Callable[[str], bool]] = {"email": lambda t: "@" in t, "url": lambda t: "://" in t or "www." in t.lower(), "ip": lambda t: "." in t}


def find(name: str, text: str) -> Found:
    """Ranges that a detector finds in a folded text."""
    if name in CUSTOM:
        yield from CUSTOM[name][1](text)
        return
    if name in _NEEDS and not _NEEDS[name](text):
        return
    if name == "personal":
        yield from windows(text, personal_shape)
    elif name == "coordination":
        yield from windows(text, coordination_shape)
    elif name == "email":
        yield from _emails(text)
    else:
        p = PATTERNS[name]
        check = CHECKS.get(p.check)
        for m in _compiled(name).finditer(text):
            g = p.group if p.group and m.group(p.group) is not None else 0
            if m.group(g) and (check is None or check(m.group(g))):
                yield m.span(g)


def register_detector(name: str, label: str, pattern: str | None = None, group: int = 0, check: Callable[[str], bool] | None = None, code: Callable[[str], Iterable[tuple[int, int]]] | None = None) -> None:
    """A detector of one's own, a pattern or a function from text to ranges. Workers get it with the functions that use it."""
    if (pattern is None) == (code is None):
        raise ValueError("give either a pattern or code")
    if pattern is not None:
        compiled = regex.compile(pattern)

        def code(text: str) -> Found:
            for m in compiled.finditer(text):
                g = group if group and m.group(group) is not None else 0
                if m.group(g) and (check is None or check(m.group(g))):
                    yield m.span(g)

    CUSTOM[name] = label, code


def install(own: dict) -> None:
    """Makes detectors known in a worker, whose module has its own register."""
    CUSTOM.update(own)


def detect_text(text: str, names: Iterable[str]) -> list[dict]:
    """R1 for one text."""
    folded = Canonical(text)
    out = []
    for name in names:
        label = CUSTOM[name][0] if name in CUSTOM else LABELS[name]
        for s, e in find(name, folded.text):
            s, e = folded.span(s, e)
            out.append({"start": s, "end": e, "value": text[s:e], "label": label})
    return out


def detect_udf(names: Iterable[str] = tuple(DEFAULT)):
    """text -> array of spans of all the detectors."""
    names, own = list(names), {n: CUSTOM[n] for n in names if n in CUSTOM}
    kind = to_arrow_type(SPAN)

    @F.arrow_udf(SPAN)
    def run(texts: pa.Array) -> pa.Array:
        install(own)
        return pa.array([None if t is None else detect_text(t, names) for t in texts.to_pylist()], kind)

    return run


def spans(df: DataFrame, text: str = "text", keys: Iterable[str] = ("doc_id",), names: Iterable[str] = tuple(DEFAULT)) -> DataFrame:
    """(keys, label, start, end, value), a row a span, unresolved."""
    found = F.explode(detect_udf(names)(F.col(text))).alias("s")
    return df.select(*keys, found).select(*keys, "s.label", "s.start", "s.end", "s.value")


def native(c: Column, name: str) -> Column:
    """Array of (start, end, value) of one pattern as an expression; white-space and case folding aside, as ``find`` on that text.

    Only for patterns without a group of their own.
    """
    p: Pattern = PATTERNS[name]
    if p.group:
        raise ValueError(f"{name} takes a group; use detect_udf")
    found = matches(c, p.regex)
    if p.check:
        found = F.filter(found, lambda s: COLUMN_CHECKS[p.check](s["value"]))
    return found


def native_spans(df: DataFrame, name: str, text: str = "text", keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    hint = {"email": "@", "ip": "[.]", "url": "(?i)://|www[.]"}.get(name, "[0-9]")  # which every match holds
    return df.where(F.col(text).rlike(hint)).select(*keys, F.explode(native(F.col(text), name)).alias("s")).select(*keys, F.lit(PATTERNS[name].label).alias("label"), "s.start", "s.end", "s.value")


_HINT = regex.compile(r"(?<![0-9])(?:[0-9]{2})?[0-9]{6}[-+][0-9]{4}(?![0-9])")


def invalid_id_hints(text: str, taken: Iterable[tuple[int, int]]) -> list[str]:
    """Values shaped like a personal number with its separator that are none, outside what is redacted, each once in order."""
    out, taken = [], list(taken)
    for m in _HINT.finditer(text):
        v = m.group()
        if personal_shape(v) or coordination_shape(v) or organisation(v) or any(s < m.end() and m.start() < e for s, e in taken):
            continue
        if v not in out:
            out.append(v)
    return out


_GAP = f"[{SPACE}-]"
_LATIN = "A-ZÅÄÖåäö0-9"
_ID = f"{LEFT}(?:(?:19|20)?{D}{{6}}[-+]?{D}{{4}}|16{D}{{10}}){RIGHT}"
_ACCOUNT_SHAPE = f"(?i){LEFT}[A-Z]{{2}}{D}{{2}}(?:{_GAP}?[A-Z0-9]){{11,30}}{RIGHT}"
_HEX = "[0-9a-f]"
#: Kinds that a match alone shows. Boundaries are ASCII, as those of the detectors.
GUARD: list[tuple[str, str]] = [
    ("account", _ACCOUNT_SHAPE),
    ("email", rf"(?i)[{_LATIN}._%+-]+@[{_LATIN}.-]+\.[A-Z]{{2,}}{RIGHT}"),
    ("handle", f"(?i)(?:^|{S})@[{_LATIN}_]{{2,}}{EDGE}"),
    ("url", rf"(?i){LEFT}(?:https?://|www\.)[^{SPACE}]"),
    ("ip", PATTERNS["ip"].regex),
    ("wallet", f"(?i){LEFT}(?:(?:bc1|[13])[A-HJ-NP-Z0-9]{{25,62}}|0x{_HEX}{{40}}){RIGHT}"),
    ("record", f"(?i){LEFT}{_HEX}{{8}}-{_HEX}{{4}}-[1-5]{_HEX}{{3}}-[89ab]{_HEX}{{3}}-{_HEX}{{12}}{RIGHT}"),
    ("device", f"(?i){LEFT}{_HEX}{{2}}(?:[:-]{_HEX}{{2}}){{5}}{RIGHT}"),
    ("vehicle", rf"(?i)(?<![\p{{L}}\p{{N}}])[A-ZÅÄÖåäö]{{3}}{S}?{D}{{2}}[0-9A-Z](?![\p{{L}}\p{{N}}])"),
    ("identity", _ID),
    ("number", f"{_START}(?:[ -]?{D}){{6,18}}{RIGHT}"),
    ("payment", rf"(?i){LEFT}(?:ocr|konto|kontonummer|plusgiro|bankgiro){RIGHT}[^\n]{{0,24}}?{LEFT}{D}(?:[ -]?{D}){{4,18}}{RIGHT}"),
    ("payment", f"{LEFT}(?:BIC|SWIFT){RIGHT}{S}*[:=]?{S}+[A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?{RIGHT}"),
]
_GUARD = [(n, regex.compile(p)) for n, p in GUARD]
#: What a match must have in its text, to spare the search.
_GUARD_NEEDS = {"email": "@", "handle": "@", "ip": ".", "record": "-"}
_PROTECTED = [regex.compile(_ACCOUNT_SHAPE), regex.compile(_ID)]
_GUARD_PHONE = re.compile(rf"[+0](?<![0-9][+0])(?:(?<=\+)46{_GAP}?(?:\(0\){_GAP}?)?|(?<=0))(?:7[02369]|[1-9]{D}?)(?:{_GAP}?{D}){{6,8}}{RIGHT}")
_GUARD_POSTAL = re.compile(f"[1-9]{D}{{2}}(?<!{_W}[1-9]{D}{{2}}){S}?{D}{{2}}{RIGHT}")
_WRAPPED = "([{<\"'", "])}>\"',.;"


def _ipv6(token: str) -> bool:
    import ipaddress

    token = token.lstrip(_WRAPPED[0]).rstrip(_WRAPPED[1])
    if token.count(":") < 2:
        return False
    try:
        ipaddress.IPv6Address(token)
    except ValueError:
        return False
    return True


def guard_issues(text: str) -> list[str]:
    """The kinds of identifiers that a training text must not hold, never their values.

    A phone number counts where it lies in no account or identity number, a postal code where it is no part of a phone number.
    """
    digits = any(map(text.__contains__, "0123456789"))
    out = {n for n, p in _GUARD if (digits or n in ("email", "handle", "url", "device", "payment")) and _GUARD_NEEDS.get(n, "") in text and p.search(text)}
    if ":" in text and any(map(_ipv6, text.split())):
        out.add("ip")
    if digits:
        apart = lambda m, spans: not any(s < m.end() and m.start() < e for s, e in spans)
        phones = list(_GUARD_PHONE.finditer(text))
        if phones:
            protected = [m.span() for p in _PROTECTED for m in p.finditer(text)]
            if any(apart(m, protected) for m in phones):
                out.add("phone")
        spans = [m.span() for m in phones]
        if any(apart(m, spans) for m in _GUARD_POSTAL.finditer(text)):
            out.add("postal")
    return sorted(out)


@F.arrow_udf(T.ArrayType(T.StringType()))
def privacy_issues(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else guard_issues(t) for t in texts.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def invalid_ids(texts: pa.Array, found: pa.Array) -> pa.Array:
    """D20 as a column, of texts and their spans."""
    return pa.array([None if t is None else invalid_id_hints(t, [(s["start"], s["end"]) for s in f or ()]) for t, f in zip(texts.to_pylist(), found.to_pylist())], pa.list_(pa.string()))


def identifier_like(c: Column) -> Column:
    """A predicate for rows to drop."""
    return c.rlike(r"[0-9]{6}[-+]?[0-9]{4}|@|(?i)https?://|www\.")


def _approved(label: str, value: str) -> bool:
    """V8 for one value, as ``validators`` has it for columns."""
    digits = re.sub("[^0-9]", "", value)
    if label == "IP_ADRESS":
        return bool(_KEPT_IP_RE.match(value))
    if label == "EPOST":
        return bool(_KEPT_DOMAIN_RE.search(value.lower()))
    if label == "TELEFON":
        national = digits if not value.strip().startswith("+46") else digits[2:] if digits[2:3] == "0" else "0" + digits[2:]
        return any(len(national) == len(a) and a <= national <= b for a, b in FICTION_PHONES)
    own = re.sub("[^0-9A-Za-z]", "", value).upper() if label == "IBAN" else digits[2:] if label == "ORGANISATIONSNUMMER" and len(digits) == 12 and digits[:2] == "16" else digits
    known = TEST_VALUES.get(label, ())
    return own in known or label in ("PERSONNUMMER", "SAMORDNINGSNUMMER") and len(own) == 10 and any(v.endswith(own) for v in known)


_KEPT_IP_RE, _KEPT_DOMAIN_RE = regex.compile(_KEPT_IP.replace(r"\z", r"\Z")), regex.compile(_KEPT_DOMAIN.replace(r"\z", r"\Z"))


def unapproved(text: str, known: Iterable[str] = (), protected: Iterable[tuple[int, int]] = (), names: Iterable[str] = tuple(DEFAULT)) -> list[dict]:
    """Identifiers in a fixture that are neither of a published test range, nor known test values, nor inside a protected range; with their line."""
    from .redact import resolve  # which itself needs this module

    known, protected, out = {regex.sub(r"[^0-9A-Za-z@.]", "", k).lower() for k in known}, list(protected), []
    for d in resolve(detect_text(text, names), text):
        plain = regex.sub(r"[^0-9A-Za-z@.]", "", d["value"]).lower()
        if plain not in known and not _approved(d["label"], d["value"]) and not any(s <= d["start"] and d["end"] <= e for s, e in protected):
            out.append({"label": d["label"], "line": text.count("\n", 0, d["start"]) + 1, "start": d["start"], "end": d["end"]})
    return out
