"""Detector patterns, put together from parts that mean the same to Java, `regex` and RE2 readers.

Boundaries are ASCII: a letter outside A-Z, a-z, 0-9 and _ doesn't count as part of a word. White
space is spelled out, because engines differ on it. ``java`` patterns never use backslash
classes for words, digits or space.
"""

from __future__ import annotations

from dataclasses import dataclass

SPACE = r"\t\n\x0B\f\r    -     　﻿"
S = f"[{SPACE}]"
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
EDGE = f"(?:(?<=[A-Za-z0-9_]){RIGHT}|{LEFT}(?=[A-Za-z0-9_]))"
D = "[0-9]"
_W = "[A-Za-z0-9_]"
# A digit that begins a word. Engines search for a pattern's first character, so it comes before what must not precede it.
_START = f"{D}(?<!{_W}{D})"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_ENDINGS = "gatan vägen gränd gränden torget stigen backen allén gången kajen stranden terrassen leden stråket plan gata väg".split()
_PLATE = "[A-HJ-PR-UW-Z]"


def _either(words, upper: bool = False) -> str:
    return "(?:" + "|".join(w.upper() if upper else w for w in words) + ")"


@dataclass(frozen=True)
class Pattern:
    label: str
    regex: str
    group: int = 0
    check: str | None = None  # a name in validators.CHECKS


_NUMBER_TAIL = f"(?:[{SPACE}-]{{0,3}}{D})"
_ACCOUNT = _either(["bankkonto", "kontonummer", "utbetalningskonto", "konto"])
_JOURNAL = _either(["journalnummer", "journalnr", "journal-id", "journalid"])
_AN = r"[\p{L}\p{N}]"

PATTERNS: dict[str, Pattern] = {
    "organisation": Pattern("ORGANISATIONSNUMMER", f"{_START}{D}{{5}}(?:{S}{{1,2}}-{S}?|-{S}?)?{D}{{4}}{RIGHT}", check="organisation"),
    "email": Pattern("EPOST", rf"(?iu)[\p{{L}}\p{{N}}._%+-]{{1,64}}@[\p{{L}}\p{{N}}.-]{{1,255}}\.\p{{L}}{{2,63}}{EDGE}"),
    "phone": Pattern(
        "TELEFON",
        rf"[+0](?<![0-9][+0])(?:(?<=\+)46[{SPACE}-]?(?:\(0\)[{SPACE}-]?)?(?:7[02369]|[1-9]{D}?){_NUMBER_TAIL}{{6,8}}|(?<=0)(?:7[02369]|[1-9]{D}?){_NUMBER_TAIL}{{6,8}}|(?<=\+){D}{{1,3}}{_NUMBER_TAIL}{{6,12}}){RIGHT}",
    ),
    "postcode": Pattern(
        "POSTNUMMER",
        f"[1-9]{D}{{2}}(?:(?<!{_W}[1-9]{D}{{2}})(?:{S}{D}{{2}}{RIGHT}|{D}{{2}}{RIGHT}(?={S}+[A-ZÅÄÖ]))|(?:(?<={LEFT}SE[1-9]{D}{{2}})|(?<={LEFT}SE-[1-9]{D}{{2}})){S}?{D}{{2}}{RIGHT})",
    ),
    "bankgiro": Pattern("BANKGIRO", f"{_START}{D}{{2,3}}{S}{{0,2}}-{S}{{0,2}}{D}{{4}}{RIGHT}", check="luhn"),
    "plusgiro": Pattern("PLUSGIRO", f"{_START}(?:{S}?{D}){{1,6}}{S}{{0,2}}-{S}{{0,2}}{D}{RIGHT}", check="luhn"),
    "iban": Pattern("IBAN", f"(?i){LEFT}SE{D}{{2}}(?:{S}?{D}){{20}}{RIGHT}"),
    "account": Pattern("KONTONUMMER", rf"(?iu)(?:^|[^\p{{L}}\p{{N}}]){_ACCOUNT}(?:{S}+nr\.?)?{S}*[:#-]?{S}*((?:{D}[ -]?){{6,19}}{D}){RIGHT}", 1, "account"),
    "journal": Pattern("JOURNALNUMMER", rf"(?iu)(?:^|[^\p{{L}}\p{{N}}]){_JOURNAL}{S}*[:#-]?{S}*((?:{_AN}{{2,12}}[-/]){{1,3}}{_AN}{{2,12}}|{D}{{5,20}}){EDGE}", 1),
    "card": Pattern("KORTNUMMER", f"{_START}(?:[ -]?{D}){{12,18}}{RIGHT}", check="card"),
    "ip": Pattern("IP_ADRESS", rf"(?={D}){LEFT}(?:{_OCTET}\.){{3}}{_OCTET}{RIGHT}"),
    "url": Pattern("URL", rf'(?i){LEFT}(?:https?://|www\.)[^{SPACE}<>")]*[^{SPACE}<>").,;:!?]'),
    "address": Pattern(
        "ADRESS",
        f"(?:^|[^A-Za-zÅÄÖåäö0-9])((?:(?:[A-ZÅÄÖ][a-zåäö]+{S})?[A-ZÅÄÖa-zåäö][a-zåäö]*{_either(_ENDINGS)}|[A-ZÅÄÖ]+{_either(_ENDINGS, True)}){S}?{D}{{1,3}}[A-Za-z]?){RIGHT}",
        1,
    ),
    "apartment": Pattern("LAGENHETSNUMMER", rf"(?iu){LEFT}(?:lgh|lägenhet)\.?{S}?{D}{{2,4}}{RIGHT}"),
    "plate": Pattern("REGNUMMER", f"{LEFT}{_PLATE}{{3}}{S}?{D}{{2}}[A-HJ-PR-UW-Z0-9]{RIGHT}", check="plate"),
}
#: Runs that the window scanner looks into.
DIGIT_RUN = r"[0-9](?:(?:[0-9+-]|[ \t  ]{1,2}(?=[0-9+-]))*[0-9])?"

DEFAULT = ["email", "url", "personal", "coordination", "organisation", "iban", "card", "bankgiro", "plusgiro", "phone", "postcode", "ip"]
CONTEXTUAL = ["account", "journal"]
HEURISTIC = ["address", "apartment", "plate"]
HYBRID = [*DEFAULT, *CONTEXTUAL, "address", "apartment"]
LABELS = {"personal": "PERSONNUMMER", "coordination": "SAMORDNINGSNUMMER"} | {k: p.label for k, p in PATTERNS.items()}
#: Which of two labels takes a span that both have; 5 if not named.
PRIORITY = {"JOURNALNUMMER": -10, "KONTONUMMER": -10, "TELEFON": 0, "PERSONNUMMER": 10, "SAMORDNINGSNUMMER": 11}
