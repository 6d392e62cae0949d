"""Checks of identifiers, as Python functions for Arrow workers and as Column expressions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENCIES = frozenset("SEK USD EUR NOK DKK GBP CHF JPY ISK".split())
_SHAPE = re.compile(r"([0-9]{2})?([0-9]{2})([0-9]{2})([0-9]{2})[-+]?([0-9]{4})")
_DIGITS = re.compile(r"[^0-9]")
_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def digits_of(s: str) -> str:
    return _DIGITS.sub("", s)


def luhn(s: str) -> bool:
    d = digits_of(s)
    odd = sum(map(int, d[-1::-2]))
    even = sum(2 * int(c) - 9 * (c > "4") for c in d[-2::-2])
    return bool(d) and (odd + even) % 10 == 0


def days_in_month(year: int, month: int) -> int:
    return _DAYS[month - 1] + (month == 2 and year % 4 == 0 and (year % 100 != 0 or year % 400 == 0))


def _date_shape(s: str, shift: int) -> bool:
    m = _SHAPE.fullmatch(s)
    if not m:
        return False
    month, day = int(m[3]), int(m[4]) - shift
    return 1 <= month <= 12 and 1 <= day <= days_in_month(int((m[1] or "") + m[2]), month)


def personal_shape(s: str) -> bool:
    return _date_shape(s, 0)


def coordination_shape(s: str) -> bool:
    return _date_shape(s, 60)


def personal(s: str) -> bool:
    return personal_shape(s) and luhn(digits_of(s)[-10:])


def coordination(s: str) -> bool:
    return coordination_shape(s) and luhn(digits_of(s)[-10:])


def organisation(s: str) -> bool:
    d = digits_of(s)
    if len(d) == 12 and d.startswith("16"):
        d = d[2:]
    return len(d) == 10 and d[2] >= "2" and luhn(d)


CHECKS = {
    "luhn": luhn,
    "organisation": organisation,
    "card": lambda s: 13 <= len(digits_of(s)) <= 19 and luhn(s),
    "account": lambda s: 7 <= len(digits_of(s)) <= 20,
    "plate": lambda s: s[:3] not in CURRENCIES,
}


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_valid(c: Column) -> Column:
    """V1; null for null."""
    return F.call_function("luhn_check", only_digits(c))


def month_days(year: Column, month: Column) -> Column:
    """V2 on integers; a two-digit year counts as the year of that number."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _shape(c: Column, shift: int) -> Column:
    part = lambda k: F.regexp_extract(c, r"^([0-9]{2})?([0-9]{2})([0-9]{2})([0-9]{2})[-+]?([0-9]{4})$", k)
    fits = c.rlike(r"\A([0-9]{2})?[0-9]{6}[-+]?[0-9]{4}\z")
    year, month = F.concat(part(1), part(2)).try_cast("int"), part(3).try_cast("int")
    day = part(4).try_cast("int") - shift
    return fits & F.coalesce(month.between(1, 12) & (day >= 1) & (day <= month_days(year, month)), F.lit(False))


def personal_shape_valid(c: Column) -> Column:
    return _shape(c, 0)


def coordination_shape_valid(c: Column) -> Column:
    return _shape(c, 60)


def personal_valid(c: Column) -> Column:
    return _shape(c, 0) & luhn_valid(F.right(only_digits(c), F.lit(10)))


def coordination_valid(c: Column) -> Column:
    return _shape(c, 60) & luhn_valid(F.right(only_digits(c), F.lit(10)))


def organisation_valid(c: Column) -> Column:
    d = only_digits(c)
    core = F.when((F.length(d) == 12) & d.startswith("16"), F.substring(d, 3, 10)).otherwise(d)
    return (F.length(core) == 10) & (F.substring(core, 3, 1) >= "2") & luhn_valid(core)


def card_valid(c: Column) -> Column:
    return F.length(only_digits(c)).between(13, 19) & luhn_valid(c)


#: Telephone numbers kept for fiction, first and last in national form.
FICTION_PHONES = (("0980319200", "0980319299"), ("0846500400", "0846500499"), ("0701740605", "0701740699"), ("0406280400", "0406280499"), ("0313900600", "0313900699"))
#: Numbers that their owners publish for tests, as digits (letters kept in an IBAN), by label.
TEST_VALUES: dict[str, frozenset[str]] = {
    "PERSONNUMMER": frozenset("200203012398 199912012391 199001012385 198506232381 198506012387 197811012397 196408233234 190001019801".split()),
    "SAMORDNINGSNUMMER": frozenset({"197001782395", "196403722397"}),
    "ORGANISATIONSNUMMER": frozenset({"2021004748"}),
    "IBAN": frozenset({"SE4280000890119146168423"}),
    "BANKGIRO": frozenset({"9912346", "09912346"}),
    "PLUSGIRO": frozenset({"9201005"}),
    "KONTONUMMER": frozenset({"3300003232323232"}),
    "KORTNUMMER": frozenset({"4242424242424242"}),
    "POSTNUMMER": frozenset({"12345"}),
}
_KEPT_IP = r"\A(?:10|127|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|192\.0\.2|198\.51\.100|203\.0\.113)(?:\.[0-9]{1,3})+\z"
_KEPT_DOMAIN = r"@(?:[^@]*\.)?(?:example\.(?:com|net|org)|test)\z"


def approved_ip(c: Column) -> Column:
    """V8: an address of a private network, of the machine itself, or of the ranges kept for documentation."""
    return c.rlike(_KEPT_IP)


def approved_email(c: Column) -> Column:
    """V8: an address at a domain kept for examples."""
    return F.lower(c).rlike(_KEPT_DOMAIN)


def approved_phone(c: Column) -> Column:
    """V8: a number of the ranges kept for fiction, written with or without the country's code."""
    d = only_digits(c)
    rest = F.substring(d, 3, 30)
    national = F.when(F.trim(c).startswith("+46"), F.when(rest.startswith("0"), rest).otherwise(F.concat(F.lit("0"), rest))).otherwise(d)
    inside = [(F.length(national) == len(a)) & national.between(a, b) for a, b in FICTION_PHONES]
    return functools.reduce(lambda x, y: x | y, inside)


def approved_test_value(value: Column, label: Column) -> Column:
    """V8: a published test number of the label's kind; personal numbers with or without their century, organisations' with or without 16."""
    d = only_digits(value)
    out = F.lit(False)
    for name, values in TEST_VALUES.items():
        own = F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", "")) if name == "IBAN" else F.when((F.length(d) == 12) & d.startswith("16"), F.substring(d, 3, 10)).otherwise(d) if name == "ORGANISATIONSNUMMER" else d
        each = sorted({v[k:] for v in values for k in ((0, 2) if name in ("PERSONNUMMER", "SAMORDNINGSNUMMER") else (0,))})
        out = F.when(label == name, own.isin(*each)).otherwise(out)
    return out


def iso_date_valid(c: Column) -> Column:
    """V9: a real calendar date that reads back as it was written."""
    return F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "yyyy-MM-dd") == c, F.lit(False))


COLUMN_CHECKS = {
    "luhn": luhn_valid,
    "organisation": organisation_valid,
    "card": card_valid,
    "account": lambda c: F.length(only_digits(c)).between(7, 20),
    "plate": lambda c: ~F.substring(c, 1, 3).isin(*sorted(CURRENCIES)),
}
