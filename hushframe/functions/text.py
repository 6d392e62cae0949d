"""Canonical text with a map back to the original, and string scalars.

Offsets count code points throughout.
"""

from __future__ import annotations

import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .patterns import SPACE

INVISIBLE_CLASS = r"[\p{Cf}\p{Me}\x{034F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{2800}\x{115F}\x{1160}\x{3164}\x{FFA0}\x00-\x08\x0B\x0E-\x1F\x7F-\x9F]"
_ODD = {0x034F, 0x2800, 0x115F, 0x1160, 0x3164, 0xFFA0}


@lru_cache(1 << 16)
def invisible(ch: str) -> bool:
    c = ord(ch)
    if c in (9, 10, 12, 13):
        return False
    return c < 32 or 127 <= c < 160 or c in _ODD or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or unicodedata.category(ch) in ("Cf", "Me")


@lru_cache(1 << 16)
def _folded(unit: str) -> str:
    return unicodedata.normalize("NFKC", "".join(c for c in unit if not invisible(c)))


class Canonical:
    """The folded text, and ``span`` to map a range of it back."""

    def __init__(self, text: str) -> None:
        self.original, self.text, self.starts, self.segments = text, text, None, None
        if text.isascii() and text.isprintable() or (unicodedata.is_normalized("NFKC", text) and not any(map(invisible, set(text)))):
            return
        out, segments, size, i, n = [], [], 0, 0, len(text)
        while i < n:
            j = i + 1
            while j < n and unicodedata.category(text[j])[0] == "M":
                j += 1
            unit = text[i:j]
            new = _folded(unit)
            if new == unit:
                last = segments[-1] if segments else None
                if last and last[3] and last[2] == i:
                    last[2] = j
                else:
                    segments.append([size, i, j, True])
            elif new:
                segments.append([size, i, j, False])
            out.append(new)
            size += len(new)
            i = j
        self.text = "".join(out)
        if self.text != text:
            self.segments, self.starts = segments, [s[0] for s in segments]

    @property
    def identity(self) -> bool:
        return self.segments is None

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The original range of a canonical one: dropped characters inside it belong to it, those outside don't."""
        start, end = max(0, min(start, len(self.text))), max(0, min(end, len(self.text)))
        if self.segments is None:
            return start, max(start, end)
        if not self.segments:
            return 0, 0
        c, o, _, linear = self.segments[max(0, bisect_right(self.starts, start) - 1)]
        lo = o + (start - c if linear else 0)
        if end <= start:
            return lo, lo
        c, o, e, linear = self.segments[bisect_right(self.starts, end - 1) - 1]
        return lo, max(lo, o + (end - c) if linear else e)


def _each(texts: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """f of each text, of which one is a Python object at a time; null for null."""
    out = _Strings()
    for t in texts:
        t = t.as_py()
        out.append(None if t is None else f(t))
    return out.array()


@F.arrow_udf(T.StringType())
def canonicalize(texts: pa.Array) -> pa.Array:
    """C1 for a column: invisible characters dropped, the rest folded by NFKC."""
    return _each(texts, lambda t: Canonical(t).text)


@F.arrow_udf(T.StringType())
def nfkc_lower(texts: pa.Array) -> pa.Array:
    """C7."""
    return _each(texts, lambda t: unicodedata.normalize("NFKC", t).lower())


@F.arrow_udf(T.StringType())
def duplicate_key(texts: pa.Array) -> pa.Array:
    """NFKC, one blank for white space, lower case."""
    return _each(texts, lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).lower())


def safe_lower_text(text: str) -> str:
    low = text.lower()  # a character at a time but for the final sigma
    return low if len(low) == len(text) and "\u03a3" not in text else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@F.pandas_udf(T.StringType())
def safe_lower(texts: pd.Series) -> pd.Series:
    """Lower case, but characters stay whose lower case has another length."""
    return texts.map(lambda t: None if t is None else safe_lower_text(t))


def _byte(ch: str) -> int:
    try:
        return ch.encode("cp1252")[0]
    except UnicodeEncodeError:
        if ord(ch) in (0x81, 0x8D, 0x8F, 0x90, 0x9D):
            return ord(ch)
        raise ValueError("a character outside of the code page") from None


@F.pandas_udf(T.StringType())
def repair_mojibake(texts: pd.Series) -> pd.Series:
    """UTF-8 that was read as cp1252, read rightly; other characters are an error."""
    return texts.map(lambda t: None if t is None else bytes(map(_byte, t)).decode("utf-8"))


def strip_invisible(c: Column) -> Column:
    """C2."""
    return F.regexp_replace(c, INVISIBLE_CLASS, "")


def collapse_lower(c: Column) -> Column:
    """C6."""
    return F.trim(F.regexp_replace(F.lower(c), f"[{SPACE}]+", " "))


def surface(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def strip_punctuation(c: Column) -> Column:
    """C10."""
    return F.regexp_replace(c, r"""[.,;:!?()"']""", "")


def has_word(c: Column, literal: str) -> Column:
    """C11: the literal stands in the text with no letter or digit beside it."""
    quoted = "".join("\\" + ch if not ch.isalnum() and ch.isascii() else ch for ch in literal)
    return c.rlike(rf"(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])")


WORD = r"[\p{L}\p{M}\p{N}]+(?:[-'’][\p{L}\p{M}\p{N}]+)*|[^\s]"


def tokenize(c: Column) -> Column:
    """C14: array of (start, end, value)."""
    return matches(c, WORD)


_MATCH = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())]))


def matches(c: Column, pattern: str) -> Column:
    """Array of (start, end, value) of a pattern's matches that aren't empty, in time linear in the text (a fold of expressions would copy its result at each match).

    A text and its matches are Python objects one at a time; those of a batch would take many times its memory.
    """
    return F.arrow_udf(match_array(pattern), _MATCH)(c)


def match_array(pattern: str) -> Callable[[pa.Array], pa.Array]:
    """What ``matches`` does to an Arrow array."""
    kind = to_arrow_type(_MATCH)
    items = kind.value_type

    def run(texts: pa.Array) -> pa.Array:
        find, starts, ends, values, cuts = regex.compile(pattern).finditer, array("i"), array("i"), _Strings(), array("i", [0])
        for t in texts:
            for m in find(t.as_py() or ""):
                if m.end() > m.start():
                    starts.append(m.start()), ends.append(m.end()), values.append(m.group())
            cuts.append(len(starts))
        ints = [pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)]) for x in (starts, ends)]
        flat = pa.StructArray.from_arrays([*ints, values.array()], fields=list(items))
        null = np.append(texts.is_null().to_numpy(zero_copy_only=False), False)
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(cuts, np.int32), mask=null), flat).cast(kind)

    return run


class _Strings:
    """An Arrow array of strings in the making, as bytes."""

    def __init__(self) -> None:
        self.ends, self.data, self.valid = array("i", [0]), bytearray(), bytearray()

    def append(self, value: str | None) -> None:
        if value:
            self.data += value.encode()
        self.ends.append(len(self.data))
        self.valid.append(value is not None)

    def array(self) -> pa.Array:
        n, here = len(self.valid), None
        if 0 in self.valid:
            here = pa.array(np.frombuffer(self.valid, np.uint8).astype(bool)).buffers()[1]
        return pa.Array.from_buffers(pa.string(), n, [here, pa.py_buffer(self.ends), pa.py_buffer(self.data)])


def genitive(c: Column) -> Column:
    """C17."""
    return F.when(c.rlike("(?i)[sxz]$"), c).otherwise(F.concat(c, F.lit("s")))


def decode_entities(c: Column) -> Column:
    """C18; the ampersand comes last, so nothing is decoded twice."""
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def clean_component(c: Column, longest: int = 60) -> Column:
    """One blank for white space; null if empty, too long or with other than letters, digits and plain marks."""
    one = F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))
    return F.when((F.length(one) > 0) & (F.length(one) <= longest) & one.rlike(r"\A[\p{L}\p{M}\p{N} .,'’:/&()-]+\z"), one)


def scrub_emails(tokens: Column) -> Column:
    """C20."""
    return F.transform(tokens, lambda t: F.when(t.rlike(r"[^@\s]+@[^@\s]+\.[^@\s]+"), F.lit("kontakt@example.com")).otherwise(t))


def tokenize_filler(c: Column) -> Column:
    """Words at white space, with each sign before and behind a word's letters, digits and underscores as a token of its own."""
    word = "A-Za-z0-9_ÅÄÖåäö"
    signs = lambda t: F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))

    def peeled(raw: Column) -> Column:
        before = F.regexp_extract(raw, f"^[^{word}]*", 0)
        rest = F.substr(raw, F.length(before) + 1)
        core = F.regexp_extract(rest, f"(?s)^.*[{word}]", 0)
        return F.concat(signs(before), F.when(core != "", F.array(core)).otherwise(F.array().cast("array<string>")), signs(F.substr(rest, F.length(core) + 1)))

    return F.flatten(F.transform(F.filter(F.split(c, f"[{SPACE}]+"), lambda t: t != ""), peeled))


def wordpiece_text(word: str, vocab: frozenset[str] | set[str]) -> list[str] | None:
    """C16 for one word: the longest pieces from the left, later ones led by ##; None if a place has none."""
    out, at = [], 0
    while at < len(word):
        lead = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in vocab), None)
        if end is None:
            return None
        out.append(lead + word[at:end])
        at = end
    return out


def wordpiece(c: Column, vocab) -> Column:
    """C16 as a column: array of pieces, null where a word doesn't decompose under the vocabulary."""
    vocab = frozenset(vocab)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else wordpiece_text(w, vocab) for w in words.to_pylist()], pa.list_(pa.string()))

    return run(c)
