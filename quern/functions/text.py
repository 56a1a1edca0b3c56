"""Text kernels: query sanitising, tokens, genericised text, Porter stems."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}]+"


def query_terms(col: Column) -> Column:
    """Search terms of a query: words of two or more characters that aren't numbers, reserved words included."""
    words = F.regexp_extract_all(col, F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.rlike(r"^\p{N}+$"))


def tokens(col: Column) -> Column:
    """Lower-cased letter and digit runs; the underscore separates.  Null text gives no tokens."""
    return F.coalesce(F.regexp_extract_all(F.lower(col), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


# What is deleted to make claims comparable, in this order; ``(?i)`` without regard to case.
GENERIC = [
    r"https?://\S+",
    r"\S+@\S+\.\S+",
    r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b",
    r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b",
    r"\b20[0-9]{2}(?:\s*[-–]\s*20[0-9]{2})?\b",
    r"\b19[0-9]{2}(?:\s*[-–]\s*19[0-9]{2})?\b",
    r"\d[\d,.]*\s*%",
    r"(?i)[$€£]\s*\d[\d,.]*(?:\s*(?:million|billion|trillion|[MBT]))?",
    r"\b\d[\d,.]*\b",
]
BLANKS = r"\s{2,}"  #: becomes one blank
#: Blanks as scripts know them, for the regular expressions of the JVM: ``\s`` alone lacks some, and has one too few.
_BLANK = r"[\s\x1c-\x1f]"


def genericise(col: Column) -> Column:
    """Deletes links, addresses, dates, years, shares, amounts and numbers, in that order, then joins blanks.

    Word edges, digits and blanks are those of Unicode.  Null stays null.
    """
    for pattern in GENERIC:
        col = F.regexp_replace(col, "(?U)" + pattern.replace(r"\s", _BLANK).replace(r"\S", r"[^\s\x1c-\x1f]"), "")
    return F.regexp_replace(F.regexp_replace(col, "(?U)" + BLANKS.replace(r"\s", _BLANK), " "), rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


_VOWEL = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWEL and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    """Vowel-consonant sequences of a stem."""
    shape = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", shape)))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


# Suffix rules of Porter's algorithm (1980).
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_RULES2 = sorted((tuple(r.split(":")) for r in _STEP2.split()), key=lambda r: -len(r[0]))
_RULES3 = sorted((tuple(r.split(":")) for r in _STEP3.split()), key=lambda r: -len(r[0]))
_RULES4 = sorted(_STEP4.split(), key=lambda s: -len(s))


def porter(w: str) -> str:
    """Porter stem of a lower-case English word."""
    if len(w) < 3:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_RULES2, _RULES3):
        for suffix, new in rules:
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in _RULES4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Porter stems of arrays of tokens."""
    known: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in known:
            known[w] = porter(w)
        return known[w]

    return words.map(lambda ws: None if ws is None else [one(w) for w in ws])
