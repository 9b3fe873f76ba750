"""Analyzers: text to search tokens, as JVM expressions or as a stemming Arrow function."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and numbers, in order; null gives no tokens."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


_VOWELS = "aeiou"


def _consonant(word: str, i: int) -> bool:
    c = word[i]
    return c not in _VOWELS and not (c == "y" and i > 0 and _consonant(word, i - 1))


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    shape = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall(r"v+c+", shape))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return n >= 3 and _consonant(word, n - 3) and not _consonant(word, n - 2) and _consonant(word, n - 1) and word[-1] not in "wxy"


# The suffix tables of Porter's 1980 algorithm.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log bli:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _pairs(table: str) -> list[tuple[str, str]]:
    return sorted(((a, b) for a, _, b in (x.partition(":") for x in table.split())), key=lambda p: -len(p[0]))


_TWO, _THREE, _FOUR = _pairs(_STEP2), _pairs(_STEP3), sorted(_STEP4.split(), key=len, reverse=True)


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Stem of a lower-case ASCII word by the published 1980 algorithm; other words are left alone."""
    if len(word) < 3 or len(word) > 64 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
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
    for table in (_TWO, _THREE):
        for suffix, new in table:
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in _FOUR:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


_RUNS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without diacritics on Latin letters."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def stemmed(text: str | None) -> list[str]:
    """Folded and stemmed tokens of a text."""
    return [porter(t) for t in _RUNS.findall(fold(text))] if text else []


@F.pandas_udf(ArrayType(StringType()))
def stemmed_tokens(texts: pd.Series) -> pd.Series:
    """``stemmed`` of a column, in Arrow batches."""
    return texts.map(stemmed)
