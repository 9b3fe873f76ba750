"""Visually identical text with different characters: one consistent form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .links import all_pairs

# Code points without any visible shape (default-ignorable ones).
INVISIBLE = (
    "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸"
    "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)

# Letters of other scripts with the shape of a Latin letter, and that letter.
LOOK_ALIKE_CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX УY ҮY ԚQ ԜW аa еe ѕs іi јj оo рp сc хx уy һh ԁd ԛq ԝw ӏl ҽe ᴦr ԌG ѵv ѴV ӀI"
LOOK_ALIKE_GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa γy ιi κk νv οo ρp υu χx ϲc ϹC ϳj ͿJ"
LOOK_ALIKE_ARMENIAN = "ՍU ՏS ՕO օo հh ոn սu ցg զq"


FIXED = {p[0]: p[1] for p in f"{LOOK_ALIKE_CYRILLIC} {LOOK_ALIKE_GREEK} {LOOK_ALIKE_ARMENIAN}".split()}
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_SPACES = re.compile("[\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]")


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters of all other scripts, and of the phonetic alphabet, with the shape of an ASCII letter, and that letter.

    They are derived from the confusables of the Unicode library that Spark brings along: letters with the skeleton of an ASCII
    letter, of two with one skeleton (I and l) the one of the same case.  The fixed values go first.
    """
    codes = [c for c in range(0x250, 0x20000) if c not in range(0x3400, 0xA000) and c not in range(0xAC00, 0xD7A4)]
    foreign = [c for c in map(chr, codes) if unicodedata.category(c)[0] == "L" and (ord(c) < 0x2B0 or not unicodedata.name(c, "LATIN").startswith("LATIN")) and not unicodedata.decomposition(c)]
    ascii_letters = [*map(chr, range(0x41, 0x5B)), *map(chr, range(0x61, 0x7B))]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    # A skeleton is made character by character, so one call serves all.
    skeletons = checker.getSkeleton("\n".join(ascii_letters + foreign)).split("\n")
    of_shape: dict[str, list[str]] = {}
    for letter, shape in zip(ascii_letters, skeletons, strict=False):
        of_shape.setdefault(shape, []).append(letter)
    found = {}
    for letter, shape in zip(foreign, skeletons[len(ascii_letters) :], strict=True):
        if twins := of_shape.get(shape):
            small = unicodedata.category(letter) == "Ll"
            found[letter] = next((t for t in twins if t.islower() == small), twins[0])
    return found | FIXED


class Forms:
    """The forms of texts that a table of look-alike letters gives."""

    def __init__(self, letters: dict[str, str]) -> None:
        # A letter whose comparison form is several characters can't be exchanged for one.
        letters = {c: t for c, t in letters.items() if len(_folded(c)) == 1}
        self.letters = {ord(c): t for c, t in letters.items()}
        self.form: dict[int, str] = {}
        foreign = set(self.letters)
        for code in range(0x80, 0x110000):
            char = chr(code)
            if not (parts := unicodedata.decomposition(char)) and unicodedata.category(char) != "Zs":
                continue
            kind, _, parts = parts.partition(" ")
            if unicodedata.category(char) == "Zs":
                self.form[code] = " "
            elif kind in ("<wide>", "<narrow>") or 0xFB00 <= code <= 0xFB17 or (kind == "<compat>" and " LIGATURE " in unicodedata.name(char, "")):
                self.form[code] = unicodedata.normalize("NFKC", char)
            elif kind == "<font>":
                self.form[code] = "".join(chr(int(p, 16)) for p in parts.split())
            if any(ord(c) in self.letters for c in unicodedata.normalize("NFD", char)):
                foreign.add(code)
        self._replaced = re.compile(f"[{_ranges(sorted(self.form))}]")
        self._foreign = re.compile(f"[{_ranges(sorted(foreign))}]" if foreign else r"(?!)")
        self._looks = re.compile("[" + INVISIBLE + _ranges(sorted(self.letters)) + "]")
        self._table = np.arange(0x110000, dtype=np.uint32)
        for code, least in self._blocks(letters).items():
            self._table[code] = ord(least)
        # Roots of classes with an ASCII letter are ASCII, as the least of a class is its root.
        self._ascii = bytes(self._table[:128].astype(np.uint8)) + bytes(range(128, 256))

    @staticmethod
    def _blocks(letters: dict[str, str]) -> dict[int, str]:
        """Of the folded letters the least that any chain of look-alikes leads to: capital nu is an N, a small one a v."""
        parent: dict[str, str] = {}

        def root(c: str) -> str:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        for c, t in letters.items():
            x, y = sorted((root(_folded(c)), root(_folded(t))))
            parent[y] = x
        return {ord(c): root(c) for c in parent if root(c) != c}

    def same_look(self, text: str) -> str:
        """``text`` with everything that doesn't show taken out, keeping letter case, punctuation and line breaks.

        Width forms, ligatures, styled letters and kinds of space are mapped, accents composed, invisible
        characters removed and look-alike letters of other scripts replaced by the Latin ones.
        """
        if text.isascii():
            return text
        text = _INVISIBLE.sub("", text)
        text = self._replaced.sub(lambda m: self.form[ord(m[0])], text)
        # Letters first: an accent on a look-alike letter composes with its Latin twin.
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(self.letters) if self._foreign.search(text) else text)

    def consistent(self, text: str) -> str:
        """The form to keep: compatibility-composed, case-folded, one kind of space, nothing invisible.

        Look-alike letters are replaced before case is folded: a capital Greek beta looks like B, a small one not like b.
        """
        look = self.same_look(text)
        if look.isascii():
            return look.casefold()
        form = unicodedata.normalize("NFKC", look).casefold()
        if self._looks.search(form):  # folding may bring in a letter that has a Latin twin
            form = self.same_look(form)
        return unicodedata.normalize("NFKC", form)

    def comparison(self, text: str) -> bytes:
        """The form that texts meet in: compatibility normalisation, full case folding, one kind of space, nothing invisible, and
        one letter for all that look alike in either case.  Texts of the same look always have the same.

        It is only compared, so letters are exchanged in one table lookup, and accents stay beside their letters.
        """
        if text.isascii():
            return text.lower().encode().translate(self._ascii)
        text = _SPACES.sub(" ", _INVISIBLE.sub("", _folded(_INVISIBLE.sub("", text))))
        codes = self._table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return codes.astype(np.uint8).tobytes() if not len(codes) or codes.max() < 128 else codes.tobytes()


def _folded(text: str) -> str:
    if not unicodedata.is_normalized("NFKD", text):
        text = unicodedata.normalize("NFKD", text)
    text = text.casefold()
    return text if text.isascii() or unicodedata.is_normalized("NFKD", text) else unicodedata.normalize("NFKD", text)


def _ranges(codes: list[int]) -> str:
    """A character class of sorted code points; a class of few ranges is tested much faster than one of many."""
    begins = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(begins, ends, strict=True))


@lru_cache(maxsize=4)
def forms(letters: tuple[tuple[str, str], ...] = tuple(FIXED.items())) -> Forms:
    """The forms of a table, made once in a process."""
    return Forms(dict(letters))


def same_look(text: str) -> str:
    return forms().same_look(text)


def consistent(text: str) -> str:
    return forms().consistent(text)


def _distinct(values: pa.ChunkedArray | pa.Array) -> tuple[list[str | None], pa.Array]:
    """Distinct values of a column and, per row, the place of its value."""
    coded = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices


def normalized(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, consistent, same_look)`` of every row; null texts stay null, empty ones empty."""
    letters = tuple(look_alikes(documents.sparkSession).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = forms(letters)
        for batch in batches:
            values, at = _distinct(batch.column(1))
            both = [pa.array([None if v is None else f(v) for v in values], pa.string()).take(at) for f in (own.consistent, own.same_look)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], ["key", "text", "consistent", "same_look"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"key {kind}, text string, consistent string, same_look string")


def look_keys(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, folded, look, stored)``: 128-bit hashes of the comparison form, the same look and the text itself.

    Null and blank texts give no row.
    """
    letters = tuple(look_alikes(documents.sparkSession).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest = forms(letters), xxhash.xxh3_128_digest
        for batch in batches:
            values, at = _distinct(batch.column(1))
            out: list[list[bytes | None]] = [[], [], []]
            for v in values:
                look = None if v is None else own.same_look(v)
                shown = bool(look and look.strip())
                for column, form in zip(out, (own.comparison(v), look, v) if shown else (None, None, None), strict=True):
                    column.append(None if form is None else digest(form if isinstance(form, bytes) else form.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()).take(at) for c in out)], ["key", "folded", "look", "stored"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"key {kind}, folded binary, look binary, stored binary").where("key is not null and look is not null")


def same_look_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of rows with different texts that look the same.

    Rows meet in the comparison form of their texts.  It takes more away than the eye overlooks (letter case, superscripts), so
    within it the look, which keeps these, decides.
    """
    return all_pairs(look_keys(documents, key, text).distinct(), ["folded", "look"], "key", "stored")
