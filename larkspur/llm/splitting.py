"""Splitting oversized texts at natural boundaries: lexical-cohesion valleys and document structure."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a piece and bytes shared by consecutive pieces.
SIZE, OVERLAP = 2048, 308
#: Words on each side of a gap that are compared, and the dimensions their counts are hashed to.
SIDE, DIMENSIONS = 60, 96
#: Kinds of cut point, and those that are looked for only where a window holds none of the ones before.
FENCED, LINE, PARAGRAPH, HEADING, SENTENCE = range(5)
NATURAL = ((LINE, PARAGRAPH, HEADING), (SENTENCE,), (FENCED,))
#: What the structure at a cut point adds to the depth of its valley, which is at most 2: it decides between about equal ones.
BONUS = np.array([0.0, 0.0, 0.1, 0.2, 0.0])

_WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+")
#: Sentence ends with closing marks and the spaces after them, and those of scripts without spaces.
_SENTENCE = re.compile(rb"(?:[.!?]|\xe2\x80\xa6)(?:[\"')\]]|\xc2\xbb|\xe2\x80[\x99\x9d])*[ \t]+(?=\S)|\xe3\x80\x82|\xef\xbc[\x81\x9f]")
_HEADING = re.compile(rb"#{1,6} ")
_FRONT = re.compile(rb"\A(?:\xef\xbb\xbf)?---[ \t\r]*\n(?:.*?\n)??---[ \t\r]*(?:\n|\Z)", re.S)


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        b = self[word] = zlib.crc32(word.lower()) % DIMENSIONS
        return b


_buckets = _Buckets()


def cut_points(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of all line starts but the first and of all sentences within lines, their kinds, and the depths of their cohesion valleys.

    Closed front matter is no place for a heading or paragraph, nor is fenced code: a line that starts with
    three backticks or tildes up to the next that starts with the same three, or to the end.
    """
    head = m.end() if data.startswith((b"---", b"\xef\xbb\xbf---")) and (m := _FRONT.match(data)) else 0
    positions, kinds, words_before = [], [], []
    words: list[int] = []
    bucket, find = _buckets.__getitem__, _WORD.findall
    at, fence, blank = 0, b"", False
    for line in data.split(b"\n"):
        mark = line[:3]
        opens = at >= head and not fence and mark in (b"```", b"~~~")
        if at:
            inside = at < head or fence
            kind = FENCED if inside else HEADING if mark[:1] == b"#" and _HEADING.match(line) else PARAGRAPH if blank and line.strip() else LINE
            positions.append(at)
            kinds.append(kind)
            words_before.append(len(words))
        begin = 0
        if at >= head and not fence and not opens:
            for m in _SENTENCE.finditer(line):
                if m.end() < len(line):
                    words.extend(map(bucket, find(line, begin, m.end())))
                    begin = m.end()
                    positions.append(at + begin)
                    kinds.append(SENTENCE)
                    words_before.append(len(words))
        words.extend(map(bucket, find(line, begin)))
        if opens:
            fence = mark
        elif fence and mark == fence:
            fence = b""
        blank = not line.strip()
        at += len(line) + 1
    if positions and positions[-1] >= len(data):
        for column in (positions, kinds, words_before):
            column.pop()
    return np.array(positions, np.int64), np.array(kinds, np.int8), _depths(np.array(words, np.int64), np.array(words_before, np.int64))


def _depths(words: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Depth of the similarity valley at each gap: how far the peaks on both sides rise above it."""
    if not len(gaps):
        return np.empty(0)
    # Distinct gaps of words only; lines without words share their neighbour's.
    places, back = np.unique(gaps, return_inverse=True)
    similarity = np.empty(len(places))
    for begin in range(0, len(places), 2000):  # a long text in slices
        some = places[begin : begin + 2000]
        low, high = max(0, int(some[0]) - SIDE), min(len(words), int(some[-1]) + SIDE)
        counts = np.zeros((high - low + 1, DIMENSIONS), np.int32)
        counts[np.arange(1, high - low + 1), words[low:high]] = 1
        np.cumsum(counts, axis=0, out=counts)
        here = counts[some - low]
        left = (here - counts[np.maximum(some - SIDE, low) - low]).astype(np.float32)
        right = (counts[np.minimum(some + SIDE, high) - low] - here).astype(np.float32)
        norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
        similarity[begin : begin + 2000] = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0)
    # The highest point reached while the curve still rises, on either side.
    rise_left = similarity.copy()
    for i in range(1, len(places)):
        if similarity[i - 1] > similarity[i]:
            rise_left[i] = rise_left[i - 1]
    rise_right = similarity.copy()
    for i in range(len(places) - 2, -1, -1):
        if similarity[i + 1] > similarity[i]:
            rise_right[i] = rise_right[i + 1]
    return (rise_left + rise_right - 2 * similarity)[back]


def _at_character(data: bytes, at: int) -> int:
    """The character boundary at or before ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _at_space(data: bytes, low: int, high: int) -> int | None:
    """Just after the last space or line break in ``data[low:high]``."""
    at = max(data.rfind(b" ", low, high), data.rfind(b"\n", low, high))
    return at + 1 if at >= low else None


def pieces(data: bytes, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Byte ranges of the pieces of a text; one range when it isn't over ``size``.

    Each piece ends at the deepest valley of its window, all of its room but what the overlaps take: at a line start where there is
    one outside fenced code, else between sentences, else at a line of code, else after a space, else between two characters.
    The next begins about ``overlap`` bytes earlier, at a line or sentence near there, else after a space.
    """
    if len(data) <= size:
        return [(0, len(data))]
    if size < 16 or not 0 <= overlap <= size // 3:
        raise ValueError("size must be at least 16 and overlap at most a third of it")
    positions, kinds, depths = cut_points(data)
    score = depths + BONUS[kinds] if len(positions) else depths
    out, start = [], 0
    while True:
        limit = start + size
        if limit >= len(data):
            out.append((start, len(data)))
            return out
        low = start + max(2 * overlap, size // 8)
        i, j = np.searchsorted(positions, [low, limit], "right")
        own = next((c for c in (i + np.flatnonzero(np.isin(kinds[i:j], group)) for group in NATURAL) if len(c)), None)
        if own is not None:
            end = int(positions[own[len(own) - 1 - int(np.argmax(score[own][::-1]))]])  # of equals the last
        else:
            end = _at_space(data, start + size // 2, limit) or _at_character(data, limit)
        out.append((start, end))
        target, slack = end - overlap, overlap // 3
        i, j = np.searchsorted(positions, [target - slack, target + slack])
        if i < j:
            following = int(positions[i + int(np.argmin(np.abs(positions[i:j] - target)))])
        else:
            following = _at_space(data, target - slack, target) or _at_character(data, target)
        start = following if start < following <= end else end


def _once(content: DataFrame, key: str, text: str) -> DataFrame:
    return content.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.first(text).alias("doc"))


def split(content: DataFrame, key: str = "hash", text: str = "doc", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``(key, seq, pos, text)``: the pieces of every text of more than ``size`` bytes.

    pos is the piece's byte offset; ``data[pos:pos + len(text)]`` is its text.  Nothing is left out between
    pieces, none is over ``size`` bytes and none begins or ends inside a character.  Null keys and texts, and
    texts within the size, give no rows; repeated rows of a key count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                rows: list[tuple[str, int, int, str]] = []
                part = batch.slice(begin, 256)
                for k, doc in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = doc.encode("utf-8")
                    rows += [(k, seq, a, data[a:b].decode("utf-8")) for seq, (a, b) in enumerate(pieces(data, size, overlap))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["key", "seq", "pos", "text"])

    big = content.where(F.octet_length(text) > size)
    return _once(big, key, text).mapInArrow(run, "key string, seq int, pos long, text string")


def boundaries(content: DataFrame, key: str = "hash", text: str = "doc", size: int = SIZE) -> DataFrame:
    """``(key, pos, kind, depth)``: the places at which a text of more than ``size`` bytes can be cut.

    kind is ``heading``, ``paragraph``, ``line``, ``sentence`` or ``fenced``; depth is that of the cohesion valley there.
    """
    names = pa.array(["fenced", "line", "paragraph", "heading", "sentence"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                found = [cut_points(doc.encode("utf-8")) for doc in part.column(1).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(part)), [len(f[0]) for f in found]))
                positions, kinds, depths = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(positions), names.take(pa.array(kinds)), pa.array(depths, pa.float64())], ["key", "pos", "kind", "depth"])

    big = content.where(F.col(key).isNotNull() & (F.octet_length(text) > size)).select(key, text)
    return big.mapInArrow(run, "key string, pos long, kind string, depth double")
