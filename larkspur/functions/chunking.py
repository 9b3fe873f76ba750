"""Structure-aware chunks of a Markdown text; all offsets are UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes a token stands for, tokens of a chunk, percent shared, bytes before the target searched for a break.
TOKEN, TOKENS, SHARED, WINDOW = 4, 512, 15, 800

_MARKS = re.compile(r"(#{1,6})(?: |$)")
_ITEM = re.compile(r"[-*+] |[0-9]*\. ")


def line_score(line: str) -> float:
    """How good a break before the line is: headings best, then blank lines, list items, other lines."""
    line = line.strip()
    if not line:
        return 20.0
    if m := _MARKS.match(line):
        return 110.0 - 10 * len(m[1])
    return 5.0 if _ITEM.match(line) else 1.0


def break_points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of line starts outside fences, and of fence lines, with their scores."""
    positions, scores, at, fenced = [], [], 0, False
    for line in text.split("\n"):
        if line.startswith(("```", "~~~")):
            fenced = not fenced
            positions.append(at)
            scores.append(80.0)
        elif not fenced:
            positions.append(at)
            scores.append(line_score(line))
        at += len(line.encode("utf-8")) + 1
    if text.endswith("\n") and positions and positions[-1] == at - 1:
        positions.pop()
        scores.pop()
    return np.array(positions, np.int64), np.array(scores)


def chunks(text: str, tokens: int = TOKENS) -> list[tuple[int, int]]:
    """Byte ranges of the chunks.  A text within the size is one chunk, even when empty."""
    size, overlap = tokens * TOKEN, (tokens * SHARED + 50) // 100 * TOKEN
    data = text.encode("utf-8")
    n = len(data)
    if n <= size:
        return [(0, n)]
    positions, scores = break_points(text)

    def forward(at: int) -> int:
        while at < n and data[at] & 0xC0 == 0x80:
            at += 1
        return at

    out, start = [], 0
    while True:
        end = min(start + size, n)
        if end < n:
            low = max(end - WINDOW, start, 0)
            i, j = np.searchsorted(positions, [low, end], "right")
            if i < j:
                far = (end - positions[i:j]) / max(end - low, 1)
                value = scores[i:j] * (1 - 0.7 * far * far)
                end = int(positions[j - 1 - int(np.argmax(value[::-1]))])  # of equals the last
            end = forward(end)
        out.append((start, end))
        if end >= n:
            return out
        # Small sizes could stand still: the overlap may be longer than the chunk.
        following = forward(max(end - overlap, 0))
        start = following if start < following <= end else end


def chunked(rows: DataFrame, key: str, text: str, tokens: int = TOKENS, carried: Sequence[str] = ()) -> DataFrame:
    """``(key, seq, pos, text, *carried)`` for every chunk of every row; null texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.slice(begin, 500)
                places, seqs, positions, texts = [], [], [], []
                for row, doc in enumerate(part.column(1).to_pylist()):
                    data = doc.encode("utf-8")
                    for seq, (a, b) in enumerate(chunks(doc, tokens)):
                        places.append(row)
                        seqs.append(seq)
                        positions.append(a)
                        texts.append(data[a:b].decode("utf-8"))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(places, pa.int64())), pa.array(seqs, pa.int32()), pa.array(positions, pa.int64()), pa.array(texts, pa.string()), *(part.column(2 + i).take(pa.array(places, pa.int64())) for i in range(len(carried)))], [key, "seq", "pos", "text", *carried])

    kind = rows.schema[key].dataType.simpleString()
    more = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"), *carried).mapInArrow(run, f"`{key}` {kind}, seq int, pos long, text string{more}")
