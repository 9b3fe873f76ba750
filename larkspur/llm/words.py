"""Words of texts as 64-bit hashes in flat arrays."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

#: Unbroken runs of letters and numbers.
WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """Hash of each word's lower-case form; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts one after another, and where each text begins (one more offset than texts)."""
    get, find = _hashes.__getitem__, WORD.findall
    flat: list[int] = []
    ends = [0]
    for text in texts:
        if text:
            flat.extend(map(get, find(text)))
        ends.append(len(flat))
    return np.array(flat, np.uint64), np.array(ends, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (two multiply-shift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; empty when there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, width):
        out = mixed(out) + words[j : n + j]
    return mixed(out)


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to about ``most`` (a larger row stands alone)."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out
