"""Encoding of a corpus with a public byte-level BPE tokenizer: speculate and verify.

Texts are split by the tokenizer's own pattern; each distinct word is encoded once per worker.  For the
new words of a batch a greedy longest match proposes tokens.  The proposal equals the tokenizer's result
exactly if every two neighbouring tokens are compatible, i.e. if merging their joined bytes gives the two
back.  All neighbouring pairs of a batch are tested at once against a sorted table of known pairs; a pair
not seen before is settled by one exact merge.  Only words with an incompatible pair are merged exactly.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers, and the longest it remembers.
REMEMBERED, LONGEST = 400_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encodes words of one vocabulary of ranked byte strings."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex

        self.ranks = ranks
        self.split = regex.compile(PATTERN).findall
        self.longest = max(map(len, ranks))
        self.known = np.empty(0, np.int64)  # pair codes in order, and whether each is compatible
        self.fits = np.empty(0, bool)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.words: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The exact result: repeatedly join the neighbours of lowest rank, leftmost first."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > 400:
            return self._merge_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        scores = [ranks.get(x + y) for x, y in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(scores):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            for i in (at - 1, at):
                if 0 <= i < len(scores):
                    scores[i] = ranks.get(parts[i] + parts[i + 1])

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for very long words, with a heap over a linked list instead of scans."""
        import heapq

        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # end of the part that begins here; 0 where none begins
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if end[i] != middle or middle >= n or end[middle] != stop:
                continue  # a part of it was merged meanwhile
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (b := before[i]) >= 0 and (r := ranks.get(word[b:stop])) is not None:
                heapq.heappush(heap, (r, b, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ranks, n, i, out = self.ranks, len(word), 0, []
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                if (rank := ranks.get(word[i:j])) is not None:
                    out.append(rank)
                    i = j
                    break
        return out

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Whether the pairs ``first << 32 | second`` stay apart when their joined bytes are merged."""
        at = np.searchsorted(self.known, codes)
        seen = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == codes) if len(self.known) else np.zeros(len(codes), bool)
        new = np.unique(codes[~seen])
        if len(new):
            tokens = self.bytes_of
            good = np.array([self.merge(tokens[c >> 32] + tokens[c & 0xFFFFFFFF]) == [c >> 32, c & 0xFFFFFFFF] for c in new.tolist()])
            known = np.concatenate([self.known, new])
            order = np.argsort(known, kind="stable")
            self.known, self.fits = known[order], np.concatenate([self.fits, good])[order]
            at = np.searchsorted(self.known, codes)
        return self.fits[at]

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """Exact ids of each word."""
        raw = [w.encode("utf-8", "replace") for w in words]
        proposals = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        pairs = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.empty(0, np.int64)
        if len(pairs):
            bad = np.unique(owner[pairs[~self.compatible(flat[pairs] << 32 | flat[pairs + 1])]])
            for i in bad.tolist():
                proposals[i] = self.merge(raw[i])
        return proposals

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text begins."""
        split = [self.split(t) if t else [] for t in texts]
        memory = self.words
        if len(memory) > REMEMBERED:
            memory.clear()
        new = list({w for words in split for w in words if w not in memory})
        passing: dict[str, list[int]] = {}
        for w, ids in zip(new, self.encode_words(new), strict=True):
            (memory if len(w) <= LONGEST else passing)[w] = ids
        flat: list[int] = []
        ends = [0]
        for words in split:
            for w in words:
                flat += memory[w] if w in memory else passing[w]
            ends.append(len(flat))
        return np.array(flat, np.int32), np.array(ends, np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(read_ranks(path))


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, ids)``: the token ids of every row, without special tokens.

    Null, empty: the empty list.  Special tokens' strings in a text are ordinary text.  Rows are
    independent, so there is no shuffle; repeated rows come out repeatedly.
    """
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.slice(begin, 500)
                ids, at = coder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
