"""Evaluation texts leaking into documents: exact windows by CGK walks, edited ones by intact pieces.

Every run of up to 12 words of a test item is a window.  Exact windows are met by the CGK embedding, which
walks through a window and at each of its steps emits the current word and then moves on or stays, as a
random bit of the step and the word says; equal windows give equal walks.  The walk of every position of
every document is computed at once with array operations.  Several samples of the walk's steps are hashed; a
document position that shares a sample's hash with a window is a candidate, which is then verified word by
word.

Where edits are allowed, a window is cut into one piece more than there may be edits: whatever the edits
are, one piece is intact.  Every place of a piece in a document is a candidate, and its edit distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .words import mixed, shingles, slices, word_hashes

WINDOW = 12
#: Steps of a walk; at this many, nearly all walks have left the window.
STEPS = 2 * WINDOW
#: Samples of the walk, and steps in each.
SAMPLES, SAMPLED = 4, 9
#: Item words whose windows may be sent to every executor (about 80 bytes each).  With more, exact windows are met by a shuffle on their
#: hashes, edited ones in rounds.
WINDOWS_AT_ONCE = 200_000
#: Bits of the sieve that is sent to every executor instead, whatever the number of items: 8 MB.
SIEVE_BITS, SIEVE_PART = 26, 16
#: Parts that the documents of one window are split into when they meet it.
SALTS = 8
#: Document words worked on at a time, and candidates compared at a time.
AT_ONCE = 400_000
COMPARED = 20_000
_FILTER_BITS = 22


def _sampled_steps() -> np.ndarray:
    """Sorted steps of each sample; the first step is left out as it is the same for all walks of a word."""
    rng = np.random.default_rng(12)
    return np.stack([np.sort(rng.choice(np.arange(1, STEPS), SAMPLED, replace=False)) for _ in range(SAMPLES)])


def _walks(words: np.ndarray, starts: np.ndarray, limits: np.ndarray | int) -> np.ndarray:
    """Sample hashes (a column each) of the walks from ``starts`` that see nothing from ``limits`` words on."""
    samples = _sampled_steps()
    out = np.zeros((SAMPLES, len(starts)), np.uint64)
    place = starts.astype(np.int64)
    stop = place + limits
    padded = np.append(words, np.zeros(STEPS + 1, np.uint64))
    for step in range(int(samples.max()) + 1):
        word = padded[place]
        seen = np.where(place < stop, word, np.uint64(0))
        for s in range(SAMPLES):
            if step in samples[s]:
                out[s] = out[s] * np.uint64(0x9E3779B97F4A7C15) + seen
        # A bit of the word's hash, another at each step, moves the walk on.
        place = place + ((word >> np.uint64(step + 5)) & np.uint64(1)).astype(np.int64)
    return mixed(out)


def _sieve(hashes: np.ndarray) -> np.ndarray:
    sieve = np.zeros(1 << _FILTER_BITS, bool)
    sieve[hashes >> np.uint64(64 - _FILTER_BITS)] = True
    return np.packbits(sieve, bitorder="little")


def _met(hashes: np.ndarray, known: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``hashes``, place in ``known``) of all equal hashes; ``known`` is in order."""
    place = hashes >> np.uint64(64 - _FILTER_BITS)
    maybe = np.flatnonzero(sieve[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
    lo = np.searchsorted(known, hashes[maybe], "left")
    counts = np.searchsorted(known, hashes[maybe], "right") - lo
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(maybe, counts), np.repeat(lo, counts) + within


class Windows:
    """The windows of all items with their hashes, or for ``edits`` those of their pieces, in order."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW, edits: int = 0) -> None:
        words, at = word_hashes(texts)
        self.ids, self.sizes, self.words = ids, np.diff(at), words
        self.item = np.concatenate([np.empty(0, np.int64), *(np.full(max(1, n - window + 1), i) for i, n in enumerate(self.sizes) if n)]).astype(np.int64)
        begin = [at[i] + np.arange(max(1, n - window + 1)) for i, n in enumerate(self.sizes) if n]
        self.begin = np.concatenate([np.empty(0, np.int64), *begin]).astype(np.int64)
        self.size = np.minimum(self.sizes[self.item], window) if len(self.item) else np.empty(0, np.int64)
        self.tables = {}
        self.pieces = {}
        with np.errstate(over="ignore"):
            if edits:
                self._cut(edits)
                return
            hashes = _walks(words, self.begin, self.size)
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size == size)
            per = []
            for s in range(SAMPLES):
                order = rows[np.argsort(hashes[s][rows], kind="stable")]
                per.append((hashes[s][order], order, _sieve(hashes[s][order])))
            self.tables[size] = per

    def _cut(self, edits: int) -> None:
        """Pieces by their length: hashes in order, the window of each and its offset there."""
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size == size)
            # Of a window of no more words than edits at least one word has to be there.
            cuts = [size * i // (min(edits, size - 1) + 1) for i in range(min(edits, size - 1) + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                parts.setdefault(b - a, []).append((rows, a))
        for length, own in parts.items():
            runs = shingles(self.words, length)
            window = np.concatenate([rows for rows, _ in own])
            offset = np.concatenate([np.full(len(rows), a) for rows, a in own])
            hashes = runs[self.begin[window] + offset]
            order = np.argsort(hashes, kind="stable")
            self.pieces[length] = hashes[order], window[order], offset[order], _sieve(hashes)

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, document positions, windows) that share a sample."""
        for size, per in self.tables.items():
            hashes = _walks(words, np.arange(len(words)), size)
            for s, (known, order, sieve) in enumerate(per):
                at, place = _met(hashes[s], known, sieve)
                yield size, at, order[place]

    def near_candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of a piece, where its window would start, window) of every piece in the document."""
        found = [(np.empty(0, np.int64),) * 3]
        for length, (known, window, offset, sieve) in self.pieces.items():
            at, place = _met(shingles(words, length), known, sieve)
            found.append((at, at - offset[place], window[place]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _distances(windows: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Fewest edits between each window (a row of words) and any run of words in the row of ``around``."""
    places = np.arange(around.shape[1] + 1, dtype=np.int16)
    row = np.zeros((len(windows), len(places)), np.int16)  # a run may start anywhere
    for i in range(windows.shape[1]):
        after = row + np.int16(1)
        np.minimum(after[:, 1:], row[:, :-1] + (around != windows[:, i : i + 1]), out=after[:, 1:])
        row = np.minimum.accumulate(after - places, axis=1) + places
    return row.min(1)


def _near_matches(windows: Windows, words: np.ndarray, ends: np.ndarray, edits: int) -> dict[tuple[int, int], int]:
    """(document, item) -> fewest edits, at most ``edits``, of a window of the item in the document."""
    found: dict[tuple[int, int], int] = {}
    piece, at, window = windows.near_candidates(words)
    if not len(at):
        return found
    begins = np.append(0, ends[:-1])
    # Half of each hash, and no end of a document, will do to find the likely ones.
    pad = WINDOW + edits
    halves = np.concatenate([np.zeros(pad, np.uint32), words.astype(np.uint32), np.zeros(pad + WINDOW, np.uint32)])
    item_halves = windows.words.astype(np.uint32)
    for size in np.unique(windows.size[window]).tolist():
        of_size = np.flatnonzero(windows.size[window] == size)
        # All other words of a match are at most so many places off.
        spread = np.arange(-edits, size + edits)
        near_words = np.lib.stride_tricks.sliding_window_view(halves, len(spread))
        own_words = np.lib.stride_tricks.sliding_window_view(item_halves, size)
        likely = []
        for lo in range(0, len(of_size), COMPARED):
            rows = of_size[lo : lo + COMPARED]
            around = np.ascontiguousarray(near_words[at[rows] + (pad - edits)].T)
            mine = np.ascontiguousarray(own_words[windows.begin[window[rows]]].T)
            there = np.zeros(len(rows), np.int8)
            for j in range(size):
                hit = around[j] == mine[j]
                for s in range(1, 2 * edits + 1):
                    hit |= around[j + s] == mine[j]
                there += hit
            likely.append(rows[there >= size - edits])
        rows = np.concatenate(likely)
        doc = np.searchsorted(ends, piece[rows], "right")
        # Several pieces of a window at one place are one candidate.
        order = np.lexsort((window[rows], at[rows], doc))
        rows, doc = rows[order], doc[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (at[rows[1:]] != at[rows[:-1]]) | (window[rows[1:]] != window[rows[:-1]]))[: len(rows)]
        rows, doc = rows[new], doc[new]
        for lo in range(0, len(rows), COMPARED):
            r, d = rows[lo : lo + COMPARED], doc[lo : lo + COMPARED]
            place = at[r, None] + spread
            inside = (place >= begins[d, None]) & (place < ends[d, None])
            around = np.where(inside, words[np.clip(place, 0, len(words) - 1)], np.uint64(0))
            n = _distances(windows.words[windows.begin[window[r], None] + np.arange(size)], around)
            good = n <= edits
            for d, i, e in zip(d[good].tolist(), windows.item[window[r[good]]].tolist(), n[good].tolist(), strict=True):
                found[d, i] = min(e, found.get((d, i), e))
    return found


def _matches(windows: Windows, words: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], int]:
    """(document, item) -> 0 where a window of the item is in the document."""
    found: dict[tuple[int, int], int] = {}
    for size, at, window in windows.candidates(words):
        if not len(at):
            continue
        room = ends[np.searchsorted(ends, at, "right")] - at
        same = np.zeros(len(at), np.int64)
        begin = windows.begin[window]
        inside = np.append(words, np.zeros(size, np.uint64))
        for j in range(size):
            same += (inside[at + j] == windows.words[begin + j]) & (j < room)
        exact = same == size
        doc = np.searchsorted(ends, at[exact], "right")
        for d, i in set(zip(doc.tolist(), windows.item[window][exact].tolist(), strict=True)):
            found[d, i] = 0
    return found


def _keys(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """One hash of all samples of the walks from ``starts``."""
    out = np.zeros(len(starts), np.uint64)
    for sample in _walks(words, starts, size):
        out = mixed(out ^ sample)
    return out


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(i, size, h, check)`` of every window of every item: the hash that meets and the one that verifies."""
    for batch in batches:
        words, at = word_hashes(batch.column(1).to_pylist())
        counts = np.diff(at)
        for size in np.unique(np.minimum(counts[counts > 0], WINDOW)).tolist():
            own = np.flatnonzero(np.minimum(counts, WINDOW) == size)
            n = counts[own] - size + 1
            starts = np.repeat(at[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            with np.errstate(over="ignore"):
                h, check = _keys(words, starts, size), shingles(words, size)[starts]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(own, n))), pa.array(np.full(len(h), size, np.int32)), pa.array(h.view(np.int64)), pa.array(check.view(np.int64))], ["i", "size", "h", "check"])


def _sieved(windows: DataFrame) -> np.ndarray:
    """Bits of all windows' hashes, put together in parts of bounded size."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SIEVE_BITS - 3, np.uint8)
        for batch in batches:
            place = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - SIEVE_BITS)
            np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        parts = bits.reshape(-1, 1 << SIEVE_PART)
        used = np.flatnonzero(parts.any(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([parts[u].tobytes() for u in used], pa.binary())], ["part", "bits"])

    def either(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]]).tobytes()]})

    out = np.zeros(1 << SIEVE_BITS - 3, np.uint8)
    for r in windows.select("h").mapInArrow(own, "part long, bits binary").groupBy("part").applyInPandas(either, "part long, bits binary").collect():
        out[r["part"] << SIEVE_PART : (r["part"] + 1) << SIEVE_PART] = np.frombuffer(r["bits"], np.uint8)
    return out


def _met_by_shuffle(documents: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, item_id, edits)`` for any number of items in one scan of the documents.

    Only windows that pass a sieve of fixed size are shuffled.  They meet the items' windows by the hash of their walks, split by a
    salt, and a second hash of the words verifies them.
    """
    spark = documents.sparkSession
    item_kind, kind = items.schema["i"].dataType.simpleString(), documents.schema[key].dataType.simpleString()
    windows = cut(items.mapInArrow(_window_rows, f"i {item_kind}, size int, h long, check long"))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most 12
    shared = spark.sparkContext.broadcast(_sieved(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(np.array([len(t) for t in batch.column(1).to_pylist()]), AT_ONCE * 6):
                part = batch.slice(begin, end - begin)
                words, at = word_hashes(part.column(1).to_pylist())
                doc = np.repeat(np.arange(len(part)), np.diff(at))
                for size in sizes:
                    for lo in range(0, len(words), AT_ONCE):
                        starts = np.arange(lo, min(lo + AT_ONCE, len(words) - size + 1))
                        starts = starts[doc[starts] == doc[starts + size - 1]] if len(starts) else starts
                        if not len(starts):
                            continue
                        with np.errstate(over="ignore"):
                            h = _keys(words[: starts[-1] + size], starts, size)
                        place = h >> np.uint64(64 - SIEVE_BITS)
                        good = shared.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
                        if not good.any():
                            continue
                        first = int(starts[0])
                        with np.errstate(over="ignore"):
                            check = shingles(words[first : starts[-1] + size], size)[starts[good] - first]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[starts[good]])), pa.array(np.full(len(check), size, np.int32)), pa.array(h[good].view(np.int64)), pa.array(check.view(np.int64))], [key, "size", "h", "check"])

    found = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {kind}, size int, h long, check long")
    found = found.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    met = found.join(windows.distinct().withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))), ["size", "h", "check", "salt"])
    return met.select(key, F.col("i").alias("item_id"), F.lit(0).alias("edits")).distinct()


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", edits: int = 0) -> DataFrame:
    """``(key, item_id, edits)``: the items whose text a document contains, fully or in part.

    A document leaks an item if it contains 12 consecutive words of the item's text (all of them when it has
    fewer) with at most ``edits`` inserted, missing or replaced words.  The result is exact: equal windows
    always share every sample, and an edited window always has an intact piece.  edits is the least of any window
    and place.

    Whole texts are read, and nothing is shuffled but repeated rows' results.  The items' windows go to every executor only while
    they are at most 200,000.  Beyond, exact windows meet by a shuffle after one scan, and edited ones are worked off in several passes.

    Defined cases: null texts, and texts without a word, contain and are contained in nothing; repeated rows
    give one result; of items of no more words than ``edits`` at least one word is there; empty tables give an empty result.
    """
    spark = documents.sparkSession
    rows = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t")).distinct()
    sized = rows.withColumn("n", F.size(F.split("t", r"[^\p{L}\p{N}]+")))
    passes = max(1, -(-int(sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // WINDOWS_AT_ONCE))
    if passes > 1 and not edits:
        return _met_by_shuffle(documents, rows, key, text)
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id {item_kind}, edits int"
    out = None
    for p in range(passes):
        # Each pass collects a bounded share of the items.
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == p).orderBy("i", "t").collect()
        table = spark.sparkContext.broadcast(Windows([r["i"] for r in own], [r["t"] for r in own], edits=edits))

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            windows = table.value
            id_type = pa.array(windows.ids).type if windows.ids else pa.string()
            for batch in batches:
                docs = batch.column(1)
                begin = 0
                while begin < len(batch):
                    end, total = begin, 0
                    texts = []
                    while end < len(batch) and total < AT_ONCE * 6:
                        texts.append(docs[end].as_py())
                        total += len(texts[-1] or "")
                        end += 1
                    words, at = word_hashes(texts)
                    found: dict[tuple[int, int], int] = {}
                    with np.errstate(over="ignore"):
                        # A very long text is cut into pieces that overlap by a window and its edits.
                        for lo in range(0, len(words), AT_ONCE):
                            part = words[lo : lo + AT_ONCE + WINDOW - 1 + edits]
                            first = int(np.searchsorted(at[1:], lo, "right"))
                            ends = np.clip(at[first + 1 :] - lo, 0, len(part))
                            ends = ends[: int(np.searchsorted(ends, len(part))) + 1]
                            for (d, i), n in (_near_matches(windows, part, ends, edits) if edits else _matches(windows, part, ends)).items():
                                pair = (d + first, i)
                                found[pair] = min(n, found.get(pair, n))
                    if found:
                        pairs = list(found)
                        take = pa.array([begin + d for d, _ in pairs], pa.int64())
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([windows.ids[i] for _, i in pairs], id_type), pa.array([found[p] for p in pairs], pa.int32())], [key, "item_id", "edits"])
                    begin = end

        part = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key, "item_id").agg(F.min("edits").alias("edits"))
