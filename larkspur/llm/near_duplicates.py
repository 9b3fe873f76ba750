"""Near-duplicate records: ball hashing of min-hash fingerprints, then exact verification.

A fingerprint is a set of four (place, min-hash) symbols over a record's word shingles.  Two fingerprints
that agree in three places differ by one symbol each, a symmetric difference of 2.  Each record emits
every variant within half of that radius, i.e. with one symbol taken out, and two records meet in a
variant exactly when they are within the radius.  Bit fingerprints would need a radius of about a quarter
of their bits at the similarities asked for, with far too many variants; a symbol's deletion stands for
all of its substitutions at once.

The symbols come from runs of the width that is compared, whatever the length of a text: what scattered
edits, moved parts or repetitions leave of longer runs is not bound by the similarity asked for.  With 12
fingerprints a pair at a similarity of 0.6 shares no variant with a probability of 0.0004.

Records that have little in common still meet, and the more often the larger the collection.  A sketch of
the symbols travels with each variant and a longer one with each record: pairs that they put far below
the threshold are dropped before any text moves.  At the threshold that loses 0.0001 of the pairs each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .links import all_pairs
from .words import mixed, shingles, slices, word_hashes

SYMBOLS = 4
#: Members of a bucket that are paired in one go; larger buckets are split into blocks of about this size.
BLOCK = 2048
#: Members of a bucket within one task's share from which on the bucket is split before it is shuffled.
HOT = 256
#: Symbols of the sketch that travels with a variant, two bits each; its last byte is the size on a scale of ``SIZES`` a doubling.
SKETCHED, SIZES = 28, 12
#: Chance that a sketch drops a pair just at the threshold.
LOST = 1e-4


@lru_cache(maxsize=64)
def _most_differing(symbols: int, bits: int, threshold: float) -> int:
    """Differing symbols of a sketch that a pair at the threshold exceeds with a chance of at most ``LOST``."""
    p = (1 - threshold) * (1 - 0.5**bits)
    tail, n = 1.0, -1
    while tail > LOST and n < symbols:
        n += 1
        tail -= math.comb(symbols, n) * p**n * (1 - p) ** (symbols - n)
    return n


def _symbols(words: np.ndarray, at: np.ndarray, rows: np.ndarray, width: int, fingerprints: int) -> np.ndarray:
    """Min-hash symbols (a column each) of the texts ``rows``, which have at least ``width`` words each."""
    sizes = at[rows + 1] - at[rows]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    words = words[np.repeat(at[rows] - starts, sizes) + np.arange(sizes.sum())]
    runs = shingles(words, width)
    ends = np.append(starts[1:], len(words))
    keep = np.ones(len(words), bool)
    for j in range(1, width):
        keep[ends - j] = False  # runs that would reach into the next text
    runs = runs[keep[: len(runs)]]
    at = starts - (width - 1) * np.arange(len(starts))
    rng = np.random.default_rng(20250301)
    least = np.empty((fingerprints * SYMBOLS, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for p in range(len(least)):
            xor, odd = rng.integers(1 << 63, size=2, dtype=np.uint64)
            least[p] = np.minimum.reduceat((runs ^ xor) * (odd * np.uint64(2) + np.uint64(1)), at)
            least[p] = mixed(least[p] + np.uint64(p % SYMBOLS + 1))
    return least


def _variants(symbols: np.ndarray) -> np.ndarray:
    """Ball variants (a row each): every fingerprint with one of its symbols taken out."""
    out = np.empty((symbols.shape[1], len(symbols)), np.uint64)
    with np.errstate(over="ignore"):
        for f in range(0, len(symbols), SYMBOLS):
            for gone in range(SYMBOLS):
                key = np.full(symbols.shape[1], 1 + f + gone, np.uint64)
                for s in range(SYMBOLS):
                    if s != gone:
                        key = mixed(key) + symbols[f + s]
                out[:, f + gone] = mixed(key)
    return out


def _sketches(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the 64-bit sketch (two bits a symbol, then the size) and the long one (a byte a symbol)."""
    short = np.zeros(symbols.shape[1], np.uint64)
    for s in symbols[:SKETCHED]:
        short = short << np.uint64(2) | s >> np.uint64(62)
    place = np.minimum(255, np.rint(SIZES * np.log2(sizes))).astype(np.uint64)
    return short << np.uint64(64 - 2 * SKETCHED) | place, np.ascontiguousarray((symbols >> np.uint64(32)).astype(np.uint8).T)


_PRINTS = "key string, class long, runs int, sketch long, long_sketch binary, variants array<long>"


def fingerprints(records: DataFrame, key: str, text: str, width: int, tables: int) -> DataFrame:
    """``(key, class, runs, sketch, long_sketch, variants)`` of every record of at least ``width`` words.

    class is a hash of the word sequence: records that differ in formatting only share it.  runs counts its distinct runs.  Within a task
    only the first record of a class carries sketches and variants, so copies don't multiply them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for begin, end in slices(np.diff(_offsets(batch.column(1))), 4_000_000):
                part = batch.slice(begin, end - begin)
                words, at = word_hashes(part.column(1).to_pylist())
                rows = np.flatnonzero(np.diff(at) >= width)
                if not len(rows):
                    continue
                classes = [xxhash.xxh3_64_intdigest(words[at[r] : at[r + 1]].data) - (1 << 63) for r in rows]
                new = []
                for i, c in enumerate(classes):
                    if c not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(c)
                        new.append(i)
                runs = np.array([len(np.unique(shingles(words[at[r] : at[r + 1]], width))) for r in rows], np.int32)
                chosen = np.array(new, np.int64)
                counts = np.zeros(len(rows), np.int64)
                short, long, values = np.zeros(len(rows), np.uint64), [None] * len(rows), np.empty(0, np.int64)
                if len(chosen):
                    symbols = _symbols(words, at, rows[chosen], width, tables)
                    short[chosen], longs = _sketches(symbols, runs[chosen])
                    for i, row in zip(new, longs, strict=True):
                        long[i] = row.tobytes()
                    counts[chosen] = len(symbols)
                    values = _variants(symbols).reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int64()))
                columns = [part.column(0).take(pa.array(rows)), pa.array(classes, pa.int64()), pa.array(runs, pa.int32()), pa.array(short.view(np.int64)), pa.array(long, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["key", "class", "runs", "sketch", "long_sketch", "variants"])

    return records.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, _PRINTS)


def _offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a column of strings or bytes."""
    if not len(column):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _alike(x: np.ndarray, y: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Which pairs of sketches differ in at most ``most`` symbols and in size by at most ``apart`` steps."""
    size = np.uint64((1 << (64 - 2 * SKETCHED)) - 1)
    differing = (x ^ y) >> np.uint64(64 - 2 * SKETCHED)
    differing = (differing | differing >> np.uint64(1)) & np.uint64(0x5555555555555555)
    far = np.abs((x & size).astype(np.int16) - (y & size).astype(np.int16))
    return (np.bitwise_count(differing) <= most) & (far <= apart)


_ROW = "bucket long, salt int, class long, sketch long"
_PAIR = "a long, b long, bucket long, class long, sketch long"


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), none, none, none], ["a", "b", "bucket", "class", "sketch"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per variant.  Those of buckets that are hot here are salted, and one row without class says so."""
    for batch in batches:
        for begin in range(0, len(batch), 20_000):
            part = batch.slice(begin, 20_000)
            lists = part.column(2)
            each = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            buckets = lists.flatten().to_numpy()
            classes, sketches = (np.repeat(part.column(i).to_numpy(), each) for i in (0, 1))
            values, counts = np.unique(buckets, return_counts=True)
            hot = values[counts >= HOT]
            salts = np.zeros(len(buckets), np.int32)
            if len(hot):
                salted = np.isin(buckets, hot)
                salts[salted] = 1 + (classes[salted] & 63)
            nulls = pa.nulls(len(hot), pa.int64())
            columns = [np.concatenate([buckets, hot]), np.concatenate([salts, np.zeros(len(hot), np.int32)])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.concat_arrays([pa.array(classes), nulls]), pa.concat_arrays([pa.array(sketches), nulls])], ["bucket", "salt", "class", "sketch"])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, item: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """(goes on, columns) of batches in the order of their first ``keys`` columns, cut between groups.

    A group that goes on beyond ``BLOCK`` rows comes in parts, all but its last marked as going on; each begins with the
    last row of the one before.  The last column tells where column ``item`` isn't null.
    """
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns] + [~batch.column(item).is_null().to_numpy(zero_copy_only=False)]
        if rest is not None:
            columns = [np.concatenate(c) for c in zip(rest, columns, strict=True)]
        n = len(columns[0])
        if not n:
            continue
        differs = np.zeros(n, bool)
        for c in columns[:keys]:
            differs |= c != c[-1]
        stop = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if stop:
            yield False, [c[:stop] for c in columns]
        rest = [c[stop:] for c in columns]
        if len(rest[0]) > BLOCK:
            yield True, rest
            rest = [c[-1:] for c in rest]
    if rest is not None and len(rest[0]):
        yield False, rest


def _paired(threshold: float):
    """Pairs of classes in each bucket; the rows of buckets over ``BLOCK`` members go on as they are."""
    most, apart = _most_differing(SKETCHED, 2, threshold), SIZES * -math.log2(threshold) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: int | None = None  # a bucket that was seen to be too large, and whose rows still come
        for goes_on, (buckets, salts, classes, sketches, real) in _whole_groups(batches, 1, 2):
            new = np.append(True, (buckets[1:] != buckets[:-1]) | (classes[1:] != classes[:-1]) | (real[1:] != real[:-1]))
            buckets, salts, classes, sketches, real = (c[new] for c in (buckets, salts, classes, sketches, real))
            starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
            sizes = np.diff(np.append(starts, len(buckets)))
            # Too large, salted elsewhere, or a part of such a bucket.
            large = (sizes > BLOCK) | np.logical_or.reduceat(~real | (salts > 0), starts) | (buckets[starts] == hot if hot is not None else False)
            if goes_on:
                large[:] = True
            hot = int(buckets[-1]) if goes_on else None
            rows = np.flatnonzero(np.repeat(large, sizes) & real)
            if len(rows):
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *(pa.array(c[rows].view(np.int64)) for c in (buckets, classes, sketches))], ["a", "b", "bucket", "class", "sketch"])
            sketches = sketches.view(np.uint64)
            for size in np.unique(sizes[~large]).tolist():
                if size < 2:
                    continue
                groups = starts[~large & (sizes == size)]
                i, j = np.triu_indices(size, 1)
                for some in range(0, len(groups), max(1, 2_000_000 // len(i))):
                    at = groups[some : some + max(1, 2_000_000 // len(i)), None]
                    x, y = (at + i).reshape(-1), (at + j).reshape(-1)
                    good = _alike(sketches[x], sketches[y], most, apart)
                    if good.any():
                        yield _pair_batch(classes[x[good]], classes[y[good]])

    return run


def _paired_blocks(threshold: float):
    """Pairs between the two blocks of each cell, or within its one block."""
    most, apart = _most_differing(SKETCHED, 2, threshold), SIZES * -math.log2(threshold) + 1

    def cell(lo: int, hi: int, own: np.ndarray, classes: np.ndarray, sketches: np.ndarray) -> Iterator[pa.RecordBatch]:
        left = np.flatnonzero(own == lo)
        right = np.flatnonzero(own == hi)
        for begin in range(0, len(left), 512):
            x = left[begin : begin + 512]
            good = _alike(sketches[x, None], sketches[None, right], most, apart)
            i, j = np.nonzero(good)
            a, b = classes[x[i]], classes[right[j]]
            keep = a < b if lo == hi else a != b
            yield _pair_batch(a[keep], b[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for goes_on, columns in _whole_groups(batches, 3, 4):
            buckets, los, his, own, classes, sketches, _ = columns
            starts = np.flatnonzero(np.append(True, (buckets[1:] != buckets[:-1]) | (los[1:] != los[:-1]) | (his[1:] != his[:-1])))
            for k, (begin, end) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)], strict=True)):
                held.append([c[begin:end] for c in (los, his, own, classes, sketches)])
                if goes_on and k == len(starts) - 1:
                    continue  # the cell's other rows are still to come; a cell holds about two blocks
                lo, hi, own_, class_, sketch = (np.concatenate(c) for c in zip(*held, strict=True))
                held = []
                once = np.unique(np.stack([own_.astype(np.int64), class_]), axis=1, return_index=True)[1]
                yield from cell(int(lo[0]), int(hi[0]), own_[once], class_[once], sketch[once].view(np.uint64))

    return run


def candidate_pairs(prints: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs ``(a, b)``, ``a < b``, of classes that share a variant and whose sketches don't rule them out.

    prints: ``class, sketch, variants``.  A variant that many classes share, be it a third of all, is paired in blocks of
    bounded size over many tasks.  Where a task already holds many of its members it salts them before they are shuffled.
    """
    rows = prints.select("class", "sketch", "variants").mapInArrow(_exploded, _ROW)
    rows = rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "class")
    found = cut(rows.mapInArrow(_paired(threshold), _PAIR))
    pairs = found.where("bucket is null").select("a", "b")
    large = found.where("bucket is not null").select("bucket", "class", "sketch")
    # Counts are pre-aggregated, and met through a salt so that no bucket's rows are all in one task.
    counts = large.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("salt", F.explode(F.expr("sequence(0, 63)")))
    blocks = large.withColumn("salt", F.expr("cast(pmod(xxhash64(class), 64) as int)")).join(counts, ["bucket", "salt"])
    blocks = blocks.withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as int)")).withColumn("own", F.expr("cast(pmod(xxhash64(class, 1), blocks) as int)"))
    spread = blocks.select("bucket", "class", "sketch", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    cells = spread.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "class", "sketch")
    cells = cells.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return pairs.unionByName(cells.mapInArrow(_paired_blocks(threshold), _PAIR).select("a", "b")).distinct()


def _likely(threshold: float):
    """Pairs whose long sketches don't put them below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(batch), -1) for c in batch.columns[2:4])
            good = (x != y).sum(1) <= _most_differing(x.shape[1], 8, threshold)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a_key", "b_key"]).filter(pa.array(good))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts: they are what the verification has to move."""
    pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
    for batch in batches:
        packed = pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["k", "t"])


def _similar(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for begin, end in slices(np.diff(_offsets(batch.column(2))) + np.diff(_offsets(batch.column(3))), 4_000_000):
                part = batch.slice(begin, end - begin)
                one, two = part.column(2), part.column(3)
                values = pa.concat_arrays([one, two]).dictionary_encode()
                words, at = word_hashes([unpack(z).decode("utf-8", "surrogatepass") for z in values.dictionary.to_pylist()])
                sets = [np.unique(shingles(words[at[i] : at[i + 1]], width)) for i in range(len(at) - 1)]
                places = values.indices.to_pylist()
                good, found = [], []
                for i in range(len(part)):
                    x, y = sets[places[i]], sets[places[len(part) + i]]
                    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                        continue
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    similarity = shared / (len(x) + len(y) - shared)
                    if similarity >= threshold:
                        good.append(i)
                        found.append(similarity)
                take = pa.array(good, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return run


def near_duplicates(records: DataFrame, key: str = "hash", text: str = "doc", width: int = 5, threshold: float = 0.8, tables: int = 12) -> tuple[DataFrame, DataFrame]:
    """Similar classes and the membership of records.

    Returns ``links`` ``(a, b, similarity)``, pairs of class representatives (record keys) whose distinct
    runs of ``width`` words have a Jaccard similarity of at least ``threshold``, and ``members`` ``(key,
    class, representative, copies)``, one row per record.  Records of one class have the same word
    sequence.

    Defined cases: records with a null key, and texts that are null or shorter than ``width`` words, belong
    to no class; repeated rows of a key count once; an empty table gives empty results.
    """
    prints = cut(fingerprints(records, key, text, width, tables))
    keys = prints.select("key", "class").distinct()
    counted = keys.groupBy("class").agg(F.min("key").alias("representative"), F.count("*").alias("copies"))
    members = keys.join(counted, "class")
    marked = prints.where("long_sketch is not null").groupBy("class").agg(F.first("runs").alias("runs"), F.first("long_sketch").alias("long"))
    reps = counted.join(marked, "class").select("class", "representative", "runs", "long")
    pairs = candidate_pairs(prints.where("long_sketch is not null"), threshold)
    pairs = pairs.join(reps.toDF("a", "a_key", "a_runs", "a_long"), "a").join(reps.toDF("b", "b_key", "b_runs", "b_long"), "b")
    # Sets of too different sizes can't be similar; the texts of such pairs need not be moved.
    pairs = pairs.where(F.least("a_runs", "b_runs") >= F.lit(threshold) * F.greatest("a_runs", "b_runs") - 1e-6)
    pairs = pairs.select("a_key", "b_key", "a_long", "b_long").mapInArrow(_likely(threshold), "a_key string, b_key string")
    # The same exchange of the texts serves both joins; repeated rows of a key carry the same text.
    once = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInArrow(_packed, "k string, t binary").groupBy("k").agg(F.first("t").alias("t"))
    with_a = pairs.join(once.toDF("a_key", "a_text"), "a_key")
    with_both = with_a.join(once.toDF("b_key", "b_text"), "b_key").select("a_key", "b_key", "a_text", "b_text")
    links = with_both.mapInArrow(_similar(width, threshold), "a string, b string, similarity double")
    return links, members


def near_duplicate_pairs(records: DataFrame, key: str = "hash", text: str = "doc", width: int = 5, threshold: float = 0.8, tables: int = 12) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of record keys at least ``threshold`` similar, copies included."""
    links, members = near_duplicates(records, key, text, width, threshold, tables)
    own = all_pairs(members, ["class"], "key")
    every = members.select("representative", "key")
    across = links.join(every.toDF("a", "x"), "a").join(every.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return own.unionByName(across)


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of an undirected graph ``(a, b)``; component is the smallest node.

    Alternates large-star and small-star joins until the edges stop changing.  Each round's edges are
    written to the shared folder; only one number a round reaches the driver.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = found.select("component").distinct().select(F.col("component").alias("node"), "component")
    return found.select(F.col("u").alias("node"), "component").unionByName(roots)


def near_duplicate_groups(records: DataFrame, documents: DataFrame, key: str = "hash", text: str = "doc", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(hash, group_id, links, copies, collection, path)``: every record in a group, per document that uses it.

    links counts the similar classes of the record's class.  A record no document uses has null collection
    and path; records without copy or similar record are left out.
    """
    links, members = near_duplicates(records, key, text, width, threshold)
    links = cut(links)
    degree = links.select(F.col("a").alias("representative")).unionByName(links.select(F.col("b").alias("representative"))).groupBy("representative").agg(F.count("*").alias("links"))
    groups = components(links).withColumnRenamed("node", "representative")
    rows = members.join(groups, "representative", "left").join(degree, "representative", "left")
    rows = rows.select("key", F.coalesce("component", F.when(F.col("copies") > 1, F.col("representative"))).alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies").where("group_id is not null")
    paths = documents.select(F.col("hash").alias("key"), "collection", "path").distinct()
    return rows.join(paths, "key", "left").withColumnRenamed("key", "hash")
