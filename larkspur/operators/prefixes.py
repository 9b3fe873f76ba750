"""Batches of queries made of prefixes alone, asked once: a scan of the texts takes the place of an index."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .fulltext import K1, WEIGHTS, B, idf
from .fusion import top

KEY = ["collection", "path"]
#: Documents whose best are chosen by one task, and the most tasks: each of them may give every query ``limit`` documents.
DOCS_A_TASK, TASKS = 20_000, 64
#: Distinct tokens that a worker remembers the prefixes of.
REMEMBERED = 500_000
#: Scores no further apart may be equal to nine places.
NEAR = 2e-9


def _words(column: str) -> Column:
    """The tokens of ``simple_tokens`` with a space between them."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}]+", " ")


def _counted(words: Sequence[str], weights: Sequence[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document its length, the numbers of the words that its tokens begin with, and how much they weigh there."""
    number = {w: i for i, w in enumerate(words)}
    sizes = sorted({len(w) for w in words})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            lengths, ends, ids, fs = array("i"), array("i", [0]), array("i"), array("d")
            for texts in zip(*(batch.column(f"_{n}").to_pylist() for n in range(len(weights))), strict=True):
                length, f = 0, {}
                for text, weight in zip(texts, weights, strict=True):
                    tokens = text.split()
                    length += len(tokens)
                    for token, n in Counter(tokens).items():
                        begun = known.get(token)
                        if begun is None:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            begun = known[token] = tuple(number[token[:s]] for s in sizes if s <= len(token) and token[:s] in number)
                        for i in begun:
                            f[i] = f.get(i, 0.0) + weight * n
                lengths.append(length)
                ids.extend(f.keys())
                fs.extend(f.values())
                ends.append(len(ids))
            at = pa.array(np.array(ends, np.int32))
            arrays = [pa.array(np.array(lengths, np.int32)), pa.ListArray.from_arrays(at, pa.array(np.array(ids, np.int32))), pa.ListArray.from_arrays(at, pa.array(np.array(fs, np.float64)))]
            yield pa.RecordBatch.from_arrays([batch.column("collection"), batch.column("path"), *arrays], ["collection", "path", "len", "ids", "fs"])

    return run


def _pruned(scores: np.ndarray, docs: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``limit`` and all that may be equal to the last of them; which of these go on is for the exact ranking to say."""
    if len(scores) <= limit:
        return scores, docs
    keep = scores >= np.partition(scores, -limit)[-limit] - NEAR
    return scores[keep], docs[keep]


def _best(texts: Sequence[str], words: Sequence[str], known: dict[str, tuple[float, np.ndarray, np.ndarray]], limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best documents of a task for every query; known: mean length, words and their idf of each collection."""
    number = {w: i for i, w in enumerate(words)}
    queries = [[number[w] for w in text.split(" ")] for text in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        names: list[pa.RecordBatch] = []
        seen = 0
        for batch in batches:
            own = batch.column("collection").dictionary_encode()
            collection = own.indices.to_numpy(zero_copy_only=False)
            table, mean = np.zeros((len(own.dictionary), len(words))), np.ones(len(own.dictionary))
            for c, name in enumerate(own.dictionary.to_pylist()):
                mean[c], at, values = known[name]
                table[c, at] = values
            ids, fs = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "fs"))
            doc = np.repeat(np.arange(batch.num_rows), batch.column("ids").value_lengths().to_numpy(zero_copy_only=False))
            # Word by word, and of each word its documents in order.
            order = np.argsort(ids, kind="stable")
            ids, fs, doc = ids[order], fs[order], doc[order]
            norm = K1 * ((1 - B) + B * batch.column("len").to_numpy(zero_copy_only=False) / mean[collection])
            part = table[collection[doc], ids] * fs * (K1 + 1) / (fs + norm[doc])
            starts = np.searchsorted(ids, np.arange(len(words) + 1)).tolist()
            for q, query in enumerate(queries):
                spans = sorted((starts[i + 1] - starts[i], starts[i]) for i in query)
                size, a = spans[0]
                docs, raw = doc[a : a + size], part[a : a + size]
                for more, a in spans[1:]:
                    if not len(docs):
                        break
                    at = np.minimum(np.searchsorted(doc[a : a + more], docs), more - 1) + a
                    both = doc[at] == docs
                    docs, raw = docs[both], raw[both] + part[at[both]]
                if len(docs):
                    scores, docs = _pruned(raw / (1.0 + raw), docs, limit)
                    if q in held:
                        scores, docs = _pruned(np.concatenate((held[q][0], scores)), np.concatenate((held[q][1], docs + seen)), limit)
                    else:
                        docs = docs + seen
                    held[q] = scores, docs
            names.append(batch.select(KEY))
            seen += batch.num_rows
        if held:
            asked, every = pa.array(texts), pa.Table.from_batches(names)
            numbers = list(held)
            for i in range(0, len(numbers), 2_000):
                some = numbers[i : i + 2_000]
                q = np.repeat(some, [len(held[n][0]) for n in some])
                found = every.take(np.concatenate([held[n][1] for n in some])).combine_chunks()
                columns = [asked.take(pa.array(q)), *(found.column(c).combine_chunks() for c in KEY), pa.array(np.concatenate([held[n][0] for n in some]))]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["terms", *KEY, "score"])

    return run


def search_batch(docs: DataFrame, queries: DataFrame, limit: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """``(query_id, collection, path, score, rank)`` of many queries at once, as ``postings.search_batch`` ranks them.

    docs: ``collection, path, title, body``; queries: ``query_id, terms``, arrays of lower-case words of letters and digits.  A
    document matches when for each of them a token begins with it.  Queries of the same words are one; the distinct ones and the
    collections' weights of their words are sent along with the plan.  Texts are read once: what is kept of a document are its
    length and the asked words in it.
    """
    fields = WEIGHTS | (weights or {})
    asked = queries.select("query_id", F.array_join(F.array_sort(F.array_distinct("terms")), " ").alias("terms")).where("terms <> ''")
    texts = sorted(r["terms"] for r in asked.select("terms").distinct().collect())
    words = sorted({w for text in texts for w in text.split(" ")})
    rows = docs.select(*KEY, *(_words(c).alias(f"_{n}") for n, c in enumerate(fields)))
    counted = cut(rows.mapInArrow(_counted(words, [float(w) for w in fields.values()]), "collection string, path string, len int, ids array<int>, fs array<double>"))
    stats = counted.groupBy("collection").agg(F.count("*").alias("docs"), F.avg("len").alias("avg"))
    df = counted.select("collection", F.explode("ids").alias("id")).groupBy("collection", "id").agg(F.count("*").alias("df"))
    facts = df.join(stats, "collection").groupBy("collection").agg(F.first("avg").alias("avg"), F.collect_list("id").alias("ids"), F.collect_list(idf(F.col("docs"), F.col("df"))).alias("idfs")).collect()
    known = {r["collection"]: (r["avg"], np.array(r["ids"], np.int32), np.array(r["idfs"])) for r in facts}
    hits = counted.where("collection is not null and path is not null and size(ids) > 0")
    tasks = max(1, min(TASKS, -(-counted.count() // DOCS_A_TASK)))
    found = hits.coalesce(tasks).mapInArrow(_best(texts, words, known, limit), "terms string, collection string, path string, score double")
    return asked.join(top(found, limit, "terms"), "terms").select("query_id", *KEY, "score", "rank")
