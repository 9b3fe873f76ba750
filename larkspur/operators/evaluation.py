"""Retrieval quality: nDCG, recall, paired tests, feedback expansion, tuning; whole query sets in one plan."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import STOPWORDS, feedback_terms
from .fusion import linear, top

ALPHAS = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
RERANK_WEIGHTS = (0.30, 0.40, 0.50, 0.60, 0.70, 0.80)
PRF_WEIGHT, PRF_DOCS, PRF_TERMS = 0.30, 3, 10
#: Distinct terms that a task counts before it passes them on.
FLUSHED = 500_000

_WORD, _STOP = re.compile("[A-Za-z0-9]+"), frozenset(STOPWORDS)


def metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10, grid: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """``(*grid, query_id, ndcg, recall)`` of every judged query; without results both are 0.

    With a ``grid``, a parameter and its values, ranked has a column of it and every query is measured for every value.

    ranked: ``query_id, doc, rank`` from 1; qrels: ``query_id, doc, relevance``, of which positive ones count.
    The gain is ``2^relevance - 1``, and the ideal ranks all judged documents of the query.
    """
    good = qrels.where("relevance > 0")
    ideal = good.withColumn("i", F.expr("row_number() over (partition by query_id order by relevance desc)"))
    gain = (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("i") + 1)
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("i") <= k, gain)).alias("idcg"), F.count("*").alias("relevant"))
    by = tuple(grid or ())
    hits = ranked.where(F.col("rank") <= k).join(good, ["query_id", "doc"]).groupBy(*by, "query_id").agg(F.sum((F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("rank") + 1)).alias("dcg"), F.count("*").alias("hits"))
    for name in by:
        ideal = ideal.withColumn(name, F.explode(F.array(*map(F.lit, grid[name]))))
    both = ideal.join(hits, [*by, "query_id"], "left")
    return both.select(*by, "query_id", F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.col("hits") / F.col("relevant"), F.lit(0.0)).alias("recall"))


def means(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean nDCG and recall, 0 for no query."""
    return per_query.groupBy(*by).agg(F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"), F.count("*").alias("n_queries"))


def paired_t(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(n, mean_diff, se, t, low, high, significant)`` for b against a, by ``query_id, ndcg``; none for fewer than two pairs."""
    pairs = a.select("query_id", F.col("ndcg").alias("_a")).join(b.select("query_id", F.col("ndcg").alias("_b")), "query_id")
    d = F.col("_b") - F.col("_a")
    stats = pairs.agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se")).where("n >= 2")
    t = F.when(F.col("se") > 0, F.col("mean_diff") / F.col("se")).otherwise(F.lit(0.0))
    return stats.withColumn("t", t).withColumn("low", F.col("mean_diff") - 1.96 * F.col("se")).withColumn("high", F.col("mean_diff") + 1.96 * F.col("se")).withColumn("significant", F.abs("t") >= 1.96)


def tuned(bm25: DataFrame, vector: DataFrame, qrels: DataFrame, limit: int = 10, alphas: tuple[float, ...] = ALPHAS, doc: Column | None = None) -> DataFrame:
    """``(alpha, ndcg, recall)`` of each weight: every query is fused with every weight in one plan.

    doc is what the judgments name a document by, ``collection/path`` if nothing is given.
    """
    doc = F.concat_ws("/", "collection", "path") if doc is None else doc
    grid = F.explode(F.array(*map(F.lit, alphas))).alias("alpha")
    b = bm25.select("*", grid).withColumn("query_id", F.struct("alpha", "query_id")).drop("alpha")
    v = vector.select("*", grid).withColumn("query_id", F.struct("alpha", "query_id")).drop("alpha")
    fused = linear(b, v, limit, F.col("query_id.alpha"))
    ranked = fused.select(F.col("query_id.alpha").alias("alpha"), F.col("query_id.query_id").alias("query_id"), doc.alias("doc"), "rank")
    return means(metrics(ranked, qrels, limit, {"alpha": alphas}), ("alpha",))


def tuned_rerank(found: DataFrame, judged: DataFrame, qrels: DataFrame, limit: int = 10, weights: tuple[float, ...] = RERANK_WEIGHTS) -> DataFrame:
    """``(weight, ndcg, recall)`` of each weight of the judge's score: ``query_id, collection, path, rerank``."""
    both = found.drop("rank").join(judged, ["query_id", "collection", "path"], "left").withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    score = F.when(F.col("rerank").isNotNull(), (1 - F.col("weight")) * F.col("score") + F.col("weight") * F.col("rerank")).otherwise(F.col("score"))
    ranked = top(both.withColumn("score", score).withColumn("run", F.struct("weight", "query_id")), limit, "run")
    return means(metrics(ranked.select("weight", "query_id", F.col("path").alias("doc"), "rank"), qrels, limit, {"weight": weights}), ("weight",))


def best(grid: DataFrame, parameter: str = "alpha") -> DataFrame:
    """The row of the largest nDCG; of equals the smallest parameter."""
    return grid.orderBy(F.desc("ndcg"), parameter).limit(1)


def _term_counts(text: str | None) -> Counter[str]:
    """``feedback_terms`` of a text, counted; far faster than by Spark's split of it into an array."""
    counts: Counter[str] = Counter()
    for word, n in Counter(_WORD.findall(text or "")).items():
        term = word.lower()
        if len(term) >= 3 and term not in _STOP:
            counts[term] += n
    return counts


def _dfs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df: Counter[str] = Counter()
    made = lambda: pa.RecordBatch.from_arrays([pa.array(list(df.keys()), pa.string()), pa.array(list(df.values()), pa.int64())], ["term", "n"])
    for batch in batches:
        for text in batch.column(0).to_pylist():
            df.update(_term_counts(text).keys())
            if len(df) >= FLUSHED:
                yield made()
                df.clear()
    yield made()


def _tfs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            counts = [_term_counts(text) for text in batch.column("text").to_pylist()]
            at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            terms, n = pa.array([t for c in counts for t in c.keys()], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at)), terms, n], ["query_id", "term", "n"])


def term_stats(docs: DataFrame) -> DataFrame:
    """``(term, df)`` over ``text``; counted where the texts are, so that no more than the vocabulary is moved."""
    return docs.select("text").mapInArrow(_dfs, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def feedback(seeds: DataFrame, docs: DataFrame, queries: DataFrame, top_docs: int = PRF_DOCS, top_terms: int = PRF_TERMS) -> DataFrame:
    """``(query_id, term, weight, term_rank)``: the terms most telling of each query's first documents.

    seeds: ``query_id, collection, path, rank``.  Terms of the query itself are left out.
    """
    total = docs.agg(F.count("*")).scalar()
    used = seeds.where(F.col("rank") <= top_docs).join(docs, ["collection", "path"]).select("query_id", "text")
    used = used.mapInArrow(_tfs, f"query_id {used.schema['query_id'].dataType.simpleString()}, term string, n bigint")
    own = queries.select("query_id", F.explode(feedback_terms(F.col("text"))).alias("term")).distinct()
    # Counted before own terms go, so that far fewer rows are moved.
    tf = used.groupBy("query_id", "term").agg(F.sum("n").alias("tf")).join(own, ["query_id", "term"], "left_anti")
    weight = F.col("tf") * (F.log((total + 1.0) / (F.coalesce("df", F.lit(1)) + 1.0)) + 1.0)
    scored = tf.join(term_stats(docs), "term", "left").select("query_id", "term", weight.alias("weight"))
    return scored.withColumn("term_rank", F.expr("row_number() over (partition by query_id order by round(weight, 9) desc, term)")).where(F.col("term_rank") <= top_terms)


def feedback_queries(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, text)`` with the feedback terms added."""
    more = terms.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term_rank", "term"))), lambda s: s["term"]), " ").alias("more"))
    return queries.join(more, "query_id").select("query_id", F.concat_ws(" ", "text", "more").alias("text"))


def run_key(config: dict) -> str:
    """Cache key of an evaluation run: a hash of all of its settings."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def uncached(queries: DataFrame, cache: DataFrame, config: dict) -> DataFrame:
    """Queries without a stored result of this run; cache: ``run_key, query_id, ndcg, recall``."""
    return queries.join(cache.where(F.col("run_key") == run_key(config)).select("query_id"), "query_id", "left_anti")
