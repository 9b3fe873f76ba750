"""Reranking the head of a result with cached scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cache_key, truncated
from .fusion import top
from .models import Scorer

TOP, WEIGHT = 20, 0.6


def keyed(ranked: DataFrame, queries: DataFrame, model: str, head: int = TOP) -> DataFrame:
    """The first rows of each query with their cache key; ranked has ``query_id, rank, hash``."""
    rows = ranked.where(F.col("rank") <= head).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return rows.withColumn("key", cache_key(F.lit(model), F.col("query"), F.col("hash")))


def cache_split(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows with their newest cached ``rerank`` score, null for a miss; cache: ``key, score, created_at``."""
    newest = cache.groupBy("key").agg(F.max_by("score", F.struct("created_at", "score")).alias("rerank"))
    return rows.join(newest, "key", "left")


def score_misses(rows: DataFrame, content: DataFrame, scorer: Scorer) -> DataFrame:
    """``(key, score)`` of rows without a score; text is fetched for these only and cut to the scorer's size."""
    texts = rows.where("rerank is null").select("key", "query", "hash").dropDuplicates(["key"]).join(content.groupBy("hash").agg(F.min("doc").alias("doc")), "hash")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query, part in batch.groupby("query", sort=False):
                yield pd.DataFrame({"key": part["key"], "score": [float(s) for s in scorer.score_batch(query, part["doc"].tolist())]})

    return texts.select("key", "query", truncated("doc").alias("doc")).repartition("query").mapInPandas(run, "key string, score double")


def blended(ranked: DataFrame, scores: DataFrame, limit: int | None, weight: float = WEIGHT) -> DataFrame:
    """All rows by ``(1 - weight) * score + weight * rerank``; rows without a rerank score keep theirs.

    scores: ``query_id, collection, path, rerank``.
    """
    both = ranked.drop("rank").join(scores.select("query_id", "collection", "path", "rerank"), ["query_id", "collection", "path"], "left")
    score = F.when(F.col("rerank").isNotNull(), (1 - weight) * F.col("score") + weight * F.col("rerank")).otherwise(F.col("score"))
    return top(both.withColumn("score", score).drop("rerank"), limit if limit is not None else 2**31 - 1)


def rerank(ranked: DataFrame, queries: DataFrame, content: DataFrame, cache: DataFrame, scorer: Scorer, limit: int | None = None, head: int = TOP, weight: float = WEIGHT) -> tuple[DataFrame, DataFrame]:
    """The reranked result, and the new cache rows ``(key, score)``."""
    rows = cache_split(keyed(ranked, queries, scorer.model_id, head), cache)
    made = score_misses(rows, content, scorer)
    scores = rows.join(made.withColumnRenamed("score", "_made"), "key", "left").withColumn("rerank", F.coalesce("rerank", "_made"))
    return blended(ranked, scores, limit, weight), made
