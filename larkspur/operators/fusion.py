"""Fusing ranked lists, confidence gates, and adaptive weights; all set-based over ``query_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 0.80
RRF_K = 60
RRF_WEIGHTS = {"lex": 1.0, "vec": 1.5, "hyde": 1.0, "base": 1.0}
#: Fused gate: least product of score and gap, least score.  Full-text gate: least score, least gap.
FUSED_GATE, BM25_GATE = (0.06, 0.40), (0.75, 0.10)

KEY = ["query_id", "collection", "path"]


def top(scored: DataFrame, limit: int, by: str = "query_id") -> DataFrame:
    """The best ``limit`` rows per query, with ``rank`` from 1; equal scores by collection and path."""
    tie = ", ".join(c for c in ("collection", "path") if c in scored.columns and c != by)
    ranked = scored.withColumn("rank", F.expr(f"row_number() over (partition by `{by}` order by round(score, 9) desc, {tie})"))
    return ranked.where(F.col("rank") <= limit)


def linear(bm25: DataFrame, vector: DataFrame, limit: int, alpha: float | Column = ALPHA) -> DataFrame:
    """``alpha * vector + (1 - alpha) * bm25`` per document, an absent side counting 0; metadata of the full-text side first."""
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    sides = [df.groupBy(*KEY).agg(F.max("score").alias(name)) for df, name in ((bm25, "_b"), (vector, "_v"))]
    both = sides[0].join(sides[1], KEY, "full_outer")
    return top(both.select(*KEY, (a * F.coalesce("_v", F.lit(0.0)) + (1 - a) * F.coalesce("_b", F.lit(0.0))).alias("score")), limit)


def rrf(lists: DataFrame, limit: int, k: float = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ``query_id, list_id, weight, collection, path, rank0``.

    Each list adds ``weight / (k + rank0 + 1)`` and, whatever its weight, 0.05 for its first and 0.02 for its
    second and third entry.  A ``k`` of 0 or less means 60.
    """
    k = k if k > 0 else RRF_K
    bonus = F.when(F.col("rank0") == 0, 0.05).when(F.col("rank0") <= 2, 0.02).otherwise(0.0)
    return top(lists.groupBy(*KEY).agg(F.sum(F.col("weight") / (k + F.col("rank0") + 1) + bonus).alias("score")), limit)


def pooled(lists: DataFrame, bm25: DataFrame, vector: DataFrame, weights: dict[str, float], limit: int, alpha: float | Column = ALPHA) -> DataFrame:
    """``linear`` of two pools of weighted sub-query scores, a document's best of a pool counting.

    lists: ``query_id, kind, collection, path, score``; lex goes into the full-text pool, vec and hyde into the other.  A query
    without sub-query results of a side uses its own list there.
    """
    worth = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("kind")]
    rows = lists.select(*KEY, "kind", (F.col("score") * worth).alias("score"))
    sides = []
    for plain, kinds in ((bm25, ("lex",)), (vector, ("vec", "hyde"))):
        pool = rows.where(F.col("kind").isin(*kinds)).drop("kind")
        sides.append(pool.unionByName(plain.select(*KEY, "score").join(pool.select("query_id").distinct(), "query_id", "left_anti")))
    return linear(*sides, limit, alpha)


def as_list(ranked: DataFrame, list_id: int, weight: float) -> DataFrame:
    """A ranked result (``rank`` from 1) as a list for ``rrf``."""
    return ranked.select(*KEY, F.lit(list_id).alias("list_id"), F.lit(weight).alias("weight"), (F.col("rank") - 1).alias("rank0"))


def top_two(ranked: DataFrame) -> DataFrame:
    """``(query_id, first, second)`` scores of each ranked result; second is null for a single row."""
    return ranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))


def strong_fused(ranked: DataFrame) -> DataFrame:
    """``(query_id, strong)``: the best fused score is high enough, and high times its lead is."""
    product, floor = FUSED_GATE
    strong = (F.col("first") >= floor) & (F.col("second").isNull() | (F.col("first") * (F.col("first") - F.col("second")) >= product))
    return top_two(ranked).select("query_id", strong.alias("strong"))


def strong_bm25(ranked: DataFrame) -> DataFrame:
    """``(query_id, strong)``: the best full-text score is high enough and well ahead."""
    floor, gap = BM25_GATE
    strong = (F.col("first") >= floor) & (F.col("second").isNull() | (F.col("first") - F.col("second") >= gap))
    return top_two(ranked).select("query_id", strong.alias("strong"))


def top_gap(ranked: DataFrame) -> DataFrame:
    """``(query_id, gap)``: lead of the first over the second, the score of a single row, never negative."""
    return top_two(ranked).select("query_id", F.greatest(F.col("first") - F.coalesce("second", F.lit(0.0)), F.lit(0.0)).alias("gap"))


def adaptive_alpha(queries: DataFrame, bm25: DataFrame, vector: DataFrame, base: float = ALPHA, normalizer: float = 0.20) -> DataFrame:
    """``(query_id, alpha)``: more weight to the side with the clearer lead, and to vectors for long queries."""
    gaps = queries.select("query_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n"))
    gaps = gaps.join(top_gap(bm25).withColumnRenamed("gap", "_b"), "query_id", "left").join(top_gap(vector).withColumnRenamed("gap", "_v"), "query_id", "left")
    lead = 0.15 * (F.coalesce("_v", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))) / max(normalizer, 1e-6)
    size = F.when(F.col("n") <= 3, -0.05).when(F.col("n") >= 8, 0.03).otherwise(0.0)
    return gaps.select("query_id", F.greatest(F.lit(0.55), F.least(F.lit(0.95), base + lead + size)).alias("alpha"))


def at_least(scored: DataFrame, min_score: float | None) -> DataFrame:
    return scored if min_score is None else scored.where(F.col("score") >= min_score)
