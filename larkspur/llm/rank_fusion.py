"""One ranking from several differently-scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ITEM = ["collection", "path"]


def fused_ranking(results: DataFrame, lists: DataFrame, k: int = 60) -> DataFrame:
    """``(request_id, collection, path, score, rank)``: the one ranking of each request.

    Every list is ranked for itself by its own scale (``better`` says which end is good), so no range can
    rule.  An item's total is the sum of ``weight / (k + rank)`` over the lists that scored it; equal
    totals are ordered by the best single rank, then collection and path.  Equal scores of a list share
    the better rank.

    Defined cases: null or NaN scores count as not scored; a list with weight null, not finite or <= 0 is
    switched off; repeated rows count once (of a repeated list the one logged last, of a repeated item the
    best score); results without a list, and items with null collection or path, give nothing.
    """
    newest = F.max_by(F.struct("weight", "better"), F.struct("logged_at", "weight", "better"))
    on = lists.groupBy("request_id", "list_no").agg(newest.alias("l")).select("request_id", "list_no", "l.weight", "l.better").where("weight > 0 and weight < double('infinity')")
    scored = results.where("score is not null and not isnan(score) and collection is not null and path is not null").select("request_id", "list_no", *ITEM, "score")
    # Ranking, summing and ordering all work within a request, so one shuffle serves them.
    scored = scored.repartition("request_id").join(on.repartition("request_id"), ["request_id", "list_no"])
    good = F.when(F.col("better") == "lower", -F.col("score")).otherwise(F.col("score"))
    best = scored.groupBy("request_id", "list_no", *ITEM, "weight").agg(F.max(good).alias("good"))
    ranked = best.withColumn("r", F.rank().over(W.partitionBy("request_id", "list_no").orderBy(F.desc("good"))))
    # Summed in list order, so that the last bit doesn't depend on how rows arrive.
    parts = F.array_sort(F.collect_list(F.struct("list_no", (F.col("weight") / (k + F.col("r"))).alias("part"))))
    totals = ranked.groupBy("request_id", *ITEM).agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["part"]).alias("score"), F.min("r").alias("best"))
    order = W.partitionBy("request_id").orderBy(F.desc("score"), "best", *ITEM)
    return totals.withColumn("rank", F.row_number().over(order)).select("request_id", *ITEM, "score", "rank")
