"""The subpackage's registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table
from . import encode, formatting, leakage, markup, near_duplicates, neighbours, rank_fusion, splitting, visual


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.formatting_pairs(table(spark, sf, "content")).toDF("hash_a", "hash_b")


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.formatting_groups(table(spark, sf, "content"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_ranking(spark, sf).where("rank = 1").select("request_id", "collection", "path")


def p2_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return rank_fusion.fused_ranking(table(spark, sf, "search_result"), table(spark, sf, "ranked_list")).withColumn("score", F.round("score", 9))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.mutual_neighbours(table(spark, sf, "vectors_vec")).select(F.col("a").alias("hash_seq_a"), F.col("b").alias("hash_seq_b"))


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "vectors_vec")).withColumnRenamed("key", "hash_seq")


def p3_search(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "vectors_vec")
    return neighbours.search(vectors, vectors.where("pmod(xxhash64(hash_seq), 50) = 0")).withColumnRenamed("key", "hash_seq")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    cuts = splitting.boundaries(table(spark, sf, "content"))
    return cuts.where("kind = 'heading'").select(F.col("key").alias("hash"), "pos").distinct()


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(table(spark, sf, "content")).withColumnRenamed("key", "hash")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return markup.cleaned(table(spark, sf, "corpus_doc"), "_id", "text").where("constructs > 0").select(F.col("key").alias("_id")).distinct()


def p5_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "corpus_doc").select("_id", "text").unionByName(table(spark, sf, "content").select(F.col("hash").alias("_id"), F.col("doc").alias("text")))
    return markup.cleaned(docs, "_id", "text").withColumnRenamed("key", "_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, sf, "content"), width=3, threshold=0.6).toDF("hash_a", "hash_b")


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf, "content"), table(spark, sf, "documents"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encoded(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_item")).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_item"), edits=2)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return visual.same_look_pairs(table(spark, sf, "documents")).toDF("doc_id_a", "doc_id_b")


def p10_text(spark: SparkSession, sf: str) -> DataFrame:
    return visual.normalized(table(spark, sf, "documents")).select(F.col("key").alias("doc_id"), F.col("consistent").alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_found, p2_ranking, p3_found, p3_neighbours, p3_search, p4_found, p4_pieces, p5_found, p5_text,
        p6_found, p6_groups, p8_ids, p9_found, p9_leaks, p10_found, p10_text,
    )
}
