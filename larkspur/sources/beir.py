"""Evaluation corpora in JSON lines and judgments in tab-separated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut

CORPUS = T.StructType([T.StructField("_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
QUERIES = T.StructType([T.StructField("_id", T.StringType()), T.StructField("text", T.StringType())])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``_id, title, text``; missing title or text is empty, a line that isn't JSON is an error."""
    rows = spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path)
    return rows.select("_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, text``; a query without a text is an error."""
    rows = spark.read.schema(QUERIES).option("mode", "FAILFAST").json(path)
    return rows.select(F.col("_id").alias("query_id"), F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("query without text: "), F.coalesce("_id", F.lit("?"))))).otherwise(F.col("text")).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, doc, relevance`` with positive relevance.

    A heading line, lines of fewer than three fields and scores that are no number are passed over; of
    repeated judgments the last in the file holds.
    """
    lines = spark.read.text(path).withColumn("at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("n")))
    parts = lines.select(F.split("value", "\t").alias("p"), "at").where("size(p) >= 3 and not (at.n = 0 and startswith(p[0], 'query-id'))")
    rows = parts.select(F.col("p")[0].alias("query_id"), F.col("p")[1].alias("doc"), F.coalesce(F.expr("try_cast(trim(p[2]) as int)"), F.lit(0)).alias("relevance"), "at").where("relevance > 0")
    return rows.groupBy("query_id", "doc").agg(F.max_by("relevance", "at").alias("relevance"))


def in_file_order(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of a file that was read, all of them for 0."""
    return rows if not most else rows.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(most).drop("_at")


def judged(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with at least one judgment."""
    return queries.join(qrels.select("query_id"), "query_id", "left_semi")


def expansion_pairs(queries: DataFrame, qrels: DataFrame, seed: int = 42, most: int | None = 200, dev: float = 0.2) -> DataFrame:
    """``(query, relevant_doc_ids, qid, part)``: judged queries in an order drawn by hash, at most ``most``."""
    items = qrels.where("relevance > 0").groupBy("query_id").agg(F.sort_array(F.collect_set("doc")).alias("relevant_doc_ids"))
    rows = items.join(queries, "query_id").select(F.col("text").alias("query"), "relevant_doc_ids", F.col("query_id").alias("qid"), _part("query_id", seed, dev).alias("part"))
    return rows if most is None else rows.orderBy(F.xxhash64(F.lit(seed), "qid"), "qid").limit(most)


def _part(key: str, seed: int, dev: float):
    return F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1000)) < int(dev * 1000), "dev").otherwise("train")


def write_jsonl(rows: DataFrame, folder: str) -> None:
    """One object per line, in a folder of files."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def export_training(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str, name: str, most_pairs: int = 1000, most_queries: int = 200) -> dict[str, int]:
    """Write the ``{name}_rerank_*`` and ``{name}_expand_*`` parts; the number of rows of each.

    The caps belong to the export: a sample of this size is what it is for.
    """
    pairs = rerank_pairs(queries, corpus, qrels)
    pairs = pairs.orderBy(F.xxhash64("query", "document"), "query", "document").limit(most_pairs)
    out = {}
    for kind, rows in (("rerank", cut(pairs)), ("expand", cut(expansion_pairs(queries, qrels, most=most_queries)))):
        for part in ("train", "dev"):
            own = rows.where(F.col("part") == part).drop("part")
            write_jsonl(own, f"{folder}/{name}_{kind}_{part}.jsonl")
            out[f"{kind}_{part}"] = own.count()
    return out


def rerank_pairs(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, seed: int = 42, positives: int = 3, most: int = 10, dev: float = 0.2) -> DataFrame:
    """``(query, document, relevant, part)``: training pairs, some positives and three times as many negatives per query.

    Negatives of a query are drawn by hash from a sample of the corpus, so that no query meets every document;
    texts are cut to 2,000 characters; ``part`` is train or dev.
    """
    texts = corpus.select(F.col("_id").alias("doc"), F.substring(F.concat_ws("\n\n", F.nullif("title", F.lit("")), "text"), 1, 2000).alias("document"))
    order = F.xxhash64(F.lit(seed), "query_id", "doc")
    picked = qrels.withColumn("r", F.row_number().over(_by("query_id", order))).where(F.col("r") <= positives)
    size = picked.groupBy("query_id").agg(F.least(F.lit(most), 3 * F.count("*")).alias("n"))
    buckets = 64
    pool = corpus.select(F.col("_id").alias("doc"), F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(buckets)).alias("b")).withColumn("r", F.row_number().over(_by("b", F.xxhash64("doc")))).where(F.col("r") <= 4 * most)
    drawn = size.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "query_id"), F.lit(buckets))).join(pool.drop("r"), "b").join(qrels.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    negatives = drawn.withColumn("r", F.row_number().over(_by("query_id", order))).where(F.col("r") <= F.col("n"))
    pairs = picked.select("query_id", "doc", F.lit(True).alias("relevant")).unionByName(negatives.select("query_id", "doc", F.lit(False).alias("relevant")))
    part = _part("query_id", seed, dev)
    return pairs.join(texts, "doc").join(queries.select("query_id", F.col("text").alias("query")), "query_id").select("query", "document", "relevant", part.alias("part"))


def _by(key: str, order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)
