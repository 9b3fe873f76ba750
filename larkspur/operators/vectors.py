"""Exact nearest neighbours by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.scalars import cosine

#: Most chunks one search may fetch.
FETCH_MOST = 4096
#: Query vectors of one block, and vectors of one.
BLOCK, CELL = 2048, 65536


def check_width(vectors: DataFrame, column: str, width: int) -> DataFrame:
    """Only vectors of the width that aren't zero; a width below 1 is an error."""
    if width < 1:
        raise EngineError("vectors need at least one dimension")
    square = F.aggregate(F.col(column), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.where((F.size(column) == width) & (square > 0) & (square < float("inf")))


def knn(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(key, score)``: the ``k`` vectors most similar to one vector; a scan and a partial top-k, no shuffle of rows."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    scored = check_width(vectors, column, len(query)).select(key, cosine(F.col(column), wanted).alias("score"))
    return scored.orderBy(F.round("score", 9).desc(), key).limit(min(k, FETCH_MOST))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _best(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores of each query's best vectors; all that tie with its ``k``-th, as ties are ordered later."""
    s = q @ v.T
    n = min(k, s.shape[1])
    edge = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
    rows, top = np.nonzero(s >= edge[:, None] - 2e-9)
    return rows, top, s[rows, top]


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", query_key: str = "query_id", width: int = 64) -> DataFrame:
    """``(query_id, key, score, rank)``: the ``k`` most similar vectors of each query vector, exactly.

    Up to 2,048 queries are sent to the executors and meet each batch of vectors as one matrix product; only
    the best rows per query and batch go on.  More queries and the vectors are dealt out to cells of bounded
    size, one product a cell, so that no task and not the driver holds a share that grows with the data.
    """
    points = check_width(vectors, column, width).select(F.col(key).alias("_k"), F.col(column).cast("array<double>").alias("_v"))
    asked = check_width(queries, column, width).select(F.col(query_key).alias("_q"), F.col(column).cast("array<double>").alias("_v"))
    schema = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double"
    few = asked.limit(BLOCK + 1).collect()
    if len(few) <= BLOCK:
        table = vectors.sparkSession.sparkContext.broadcast(([r["_q"] for r in few], _unit(np.array([r["_v"] for r in few], np.float64).reshape(len(few), width))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = table.value
            for batch in batches:
                if len(batch) and ids:
                    rows, top, s = _best(q, _unit(batch.column(1).flatten().to_numpy().reshape(len(batch), -1)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(rows)), batch.column(0).take(pa.array(top)), pa.array(s)], [query_key, key, "score"])

        found = points.mapInArrow(scan, schema)
    else:
        found = _in_cells(points, asked, k, query_key, key, schema)
    ranked = found.withColumn("rank", F.expr(f"row_number() over (partition by `{query_key}` order by round(score, 9) desc, `{key}`)"))
    return ranked.where(F.col("rank") <= k)


def _in_cells(points: DataFrame, asked: DataFrame, k: int, query_key: str, key: str, schema: str) -> DataFrame:
    """Each block of queries meets each block of vectors in one cell."""
    across, down = -(-points.count() // CELL), -(-asked.count() // BLOCK)
    v = points.withColumn("x", F.pmod(F.xxhash64("_k"), F.lit(max(across, 1)))).withColumn("y", F.explode(F.expr(f"sequence(0L, {down - 1}L)")))
    q = asked.withColumn("y", F.pmod(F.xxhash64("_q"), F.lit(down))).withColumn("x", F.explode(F.expr(f"sequence(0L, {max(across, 1) - 1}L)")))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({query_key: [], key: [], "score": []})
        rows, top, s = _best(_unit(np.stack(left["_v"].to_numpy())), _unit(np.stack(right["_v"].to_numpy())), k)
        return pd.DataFrame({query_key: left["_q"].to_numpy()[rows], key: right["_k"].to_numpy()[top], "score": s})

    return q.groupBy("x", "y").cogroup(v.groupBy("x", "y")).applyInPandas(cell, schema)


def best_chunks(vectors: DataFrame, docs: DataFrame, query: Sequence[float], fetch: int) -> DataFrame:
    """``collection, path, title, hash, score``: each document's best among its collection's nearest ``fetch`` chunks, at most 4,096.

    A content used by several files of a collection comes out once, under the smallest path.
    """
    places = docs.groupBy("collection", "hash").agg(F.min(F.struct("path", "title")).alias("d")).select("collection", "hash", "d.path", "d.title")
    wanted = F.array(*(F.lit(float(x)) for x in query))
    scored = check_width(vectors, "embedding", len(query)).select("hash", cosine(F.col("embedding"), wanted).alias("score"))
    fetched = scored.join(places, "hash").withColumn("_r", F.expr("row_number() over (partition by collection order by round(score, 9) desc, hash)")).where(F.col("_r") <= min(fetch, FETCH_MOST))
    return fetched.groupBy("collection", "path", "title", "hash").agg(F.max("score").alias("score"))


def search(vectors: DataFrame, docs: DataFrame, query: Sequence[float], limit: int = 10, min_score: float | None = None) -> DataFrame:
    """Best documents by their most similar chunk: ``collection, path, title, hash, score``.

    vectors: ``hash, embedding``.  Per collection the nearest ``8 * limit`` chunks are fetched.
    """
    best = best_chunks(vectors, docs, query, 8 * limit)
    if min_score is not None:
        best = best.where(F.col("score") >= min_score)
    return best.orderBy(F.round("score", 9).desc(), "collection", "path").limit(limit)
