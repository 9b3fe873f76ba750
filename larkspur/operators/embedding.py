"""Which contents still need vectors, which vectors are orphans, and the embedding run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import TOKENS, chunked
from ..functions.scalars import document_prompt
from .models import Embedder


def unembedded(documents: DataFrame, vectors: DataFrame, model: str | None = None) -> DataFrame:
    """``(hash, path)``: contents of active documents without any vector, under their smallest path.

    With ``model`` only that model's vectors count.
    """
    done = vectors if model is None else vectors.where(F.col("model") == model)
    pending = documents.where("active and hash is not null").select("hash", "path").join(done.select("hash"), "hash", "left_anti")
    return pending.groupBy("hash").agg(F.min("path").alias("path"))


def orphans(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct hashes that have vectors but no active document."""
    return vectors.select("hash").where("hash is not null").distinct().join(documents.where("active").select("hash"), "hash", "left_anti")


def without(vectors: DataFrame, hashes: DataFrame) -> DataFrame:
    return vectors.join(hashes, "hash", "left_anti")


def upserted(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows with those of the same key replaced by the new ones."""
    return stored.join(new.select(*key), key, "left_anti").unionByName(new)


def embed(contents: DataFrame, embedder: Embedder, tokens: int = TOKENS, profile: str = "embeddinggemma") -> DataFrame:
    """``(hash, seq, pos, model, embedding, embedded_at)`` of ``hash, title, doc`` rows.

    Chunks are made and embedded in Arrow batches; a worker loads the model once.
    """
    pieces = chunked(contents.withColumn("title", F.coalesce("title", F.lit(""))), "hash", "doc", tokens, ["title"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"hash": batch["hash"], "seq": batch["seq"], "pos": batch["pos"], "embedding": [v.tolist() for v in embedder.embed_documents(batch["prompt"].tolist())]})

    made = pieces.select("hash", "seq", "pos", document_prompt(F.col("title"), F.col("text"), profile).alias("prompt")).mapInPandas(run, "hash string, seq int, pos long, embedding array<float>")
    return made.select("hash", "seq", "pos", F.lit(embedder.model_id).alias("model"), "embedding", F.current_timestamp().alias("embedded_at"))
