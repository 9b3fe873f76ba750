"""Interfaces of the models a caller may plug in, and deterministic stand-ins that need none."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from typing import Protocol

import numpy as np

from ..errors import EngineError
from .expansion import SubQuery, fallback


class Embedder(Protocol):
    """Texts to vectors of one width."""

    model_id: str

    def embed_query(self, text: str) -> np.ndarray: ...

    def embed_documents(self, texts: Sequence[str]) -> list[np.ndarray]: ...


class QueryExpander(Protocol):
    """A query to typed sub-queries."""

    model_id: str

    def expand_query(self, query: str) -> list[SubQuery]: ...


class Scorer(Protocol):
    """Relevance of texts to a query, from 0 to 1."""

    model_id: str

    def score_batch(self, query: str, texts: Sequence[str]) -> list[float]: ...


#: How a model makes one vector of its tokens' vectors.
POOLING = ("none", "mean", "cls", "last", "rank")


def pooling_of(model_path: str, override: str | None = None) -> str | None:
    """Pooling mode of a model: what is asked for, cls for BGE models, else None, the model's own."""
    if override is not None and override not in POOLING:
        raise EngineError(f"pooling is one of {', '.join(POOLING)}")
    return override or ("cls" if "bge" in model_path.lower().rsplit("/", 1)[-1] else None)


def embed_queries(embedder: Embedder, texts: Sequence[str]) -> list[np.ndarray]:
    """Vectors of queries, in one go where the model can."""
    batch = getattr(embedder, "embed_query_batch", None)
    return list(batch(texts)) if batch else [embedder.embed_query(t) for t in texts]


def resized(vector: np.ndarray, width: int) -> np.ndarray:
    """A vector cut or filled with zeros to the width, and of unit length again."""
    out = np.zeros(width, np.float32)
    out[: min(width, len(vector))] = vector[:width]
    size = float(np.sqrt((out * out).sum()))
    return out / size if size > 1e-10 else out


_WORDS = re.compile(r"[^\W_]+")


class HashingEmbedder:
    """Counts of hashed words with signs, L2-normalized; a text without words gives the zero vector."""

    def __init__(self, width: int = 64) -> None:
        self.width, self.model_id = width, f"hashing-{width}"

    def embed_query(self, text: str) -> np.ndarray:
        v = np.zeros(self.width, np.float32)
        for w in _WORDS.findall(text.lower()):
            h = zlib.crc32(w.encode())
            v[h % self.width] += 1 if h & 0x10000 else -1
        size = float(np.sqrt((v * v).sum()))
        return v / size if size > 1e-10 else v

    def embed_documents(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [self.embed_query(t) for t in texts]


class OverlapScorer:
    """Share of the query's words that a text has."""

    model_id = "overlap"

    def score_batch(self, query: str, texts: Sequence[str]) -> list[float]:
        wanted = set(_WORDS.findall(query.lower()))
        return [len(wanted & set(_WORDS.findall(t.lower()))) / len(wanted) if wanted else 0.0 for t in texts]


class FallbackExpander:
    """The expansion used when a model gives nothing usable."""

    model_id = "fallback"

    def expand_query(self, query: str) -> list[SubQuery]:
        return fallback(query)
