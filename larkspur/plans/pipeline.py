"""The search pipeline: full text, vectors, fusion, gates, expansion, reranking."""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..functions.scalars import QUERY_FORMATS, doc_id
from ..operators import fulltext, fusion, postings, rerank, vectors
from ..operators.expansion import expand_all
from ..operators.models import Embedder, QueryExpander, Scorer

logger = logging.getLogger(__name__)
#: What ``all results`` means.
ALL = 4096


@dataclass
class Outcome:
    results: DataFrame
    log: list[str] = field(default_factory=list)


class SearchSession:
    """Searches over one index; each stage is a lazy plan, and only gates look at a query's first two rows.

    docs: active ``collection, path, title, body, hash``; chunks: ``hash, embedding``; content: ``hash, doc``.  With an ``index``
    full text is answered from it, and texts are read for snippets only.
    """

    def __init__(self, docs: DataFrame, chunks: DataFrame | None = None, content: DataFrame | None = None, embedder: Embedder | None = None, expander: QueryExpander | None = None, scorer: Scorer | None = None, cache: DataFrame | None = None, analyzer: str = "porter", profile: str = "embeddinggemma", index: postings.Index | None = None) -> None:
        self.docs, self.chunks, self.content = docs, chunks, content
        self.embedder, self.expander, self.scorer, self.cache = embedder, expander, scorer, cache
        self.analyzer, self.profile, self.index = index.analyzer if index is not None else analyzer, profile, index
        self.new_scores: list[DataFrame] = []

    def _one(self, found: DataFrame, limit: int) -> DataFrame:
        return fusion.top(found.select(F.lit(0).alias("query_id"), "collection", "path", "score"), limit)

    def _bm25(self, query: str, limit: int) -> DataFrame:
        """Per collection the best ``limit``, collections one after another in the order of the ranks they get."""
        found = fulltext.matches(self.docs, fulltext.parse_query(query, self.analyzer), self.analyzer) if self.index is None else postings.matches(self.index, query)
        return self._in_order(fulltext.per_collection(found, limit))

    def _full_text(self, query: str, limit: int, min_score: float | None) -> DataFrame:
        if self.index is None:
            return fulltext.search(self.docs, query, limit, min_score, self.analyzer, snippets=True)
        return postings.search(self.index, query, limit, min_score, bodies=self.docs)

    def _vector(self, text: str, limit: int) -> DataFrame:
        """Best documents of each collection among its nearest ``4 * limit`` chunks."""
        best = vectors.best_chunks(self.chunks, self.docs, self.embedder.embed_query(text).tolist(), 4 * limit)
        return self._in_order(fulltext.per_collection(best, limit))

    def _in_order(self, found: DataFrame) -> DataFrame:
        rank = F.expr("row_number() over (partition by query_id order by collection, score desc, path)")
        return found.select(F.lit(0).alias("query_id"), "collection", "path", "score").withColumn("rank", rank)

    def _described(self, ranked: DataFrame) -> DataFrame:
        meta = self.docs.select("collection", "path", "title", "hash")
        return ranked.drop("query_id", "rank").join(meta, ["collection", "path"]).withColumn("doc_id", doc_id(F.col("hash"))).orderBy(F.desc("score"), "collection", "path")

    def search(self, query: str, limit: int = 10, mode: str = "hybrid", min_score: float | None = None, collections: Sequence[str] = ()) -> Outcome:
        """``mode`` is bm25, vector (or vec) or hybrid."""
        if mode not in ("bm25", "vector", "vec", "hybrid"):
            raise InvalidQuery(f"no such mode: {mode}")
        session = self if not collections else SearchSession(self.docs.where(F.col("collection").isin(*collections)), self.chunks, self.content, self.embedder, self.expander, self.scorer, self.cache, self.analyzer, self.profile, self.index.within(collections) if self.index is not None else None)
        if mode == "bm25":
            return Outcome(session._full_text(query, limit, min_score))
        text = QUERY_FORMATS[self.profile].format(query=query)
        if mode in ("vector", "vec"):
            found = vectors.search(session.chunks, session.docs, session.embedder.embed_query(text).tolist(), limit, min_score)
            return Outcome(found.withColumn("doc_id", doc_id(F.col("hash"))))
        session.new_scores = self.new_scores
        return session._hybrid(query, text, limit, min_score)

    def _hybrid(self, query: str, text: str, limit: int, min_score: float | None) -> Outcome:
        log, began = [], time.perf_counter()

        def done(line: str) -> list[str]:
            """The log with one more line; the time since the start goes to the logger."""
            log.append(line)
            logger.info("%s after %.2f s", line, time.perf_counter() - began)
            return log

        direct = self._full_text(query, limit, min_score)
        first = self._one(direct, limit)
        if first.count() and fusion.strong_bm25(first).first()["strong"]:
            return Outcome(direct, done("full text is sure of itself"))
        if self.embedder is None:
            return Outcome(direct, done("no embedder: full text only"))
        fused = fusion.linear(self._bm25(query, 3 * limit), self._vector(text, 3 * limit), 2 * limit)
        seen = fused.limit(1).count()
        if seen and fusion.strong_fused(fused).first()["strong"]:
            return Outcome(self._described(fusion.at_least(fused.where(F.col("rank") <= limit), min_score)), done("fusion is sure of itself"))
        ranked = fused
        if self.scorer is not None:
            if self.expander is not None:
                subs, _ = expand_all([query], self.expander)[query]
                done(f"{len(subs)} sub-queries")
                ranked = self._sub_queries(subs, fused, limit)
            hashes = self.docs.select("collection", "path", "hash")
            queries = self.docs.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
            cache = self.cache if self.cache is not None else queries.sparkSession.createDataFrame([], "key string, score double, created_at timestamp")
            ranked, made = rerank.rerank(ranked.join(hashes, ["collection", "path"]), queries, self.content, cache, self.scorer, limit)
            ranked = ranked.select("query_id", "collection", "path", "score", "rank")
            self.new_scores.append(made)
            done("reranked")
        return Outcome(self._described(fusion.at_least(ranked.where(F.col("rank") <= limit), min_score)), log)

    def _sub_queries(self, subs, fused: DataFrame, limit: int) -> DataFrame:
        lists = []
        for kind, text in sorted(subs, key=lambda s: s[0] != "lex"):
            try:
                ranked = self._bm25(text, 2 * limit) if kind == "lex" else self._vector(text, 2 * limit)
            except InvalidQuery:
                continue
            lists.append(fusion.as_list(ranked, len(lists), fusion.RRF_WEIGHTS[kind]))
        lists.append(fusion.as_list(fused, len(lists), fusion.RRF_WEIGHTS["base"]))
        return fusion.rrf(reduce(DataFrame.unionByName, lists), 2 * limit)
