"""Evaluating retrieval on a judged corpus: every stage works on the whole query set."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.chunking import TOKENS
from ..functions.scalars import eval_text, query_prompt
from ..operators import evaluation, fulltext, fusion, postings, rerank, vectors
from ..operators.embedding import embed
from ..operators.models import Embedder, Scorer, embed_queries
from ..storage import cut

COLLECTION = "eval"


@dataclass(frozen=True)
class Config:
    """Settings of a run; all of them are part of its cache key."""

    mode: str = "hybrid"
    k: int = 10
    alpha: float = fusion.ALPHA
    adaptive: bool = False
    normalizer: float = 0.20
    title_weight: float = 1.0
    fuse: str = "linear"  # or rrf, or score for weighted pools
    rrf_k: float = fusion.RRF_K
    lex_weight: float = 1.0
    vec_weight: float = 1.5
    hyde_weight: float = 1.0
    prf: bool = False
    prf_weight: float = evaluation.PRF_WEIGHT
    prf_docs: int = evaluation.PRF_DOCS
    prf_terms: int = evaluation.PRF_TERMS
    rerank_weight: float = rerank.WEIGHT
    rerank_top: int = rerank.TOP
    analyzer: str = "porter"
    profile: str = "generic"
    chunk_tokens: int = TOKENS

    def __post_init__(self) -> None:
        for name in ("alpha", "prf_weight", "rerank_weight"):
            if not 0 <= getattr(self, name) <= 1:
                raise EngineError(f"{name} must be from 0 to 1")
        if self.normalizer <= 0 or self.k < 1 or min(self.lex_weight, self.vec_weight, self.hyde_weight) < 0:
            raise EngineError("normalizer and k must be positive, weights not negative")
        if self.mode not in ("bm25", "vector", "hybrid") or self.fuse not in ("linear", "rrf", "score"):
            raise EngineError(f"no such mode: {self.mode}/{self.fuse}")


class Evaluation:
    """One corpus with its judged queries.

    corpus: ``_id, title, text``; queries: ``query_id, text``; qrels: ``query_id, doc, relevance``; subs:
    optional sub-queries ``query_id, seq, kind, text``.
    """

    def __init__(self, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, embedder: Embedder | None = None, scorer: Scorer | None = None, subs: DataFrame | None = None, chunks: DataFrame | None = None, query_vectors: DataFrame | None = None) -> None:
        self.docs = corpus.select(F.lit(COLLECTION).alias("collection"), F.col("_id").alias("path"), "title", F.col("text").alias("body"), F.sha2(F.concat_ws(":", "_id", eval_text(F.col("title"), F.col("text"))), 256).alias("hash"))
        self.qrels, self.queries = qrels, queries.join(qrels.select("query_id"), "query_id", "left_semi")
        self.embedder, self.scorer, self.subs, self._chunks = embedder, scorer, subs, chunks
        #: Known ``model, prompt, embedding`` of queries, and those that were made for want of them.
        self.query_vectors, self.new_query_vectors = query_vectors, []
        self._indexes: dict[str, postings.Index] = {}

    def chunks(self, config: Config) -> DataFrame:
        """``hash, embedding`` of the corpus; embedded when none were given."""
        if self._chunks is None:
            self._chunks = embed(self.docs.select("hash", "title", F.col("body").alias("doc")), self.embedder, config.chunk_tokens, config.profile).select("hash", "embedding")
        return self._chunks

    def _bm25(self, queries: DataFrame, limit: int, config: Config) -> DataFrame:
        phrases = fulltext.phrase_rows(queries, analyzer=config.analyzer)
        if config.analyzer not in self._indexes:
            self._indexes[config.analyzer] = postings.Index.of(self.docs, config.analyzer)
        return postings.search_batch(self._indexes[config.analyzer], phrases, limit, {"title": config.title_weight})

    def _vector(self, queries: DataFrame, limit: int, config: Config) -> DataFrame:
        """Best chunk per document among each query's nearest ``4 * limit`` chunks."""
        embedder = self.embedder

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"prompt": batch["prompt"], "embedding": [v.tolist() for v in embed_queries(embedder, batch["prompt"].tolist())]})

        prompts = queries.select("query_id", query_prompt(F.col("text"), config.profile).alias("prompt"))
        wanted = prompts.select("prompt").distinct()
        if self.query_vectors is None:
            made = wanted.mapInPandas(run, "prompt string, embedding array<float>")
        else:
            known = self.query_vectors.where(F.col("model") == embedder.model_id).groupBy("prompt").agg(F.first("embedding").alias("embedding"))
            new = cut(wanted.join(known, "prompt", "left_anti").mapInPandas(run, "prompt string, embedding array<float>"))
            self.new_query_vectors.append(new.select(F.lit(embedder.model_id).alias("model"), "prompt", "embedding"))
            made = known.join(wanted, "prompt", "left_semi").unionByName(new)
        asked = prompts.join(made, "prompt").select("query_id", "embedding")
        width = len(embedder.embed_query("width"))
        near = vectors.knn_batch(self.chunks(config), asked, min(4 * limit, vectors.FETCH_MOST), "hash", width=width)
        places = self.docs.groupBy("hash").agg(F.min("path").alias("path"))
        best = near.groupBy("query_id", "hash").agg(F.max("score").alias("score")).join(places, "hash")
        return fusion.top(best.select("query_id", F.lit(COLLECTION).alias("collection"), "path", "score"), limit)

    def _sub_results(self, limit: int, config: Config) -> DataFrame:
        """Ranked results of all sub-queries at once, with their ``kind`` and ``n``, the place among those of their kind."""
        numbered = self.subs.withColumn("n", F.expr("row_number() over (partition by query_id, kind order by seq)"))
        place = F.struct("query_id", "kind", "n")
        shape = numbered.select(place.alias("p")).schema["p"].dataType.simpleString()
        numbered = numbered.select(F.to_json(place).alias("query_id"), "text", "kind")
        lex = self._bm25(numbered.where("kind = 'lex'"), limit, config)
        near = self._vector(numbered.where("kind in ('vec', 'hyde')"), limit, config)
        columns = ["query_id", "collection", "path", "score", "rank"]
        return lex.select(columns).unionByName(near.select(columns)).withColumn("query_id", F.from_json("query_id", shape)).select("query_id.*", *columns[1:])

    def ranked(self, config: Config) -> DataFrame:
        """``query_id, collection, path, score, rank`` of every query."""
        fetch = max(2 * config.k, config.rerank_top) if self.scorer else config.k
        if config.mode == "bm25":
            found = self._bm25(self.queries, fetch, config)
        elif config.mode == "vector":
            found = self._vector(self.queries, fetch, config)
        else:
            found = self._hybrid(fetch, config)
        if config.prf:
            found = self._with_feedback(found, fetch, config)
        if self.scorer is not None:
            hashed = found.join(self.docs.select("collection", "path", "hash"), ["collection", "path"])
            content = self.docs.select("hash", eval_text(F.col("title"), F.col("body")).alias("doc"))
            cache = found.sparkSession.createDataFrame([], "key string, score double, created_at timestamp")
            found, _ = rerank.rerank(hashed, self.queries, content, cache, self.scorer, None, config.rerank_top, config.rerank_weight)
        return found.where(F.col("rank") <= config.k).select("query_id", "collection", "path", "score", "rank")

    def _hybrid(self, limit: int, config: Config) -> DataFrame:
        bm25, vector = self._bm25(self.queries, 3 * limit, config), self._vector(self.queries, 3 * limit, config)
        weights = {"lex": config.lex_weight, "vec": config.vec_weight, "hyde": config.hyde_weight}
        if self.subs is not None:
            lists = self._sub_results(3 * limit, config)
            if config.fuse == "score":
                return fusion.pooled(lists, bm25, vector, weights, limit, config.alpha)
            worth = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("kind")]
            return fusion.rrf(lists.select("query_id", F.concat("kind", "n").alias("list_id"), worth.alias("weight"), "collection", "path", (F.col("rank") - 1).alias("rank0")), limit, config.rrf_k)
        if config.fuse == "rrf":
            return self._rrf([fusion.as_list(bm25, 0, config.lex_weight), fusion.as_list(vector, 1, config.vec_weight)], limit, config)
        if config.adaptive:
            alphas = fusion.adaptive_alpha(self.queries, bm25, vector, config.alpha, config.normalizer)
            both = [df.select("query_id", "collection", "path", "score") for df in (bm25, vector)]
            keyed = [df.join(alphas, "query_id").withColumn("query_id", F.struct("query_id", "alpha")).drop("alpha") for df in both]
            fused = fusion.linear(keyed[0], keyed[1], limit, F.col("query_id.alpha"))
            return fused.withColumn("query_id", F.col("query_id.query_id"))
        return fusion.linear(bm25, vector, limit, config.alpha)

    def _rrf(self, parts: list[DataFrame], limit: int, config: Config) -> DataFrame:
        lists = parts[0]
        for part in parts[1:]:
            lists = lists.unionByName(part)
        return fusion.rrf(lists, limit, config.rrf_k)

    def _with_feedback(self, found: DataFrame, limit: int, config: Config) -> DataFrame:
        seeds = self._bm25(self.queries, config.prf_docs, config)
        texts = self.docs.select("collection", "path", eval_text(F.col("title"), F.col("body")).alias("text"))
        longer = evaluation.feedback_queries(self.queries, evaluation.feedback(seeds, texts, self.queries, config.prf_docs, config.prf_terms))
        again = self._bm25(longer, 3 * limit, config)
        return fusion.linear(again, found, limit, 1 - config.prf_weight)

    def scores(self, config: Config) -> DataFrame:
        """``query_id, ndcg, recall``."""
        return evaluation.metrics(self.ranked(config).withColumnRenamed("path", "doc"), self.qrels, config.k)

    def summary(self, config: Config) -> DataFrame:
        return evaluation.means(self.scores(config))

    def tuned_alpha(self, config: Config) -> DataFrame:
        """``(alpha, ndcg, recall, n_queries)`` over the grid, both sides searched once."""
        fetch = 3 * config.k
        sides = (self._bm25(self.queries, fetch, config), self._vector(self.queries, fetch, config))
        return evaluation.tuned(*sides, self.qrels, config.k, doc=F.col("path"))

    def tuned_rerank(self, config: Config) -> DataFrame:
        """``(weight, ndcg, recall, n_queries)`` over the grid, searched and judged once."""
        from dataclasses import replace

        fetch = max(2 * config.k, config.rerank_top)
        found = cut(Evaluation.ranked(self._without_scorer(), replace(config, k=fetch)))
        hashed = found.join(self.docs.select("collection", "path", "hash"), ["collection", "path"])
        content = self.docs.select("hash", eval_text(F.col("title"), F.col("body")).alias("doc"))
        rows = rerank.keyed(hashed, self.queries, self.scorer.model_id, config.rerank_top)
        judged = cut(rows.join(rerank.score_misses(rows.withColumn("rerank", F.lit(None).cast("double")), content, self.scorer).withColumnRenamed("score", "rerank"), "key").select("query_id", "collection", "path", "rerank"))
        return evaluation.tuned_rerank(found, judged, self.qrels, config.k)

    def _without_scorer(self) -> Evaluation:
        out = Evaluation.__new__(Evaluation)
        out.__dict__ = self.__dict__ | {"scorer": None}
        return out

    def compared(self, a: Config, b: Config) -> DataFrame:
        """Paired t-test of b against a."""
        return evaluation.paired_t(self.scores(a), self.scores(b))

    def cached_scores(self, config: Config, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Scores with those stored for the same settings taken over, and the rows to store.

        cache: ``run_key, query_id, ndcg, recall``; rows of queries that are no longer asked take no part.
        """
        settings = asdict(config)
        known = cache.where(F.col("run_key") == evaluation.run_key(settings)).join(self.queries.select("query_id"), "query_id", "left_semi").select("query_id", "ndcg", "recall")
        rest = Evaluation.__new__(Evaluation)
        rest.__dict__ = self.__dict__ | {"queries": evaluation.uncached(self.queries, cache, settings)}
        rest.qrels = self.qrels.join(rest.queries.select("query_id"), "query_id", "left_semi")
        new = rest.scores(config)
        return known.unionByName(new), new.withColumn("run_key", F.lit(evaluation.run_key(settings)))
