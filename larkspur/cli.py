"""The command line: ``python -m larkspur.cli``."""

from __future__ import annotations

import argparse
import json
import os
import shlex
import sys
import time
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from .errors import EngineError
from .functions.chunking import TOKENS
from .operators import rerank
from .operators.evaluation import best, means
from .operators.expansion import expand_all
from .operators.ingest import SnapshotStore
from .operators.models import POOLING, FallbackExpander, pooling_of
from .operators.output import chosen_format, render
from .plans.engine import Engine
from .plans.evaluate import Config, Evaluation
from .plans.pipeline import ALL
from .session import local_session
from .sources import beir
from .sources.registry import Collection
from .storage import cut


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkspur")
    p.add_argument("--index", help="folder of indexes and caches, on any file system; needed on a cluster")
    p.add_argument("--home", default=os.environ.get("LARKSPUR_HOME", os.path.expanduser("~/.larkspur")))
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("update", "embed"):
        c = commands.add_parser(name)
        c.add_argument("collection", nargs="?")
        c.add_argument("-f", "--force", action="store_true")
    s = commands.add_parser("search")
    s.add_argument("query", nargs="+")
    s.add_argument("--mode", default="hybrid", choices=("bm25", "vector", "vec", "hybrid"))
    s.add_argument("-n", "--limit", type=int, default=10)
    s.add_argument("--min-score", type=float)
    s.add_argument("-c", "--collection", action="append", default=[])
    for flag in ("--all", "--full", "--json", "--csv", "--md", "--files"):
        s.add_argument(flag, action="store_true")
    s.add_argument("-v", "--verbose", action="store_true")
    commands.add_parser("get").add_argument("target")
    commands.add_parser("status")
    c = commands.add_parser("collection").add_subparsers(dest="action", required=True)
    add = c.add_parser("add")
    add.add_argument("name")
    add.add_argument("path")
    add.add_argument("--glob", action="append", default=[])
    add.add_argument("--exclude", action="append", default=[])
    add.add_argument("--description")
    rm = c.add_parser("rm")
    rm.add_argument("name")
    rm.add_argument("--purge", action="store_true")
    for name, second in (("rename", "new"), ("set-path", "path")):
        x = c.add_parser(name)
        x.add_argument("name")
        x.add_argument(second)
    c.add_parser("ls")
    e = commands.add_parser("eval")
    e.add_argument("--data", required=True)
    e.add_argument("--mode", default="hybrid", choices=("bm25", "vector", "hybrid", "all"))
    for flag, default in (("alpha", 0.8), ("title-weight", 1.0), ("rrf-k", 60.0), ("rrf-lex-weight", 1.0), ("rrf-vec-weight", 1.5), ("rrf-hyde-weight", 1.0), ("alpha-normalizer", 0.2), ("prf-weight", 0.3)):
        e.add_argument(f"--{flag}", type=float, default=default)
    for flag, default in (("limit", 10), ("prf-docs", 3), ("prf-terms", 10), ("max-docs", 0), ("max-queries", 0), ("rerank-top-n", 20), ("chunk-size", TOKENS)):
        e.add_argument(f"--{flag}", type=int, default=default)
    e.add_argument("--fuse", default="linear", choices=("linear", "rrf", "score"))
    for flag in ("--compare-alpha", "--rerank-weight", "--rerank-fusion-weight"):
        e.add_argument(flag, type=float)
    e.add_argument("--pooling", choices=POOLING)
    e.add_argument("--cache-db", help="a folder that keeps query vectors and results")
    for flag in ("--adaptive-alpha", "--prf", "--rerank", "--expander", "--tune-alpha", "--tune-rerank"):
        e.add_argument(flag, action="store_true")
    b = commands.add_parser("bench", help="evaluate several settings: name or name:--flag value ...")
    b.add_argument("--data", required=True)
    b.add_argument("specs", nargs="+")
    x = commands.add_parser("export", help="write training pairs of an evaluation corpus")
    x.add_argument("--data", required=True)
    x.add_argument("--out", required=True)
    x.add_argument("--name", required=True)
    return p


def _read(spark, a: argparse.Namespace):
    corpus, queries = beir.read_corpus(spark, f"{a.data}/corpus.jsonl"), beir.read_queries(spark, f"{a.data}/queries.jsonl")
    return corpus, queries, beir.read_qrels(spark, f"{a.data}/qrels/test.tsv")


def _evaluate(spark, engine: Engine, a: argparse.Namespace) -> dict:
    corpus, queries, qrels = _read(spark, a)
    corpus, queries = beir.in_file_order(corpus, a.max_docs), beir.in_file_order(queries, a.max_queries)
    weight = a.rerank_weight if a.rerank_weight is not None else rerank.WEIGHT if a.rerank_fusion_weight is None else 1 - a.rerank_fusion_weight
    config = Config(mode="hybrid" if a.mode == "all" else a.mode, k=a.limit, alpha=a.alpha, adaptive=a.adaptive_alpha, normalizer=a.alpha_normalizer, title_weight=a.title_weight, fuse=a.fuse, rrf_k=a.rrf_k, lex_weight=a.rrf_lex_weight, vec_weight=a.rrf_vec_weight, hyde_weight=a.rrf_hyde_weight, prf=a.prf, prf_weight=a.prf_weight, prf_docs=a.prf_docs, prf_terms=a.prf_terms, rerank_weight=weight, rerank_top=a.rerank_top_n, chunk_tokens=a.chunk_size)
    embedder = engine.embedder
    if a.pooling and hasattr(embedder, "set_pooling"):
        embedder.set_pooling(pooling_of(embedder.model_id, a.pooling))
    subs = None
    if a.expander:
        found = expand_all([r["text"] for r in queries.select("text").distinct().collect()], engine.expander or FallbackExpander())
        rows = [(text, i, s.kind, s.text) for text, (own, _) in found.items() for i, s in enumerate(own)]
        subs = queries.join(spark.createDataFrame(rows, "_t string, seq int, kind string, sub string"), F.col("text") == F.col("_t")).select("query_id", "seq", "kind", F.col("sub").alias("text"))
    cache = SnapshotStore(spark, a.cache_db if "://" in a.cache_db else f"file://{os.path.abspath(a.cache_db)}") if a.cache_db else None
    known = (cache.read("query_vectors") if cache else None) or (spark.createDataFrame([], "model string, prompt string, embedding array<float>") if cache else None)
    run = Evaluation(corpus, queries, qrels, embedder, engine.scorer if a.rerank else None, subs, query_vectors=known)
    out = {}
    for mode in ("bm25", "vector", "hybrid") if a.mode == "all" else (a.mode,):
        own = replace(config, mode=mode)
        if cache is None:
            row = run.summary(own).first()
        else:
            stored = cache.read("results")
            scores, new = run.cached_scores(own, stored if stored is not None else spark.createDataFrame([], "run_key string, query_id string, ndcg double, recall double"))
            row, made = means(scores).first(), {"results": new.select("run_key", "query_id", "ndcg", "recall")}
            if run.new_query_vectors:
                made["query_vectors"] = run.new_query_vectors[-1]
            cache.commit(appended=made)
        out[mode] = row.asDict()
    if a.mode != "all":
        out = out[a.mode]
    if a.compare_alpha is not None:
        row = run.compared(config, replace(config, alpha=a.compare_alpha)).first()
        out["compared"] = row.asDict() if row else None
    for asked, name, grid in ((a.tune_alpha, "alpha", run.tuned_alpha), (a.tune_rerank, "weight", run.tuned_rerank)):
        if asked:
            run.scorer = run.scorer or engine.scorer
            rows = cut(grid(config))
            out[f"tuned_{name}"] = {"grid": [r.asDict() for r in rows.orderBy(name).collect()], "best": best(rows, name).first()[name]}
    return out


def _bench(spark, engine: Engine, a: argparse.Namespace) -> str:
    """One line of quality per setting; a setting that fails is named and the others go on."""
    lines = [f"{'run':20}  {'nDCG':>10}  {'recall':>10}  {'s':>7}"]
    for spec in a.specs:
        name, _, flags = spec.partition(":")
        began = time.perf_counter()
        try:
            row = _evaluate(spark, engine, parser().parse_args(["eval", "--data", a.data, *shlex.split(flags)]))
            lines.append(f"{name:20}  {row['ndcg']:>10.4f}  {row['recall']:>10.4f}  {time.perf_counter() - began:>7.1f}")
        except (EngineError, SystemExit) as error:
            lines.append(f"{name:20}  {'FAILED':>10}  {error}")
    return "\n".join(lines)


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    spark = spark or local_session()
    engine = Engine(spark, a.home, index=a.index)
    try:
        if a.command in ("update", "embed"):
            for name in [a.collection] if a.collection else engine.registry.names():
                print(name, json.dumps(getattr(engine, a.command)(name, a.force)))
        elif a.command == "search":
            outcome = engine.search(" ".join(a.query), a.collection, ALL if a.all else a.limit, a.mode, a.min_score)
            rows = [r.asDict() for r in outcome.results.collect()]
            if a.full:
                rows = [r | {"doc": engine.get(f"{r['collection']}/{r['path']}")} for r in rows]
            print(render(rows, chosen_format(a.json, a.csv, a.md, a.files), a.full))
            if a.verbose:
                print("\n".join(outcome.log), file=sys.stderr)
        elif a.command == "get":
            print(engine.get(a.target))
        elif a.command == "status":
            for row in engine.status():
                print(json.dumps(row))
        elif a.command == "eval":
            print(json.dumps(_evaluate(spark, engine, a)))
        elif a.command == "bench":
            print(_bench(spark, engine, a))
        elif a.command == "export":
            print(json.dumps(beir.export_training(*_read(spark, a), a.out, a.name)))
        elif a.action == "add":
            engine.add(Collection(a.name, os.path.realpath(a.path), a.glob, a.exclude, a.description))
        elif a.action == "rm":
            engine.remove(a.name, a.purge)
        elif a.action == "rename":
            engine.rename(a.name, a.new)
        elif a.action == "set-path":
            engine.registry.set_path(a.name, a.path)
        else:
            print("\n".join(engine.registry.names()))
    except EngineError as error:
        print(f"error: {type(error).__name__}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
