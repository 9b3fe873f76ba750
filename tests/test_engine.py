"""The command line and the evaluation over small collections."""

import json

import numpy as np
import pytest

from larkspur import cli
from larkspur.errors import EngineError
from larkspur.operators import evaluation
from larkspur.operators.expansion import SubQuery
from larkspur.operators.models import HashingEmbedder, OverlapScorer
from larkspur.plans.engine import Engine
from larkspur.plans.evaluate import Config, Evaluation
from larkspur.sources.registry import Collection


def test_command_line(spark, tmp_path, capsys):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("# Rust memory\n\nOwnership and borrowing keep memory safe.\n")
    (notes / "b.md").write_text("# Cooking\n\nStir the soup, then taste it.\n")
    (notes / "c.md").write_text("# Garden\n\nWater the beds in the evening.\n")

    def run(*args):
        code = cli.main(["--home", str(tmp_path / "home"), *args], spark)
        out = capsys.readouterr()
        return code, out.out.strip(), out.err

    assert run("collection", "add", "notes", str(notes))[0] == 0
    assert run("collection", "add", "notes", str(notes))[0] == 1
    assert json.loads(run("update")[1].split(" ", 1)[1]) == {"added": 3, "updated": 0, "deactivated": 0}
    assert json.loads(run("embed")[1].split(" ", 1)[1]) == {"documents": 3, "chunks": 3}
    (notes / "c.md").unlink()
    (notes / "b.md").write_text("# Cooking\n\nBake the bread.\n")
    assert json.loads(run("update", "notes")[1].split(" ", 1)[1]) == {"added": 0, "updated": 1, "deactivated": 1}
    assert json.loads(run("embed")[1].split(" ", 1)[1]) == {"documents": 1, "chunks": 1}
    for mode in ("bm25", "vector", "hybrid"):
        assert run("search", "rust", "memory", "--mode", mode, "--files")[1].split("\n")[0] == "a.md"
    assert json.loads(run("search", "memory", "--json", "--mode", "bm25")[1])[0]["title"] == "Rust memory"
    assert "Ownership" in run("search", "memory", "--full", "--mode", "bm25")[1]
    assert run("search", "--", "-memory")[0] == 1 and run("search", "x", "-c", "none")[0] == 1
    assert run("get", "notes/a.md")[1].startswith("# Rust") and run("get", "notes/none.md")[0] == 1
    assert run("collection", "rename", "notes", "log")[0] == 0
    assert json.loads(run("search", "bread", "--json", "--mode", "bm25")[1])[0]["collection"] == "log"
    status = json.loads(run("status")[1])
    assert status["name"] == "log" and status["indexed"]
    assert run("collection", "rm", "log", "--purge")[0] == 0 and run("collection", "ls")[1] == ""


def test_caches(spark, tmp_path):
    class Counting:
        model_id, calls = "counting", 0

        def expand_query(self, query):
            self.calls += 1
            return [SubQuery("lex", "memory"), SubQuery("vec", query)]

    class CountingScorer(OverlapScorer):
        pass

    notes = tmp_path / "notes"
    notes.mkdir()
    for i, text in enumerate(["memory of summer", "fire and soup", "memory fire", "garden", "train", "tables", "chairs"]):
        (notes / f"{i}.md").write_text(f"# Note {i}\n\n{text}\n")
    expander = Counting()
    engine = Engine(spark, str(tmp_path / "home"), scorer=CountingScorer(), expander=expander)
    engine.add(Collection("notes", str(notes)))
    engine.update("notes")
    engine.embed("notes")
    first = [r["path"] for r in engine.search("memory garden", limit=3).results.collect()]
    stored = engine.caches.read("scores").count()
    assert expander.calls == 1 and stored > 0
    assert [r["path"] for r in engine.search(" Memory Garden ", limit=3).results.collect()] == first
    assert expander.calls == 1 and engine.caches.read("scores").count() == stored


@pytest.fixture(scope="module")
def run(spark):
    topics = ["rust memory safety", "garden flower bed", "train table delay", "soup bread oven"]
    corpus = spark.createDataFrame([(f"d{i}", f"note {i}", f"{topics[i % 4]} number{i} words about {topics[i % 4]}") for i in range(40)], "_id string, title string, text string")
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(topics)] + [("q9", "unjudged")], "query_id string, text string")
    qrels = spark.createDataFrame([(f"q{i % 4}", f"d{i}", 1 + i % 2) for i in range(40)], "query_id string, doc string, relevance int")
    subs = spark.createDataFrame([(f"q{i}", s, k, t.split()[0]) for i, t in enumerate(topics) for s, k in enumerate(("lex", "vec", "hyde"))], "query_id string, seq int, kind string, text string")
    return corpus, queries, qrels, subs


def test_evaluation(spark, run):
    corpus, queries, qrels, subs = run
    plain = Evaluation(corpus, queries, qrels, HashingEmbedder())
    for config in (Config(mode="bm25"), Config(mode="vector"), Config(), Config(adaptive=True), Config(fuse="rrf"), Config(prf=True)):
        row = plain.summary(config).first()
        assert row["n_queries"] == 4 and row["ndcg"] > 0.5 and 0 < row["recall"] <= 1
    for config in (Config(fuse="rrf"), Config(fuse="score")):
        assert Evaluation(corpus, queries, qrels, HashingEmbedder(), OverlapScorer(), subs).summary(config).first()["ndcg"] > 0.5
    row = plain.compared(Config(alpha=0.8), Config(alpha=0.8)).first()
    assert row["mean_diff"] == 0 and row["n"] == 4
    cache = spark.createDataFrame([(evaluation.run_key({}), "q0", 0.0, 0.0)], "run_key string, query_id string, ndcg double, recall double")
    scores, new = plain.cached_scores(Config(mode="bm25"), cache)
    assert new.count() == 4
    again, none = plain.cached_scores(Config(mode="bm25"), new.select("run_key", "query_id", "ndcg", "recall"))
    assert none.count() == 0 and np.isclose(evaluation.means(again).first()["ndcg"], evaluation.means(scores).first()["ndcg"])
    for bad in ({"alpha": 2}, {"k": 0}, {"mode": "x"}, {"normalizer": 0}):
        with pytest.raises(EngineError):
            Config(**bad)


def test_evaluation_command(spark, run, tmp_path, capsys):
    corpus, queries, qrels, _ = run
    data = tmp_path / "data"
    (data / "qrels").mkdir(parents=True)
    (data / "corpus.jsonl").write_text("\n".join(json.dumps(r.asDict()) for r in corpus.collect()))
    (data / "queries.jsonl").write_text("\n".join(json.dumps({"_id": r["query_id"], "text": r["text"]}) for r in queries.collect()))
    (data / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\n" + "\n".join(f"{r['query_id']}\t{r['doc']}\t{r['relevance']}" for r in qrels.collect()))

    def command(*args):
        code = cli.main(["--home", str(tmp_path / "home"), *args], spark)
        return code, capsys.readouterr().out.strip()

    cache = str(tmp_path / "cache")
    first = json.loads(command("eval", "--data", str(data), "--mode", "vector", "--cache-db", cache)[1])
    assert first["n_queries"] == 4 and json.loads(command("eval", "--data", str(data), "--mode", "vector", "--cache-db", cache)[1]) == first
    tuned = json.loads(command("eval", "--data", str(data), "--tune-alpha", "--tune-rerank", "--rerank", "--expander", "--fuse", "rrf", "--chunk-size", "64")[1])
    assert len(tuned["tuned_alpha"]["grid"]) == 6 and tuned["tuned_weight"]["best"] in evaluation.RERANK_WEIGHTS
    lines = command("bench", "--data", str(data), "plain:--mode bm25", "bad:--mode nonsense")[1].splitlines()
    assert lines[1].startswith("plain") and "FAILED" in lines[2]
    made = json.loads(command("export", "--data", str(data), "--out", f"file://{tmp_path}/out", "--name", "x")[1])
    assert made["expand_train"] + made["expand_dev"] == 4 and made["rerank_train"] + made["rerank_dev"] > 12
    back = spark.read.json(f"file://{tmp_path}/out/x_expand_train.jsonl")
    assert set(back.columns) == {"query", "relevant_doc_ids", "qid"}


def test_pooling_and_width():
    from larkspur.operators import models

    assert models.pooling_of("/m/BGE-m3.gguf") == "cls" and models.pooling_of("x") is None and models.pooling_of("bge", "mean") == "mean"
    with pytest.raises(EngineError):
        models.pooling_of("x", "median")
    assert np.allclose(models.resized(np.array([3.0, 4.0, 5.0]), 2), [0.6, 0.8]) and len(models.resized(np.zeros(2), 5)) == 5
