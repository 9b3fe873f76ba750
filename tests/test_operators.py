"""Scalars, chunks, fusion, gates, ingest, reranking, expansion, evaluation, output, sources."""

import datetime
import json
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.errors import CollectionExists, CollectionNotFound, EngineError, InvalidName
from larkspur.functions import chunking, scalars
from larkspur.operators import embedding, evaluation, expansion, fusion, incremental, ingest, models, output, rerank, vectors
from larkspur.plans.pipeline import SearchSession
from larkspur.sources import beir, files
from larkspur.sources.registry import Collection, Registry
from larkspur.streaming import ingest as streaming

NOW = datetime.datetime(2025, 7, 1)


# ---- scalars


TITLES = [
    ("# Head\nx", "Head"), ("prose\n# Head", "prose"), ("---\ntitle: A\nname: 'B'\n---\n# C", "B"), ("---\ntitle: \"A\"\n...\nx", "A"), ("---\nx: 1\n---\n\n# C", "C"),
    ("---\ntitle: A\n# never closed", "A"), ("---\nx\n", "file"), ("", "file"), (None, "file"), ("\n \n", "file"), ("---\r\ntitle: A \r\n---\r\nx", "A"), ("---\n---\nx", "x"), ("---", "file"),
    ("----\nx", "----"), ("---\ntitle: A\ntitle:\n---\n", "A"), ("#  Two ", "Two"), ("#", "#"), (" \u2003# Head", "Head"), ("---\n a\n--- x\n---\ny", "y"), ("---\ntitle: x\u2028y\n---\n", "x\u2028y"),
]


def test_title(spark):
    df = spark.createDataFrame([(i, t, "a/file.md") for i, (t, _) in enumerate(TITLES)], "i int, text string, path string")
    got = {r["i"]: r["title"] for r in df.select("i", scalars.extract_title("text", "path").alias("title")).collect()}
    assert [got[i] for i in range(len(TITLES))] == [title for _, title in TITLES]
    paths = spark.createDataFrame([("a/b.c.md",), (".md",), ("a/..md",), ("x",), ("a/",), (None,), ("a..md",)], "path string").select("path", scalars.extract_title(F.lit(None).cast("string"), "path").alias("t"))
    assert [r["t"] for r in paths.collect()] == ["b.c", ".md", "..md", "x", "a/", None, "a."]


def test_scalars(spark):
    row = spark.createDataFrame([("abcdef01", " Q É ", b"a\r\nb\xff", [3.0, 4.0], [0.0, 0.0], "é" * 4000)], "h string, q string, raw binary, v array<float>, z array<float>, long string").select(
        scalars.doc_id(F.col("h")).alias("id"), scalars.stored_text(F.col("raw")).alias("text"), scalars.l2_normalized(F.col("v")).alias("v"), scalars.l2_normalized(F.col("z")).alias("z"),
        scalars.cache_key(F.lit("m"), F.col("q")).alias("key"), scalars.cache_key(F.lit("m"), F.col("q"), F.col("h")).alias("key2"), scalars.truncated("long").alias("cut"),
        scalars.yes_no(F.lit(1000.0), F.lit(1000.0)).alias("half"), scalars.feedback_terms(F.lit("The naïve Zebra-zoo of 42 and x1y")).alias("terms"),
    ).first()
    import hashlib

    assert row["id"] == "#abcdef" and row["text"] == "a\nb�"
    assert np.allclose(row["v"], [0.6, 0.8]) and row["z"] == [0.0, 0.0]
    assert row["key"] == hashlib.sha256("m\0q é".encode()).hexdigest()
    assert row["key2"] == hashlib.sha256("m\0q é\0abcdef01".encode()).hexdigest()
    assert row["cut"] == "é" * 3000 and row["half"] == 0.5
    assert row["terms"] == ["zebra", "zoo", "x1y"]
    assert scalars.profile_of("/m/BGE-M3-q8.gguf") == "bge-m3" and scalars.profile_of("x") == "generic"


# ---- chunks


def check_chunks(text, tokens):
    data = text.encode()
    parts = chunking.chunks(text, tokens)
    assert parts[0][0] == 0 and parts[-1][1] == len(data)
    for (a, b), (c, _) in zip(parts, parts[1:], strict=False):
        assert a < c <= b
    for a, b in parts:
        data[a:b].decode()
    return parts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\n#-`~1. 字", max_size=900), st.sampled_from([4, 16, 60, 512]))
def test_chunks_cover(text, tokens):
    check_chunks(text, tokens)


def test_chunks():
    assert chunking.chunks("") == [(0, 0)] and chunking.chunks("x" * 2048) == [(0, 2048)]
    parts = check_chunks(("The quick brown fox jumps over the lazy dog. " * 20 + "\n\n## Section\n\n") * 10, 512)
    assert len(parts) > 3 and all(a == b - 308 for (_, b), (a, _) in zip(parts, parts[1:], strict=False))
    assert chunking.chunks("x" * 5000)[:2] == [(0, 2048), (1740, 3788)]
    scores = [chunking.line_score(x) for x in ("", "# a", "## a", "###### a", "#", "#a", "- a", "12. a", "word")]
    assert scores == [20, 100, 90, 50, 100, 1, 5, 5, 1]


# ---- vectors


def test_knn(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, None), (4, [0.0] * 4), (5, [1.0, 0.0]), (6, [2.0, 0.1, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in vectors.knn(rows, [1, 0, 0, 0], 2).collect()] == [1, 6]
    with pytest.raises(EngineError):
        vectors.check_width(rows, "embedding", 0)


def test_knn_batch_in_cells(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = rows.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    few = vectors.knn_batch(rows, asked, 4).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "CELL", 100)
    many = vectors.knn_batch(rows, asked, 4).orderBy("query_id", "rank").collect()
    assert [(r[0], r[1], r["rank"]) for r in few] == [(r[0], r[1], r["rank"]) for r in many]


def test_best_chunk_counts(spark):
    docs = spark.createDataFrame([("c", "b.md", "B", "h1"), ("c", "a.md", "A", "h1"), ("c", "z.md", "Z", "h2")], "collection string, path string, title string, hash string")
    chunks = spark.createDataFrame([("h1", [1.0, 0.0]), ("h1", [0.9, 0.1]), ("h2", [0.0, 1.0]), ("gone", [1.0, 0.0])], "hash string, embedding array<float>")
    got = vectors.search(chunks, docs, [1, 0], 10).collect()
    assert [(r["path"], round(r["score"], 6)) for r in got] == [("a.md", 1.0), ("z.md", 0.0)]
    assert vectors.search(chunks, docs, [1, 0], 10, min_score=0.5).count() == 1


# ---- fusion and gates


def ranked(spark, scores, q=1):
    return spark.createDataFrame([(q, "c", f"d{i}", float(s), i + 1) for i, s in enumerate(scores)], "query_id int, collection string, path string, score double, rank int")


@pytest.mark.parametrize(("scores", "strong"), [((0.39, 0.10), False), ((0.40, 0.30), False), ((0.40, 0.25), True), ((0.80, 0.72), True), ((0.80, 0.76), False), ((0.50,), True)])
def test_fused_gate(spark, scores, strong):
    assert fusion.strong_fused(ranked(spark, scores)).first()["strong"] is strong


@pytest.mark.parametrize(("scores", "strong"), [((0.74, 0.60), False), ((0.75, 0.66), False), ((0.75, 0.64), True), ((0.90, 0.70), True), ((0.80,), True)])
def test_bm25_gate(spark, scores, strong):
    assert fusion.strong_bm25(ranked(spark, scores)).first()["strong"] is strong


def test_rrf(spark):
    rows = [(1, 0, 1.0, "c", "shared", 0), (1, 0, 1.0, "c", "one", 1), (1, 1, 0.8, "c", "shared", 0), (1, 1, 0.8, "c", "two", 3)]
    got = {r["path"]: r["score"] for r in fusion.rrf(spark.createDataFrame(rows, "query_id int, list_id int, weight double, collection string, path string, rank0 int"), 10, k=0).collect()}
    assert np.isclose(got["shared"], 1 / 61 + 0.05 + 0.8 / 61 + 0.05) and np.isclose(got["one"], 1 / 62 + 0.02) and np.isclose(got["two"], 0.8 / 64)


def test_linear_takes_absent_sides_as_zero(spark):
    got = {r["path"]: r["score"] for r in fusion.linear(ranked(spark, [0.5, 0.4]), ranked(spark, [0.9]), 10).collect()}
    assert np.isclose(got["d0"], 0.8 * 0.9 + 0.2 * 0.5) and np.isclose(got["d1"], 0.2 * 0.4)


# ---- ingest


def documents(spark, rows):
    return spark.createDataFrame([(*r[:4], NOW, NOW, r[4]) for r in rows], "collection string, path string, title string, hash string, created_at timestamp, modified_at timestamp, active boolean")


def scan(spark, rows):
    return spark.createDataFrame([(*r, f"text {r[3]}") for r in rows], "collection string, path string, title string, hash string, doc string")


def test_diff_and_update(spark, tmp_path):
    stored = documents(spark, [("c", "keep", "k", "1", True), ("c", "change", "x", "2", True), ("c", "gone", "g", "3", True), ("c", "back", "b", "4", False), ("other", "o", "o", "9", True)])
    new = scan(spark, [("c", "keep", "k", "1"), ("c", "change", "y", "22"), ("c", "back", "b", "4"), ("c", "add", "a", "5")])
    actions = {r["path"]: r["action"] for r in ingest.diff(new, stored.where("active and collection = 'c'")).collect()}
    assert actions == {"change": "update", "gone": "deactivate", "back": "add", "add": "add"}
    later = F.lit(datetime.datetime(2025, 8, 1))
    after = {r["path"]: r for r in ingest.apply_diff(stored, new, later).collect()}
    assert {p: r["active"] for p, r in after.items()} == {"keep": True, "change": True, "gone": False, "back": True, "add": True, "o": True}
    assert after["change"]["created_at"] == NOW and after["change"]["hash"] == "22" and after["keep"]["modified_at"] == NOW and after["back"]["created_at"] == NOW


def test_store_is_atomic(spark, tmp_path):
    store = ingest.SnapshotStore(spark, f"file://{tmp_path}/index")
    assert store.read("documents") is None
    assert ingest.update(store, scan(spark, [("c", "a", "A", "1"), ("c", "b", "B", "1")])) == {"added": 2, "updated": 0, "deactivated": 0}
    assert store.read("content").count() == 1
    before = store.current()

    def broken(batches):
        raise ValueError("no")
        yield

    bad = scan(spark, [("c", "z", "Z", "7")]).mapInPandas(broken, "collection string, path string, title string, hash string, doc string")
    with pytest.raises(Exception):  # noqa: B017
        ingest.update(store, bad)
    assert store.current() == before
    assert ingest.update(store, scan(spark, [("c", "a", "A", "2")])) == {"added": 0, "updated": 1, "deactivated": 1}
    assert ingest.update(store, scan(spark, [("c", "b", "B", "1")])) == {"added": 1, "updated": 0, "deactivated": 1}
    assert ingest.update(store, scan(spark, [("c", "n", "N", "3")]), force=True)["added"] == 1
    assert store.read("documents").count() == 1 and store.read("content").count() == 1


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "collection string, path string, title string, hash string, doc string, modified_at timestamp"
    spark.createDataFrame([("c", "a", "A", "1", "x", NOW), ("c", "a", "A", "2", "y", datetime.datetime(2025, 7, 2))], schema).write.parquet(str(source))
    store = ingest.SnapshotStore(spark, f"file://{tmp_path}/index")
    for _ in range(2):
        streaming.ingest_stream(spark.readStream.schema(schema).parquet(str(source)), store, str(tmp_path / "at"), once=True).awaitTermination()
    assert [(r["path"], r["hash"]) for r in ingest.documents(store).collect()] == [("a", "2")]
    streaming.upsert(store, spark.read.parquet(str(source)))
    assert ingest.documents(store).count() == 1 and store.read("content").count() == 1
    streaming.upsert(store, spark.createDataFrame([("c", "b", "B", "3", "z", NOW), ("c", "a", "A2", "4", "y", NOW)], schema))
    assert {(r["path"], r["hash"], r["title"]) for r in ingest.documents(store).collect()} == {("a", "4", "A2"), ("b", "3", "B")}
    ingest.merge_changes(store, 1)
    assert "changes" not in store.current() and store.read("documents").count() == 2
    assert ingest.update(store, scan(spark, [("c", "a", "A2", "4")])) == {"added": 0, "updated": 0, "deactivated": 1}


def test_embedding_run(spark):
    docs = documents(spark, [("c", "b", "B", "1", True), ("c", "a", "A", "1", True), ("c", "z", "Z", "2", True), ("c", "off", "O", "3", False)])
    have = spark.createDataFrame([("2", 0, "m1"), ("3", 0, "m1"), ("lost", 0, "m1")], "hash string, seq int, model string")
    assert [tuple(r) for r in embedding.unembedded(docs, have).collect()] == [("1", "a")]
    assert embedding.unembedded(docs, have, "m2").count() == 2
    assert {r["hash"] for r in embedding.orphans(docs, have).collect()} == {"3", "lost"}
    made = embedding.embed(spark.createDataFrame([("1", None, "word " * 1000)], "hash string, title string, doc string"), models.HashingEmbedder(16)).collect()
    assert [r["seq"] for r in made] == list(range(len(made))) and len(made) == 3 and all(len(r["embedding"]) == 16 for r in made)


# ---- incremental


def test_pending(spark):
    t = lambda d: datetime.datetime(2025, 5, d)
    docs = spark.createDataFrame([(1, "a", t(1), 1, "x"), (1, "a", t(1), 1, "x"), (2, "b", t(9), 1, "x"), (3, "c", None, 1, "x"), (4, "d", t(9), 0, "x"), (5, None, t(9), 1, "x"), (6, "e", t(9), None, "x")], "doc_id long, hash string, modified_at timestamp, active int, status string")
    done = spark.createDataFrame([("b", None), ("z", t(3)), ("c", t(3)), ("c", None), (None, t(3))], "hash string, embedded_at timestamp")
    runs = spark.createDataFrame([(t(2), t(2), "ok"), (t(4), None, "failed"), (t(6), t(6), "ok"), (t(8), None, "failed")], "started_at timestamp, finished_at timestamp, status string")
    assert incremental.reread_from(runs).first()[0] == t(4)
    got = {r["doc_id"]: r["reread"] for r in incremental.pending(docs, done, runs).collect()}
    assert got == {1: False, 2: True}
    assert incremental.pending(docs, done.limit(0), runs.limit(0)).count() == 3
    assert incremental.pending(docs.limit(0), done, runs).count() == 0


def test_marking_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "doc_id long, hash string")
    for _ in range(2):
        incremental.mark_processed(rows, str(tmp_path), "run-1")
    assert spark.read.parquet(str(tmp_path)).count() == 1


def test_failed_run_neither_skips_nor_repeats(spark, tmp_path):
    t = lambda d: datetime.datetime(2025, 5, d)
    schema = "doc_id long, hash string, modified_at timestamp, active int"
    docs = spark.createDataFrame([(1, "a", t(1), 1), (2, "b", t(9), 1), (3, "c", t(9), 1)], schema)
    runs = spark.createDataFrame([(t(4), None, "failed"), (t(6), t(6), "ok")], "started_at timestamp, finished_at timestamp, status string")
    vectors = spark.createDataFrame([("c", t(3))], "hash string, embedded_at timestamp")
    seen = []

    def fails(batch):
        seen.extend(r["doc_id"] for r in batch.collect())
        raise RuntimeError("lost")

    folder = str(tmp_path / "ledger")
    with pytest.raises(RuntimeError):
        incremental.run_once(docs, vectors, runs, folder, "r1", fails)
    assert sorted(seen) == [1, 2] and incremental.marked(spark, folder).count() == 0
    good = lambda batch: seen.extend(r["doc_id"] for r in batch.collect())
    seen.clear()
    assert incremental.run_once(docs, vectors, runs, folder, "r2", good, sweep=False) == 1 and seen == [2]
    assert incremental.run_once(docs, vectors, runs, folder, "r3", good) == 1 and seen == [2, 1]
    assert incremental.run_once(docs, vectors, runs, folder, "r4", good) == 0
    later = docs.unionByName(spark.createDataFrame([(2, "b2", t(10), 1)], schema))  # a new version of a marked record
    assert incremental.run_once(later, vectors, runs, folder, "r5", good) == 1 and seen == [2, 1, 2]
    plan = incremental.pending(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), vectors, runs, sweep=False)._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(modified_at),GreaterThanOrEqual" in plan.split("PushedFilters")[1]


# ---- expansion, reranking


def test_expansion(spark):
    raw = "lex: rust\n vec: how rust works \nnoise\nhyde:\nLEX: no"
    assert expansion.parse_output(raw) == [("lex", "rust"), ("vec", "how rust works")]
    assert expansion.is_valid("Rust memory", expansion.parse_output(raw)) and not expansion.is_valid("q", [])
    rows = spark.createDataFrame([(1, "Rust memory", raw), (2, "q", "lex: zzz"), (3, "q", None)], "query_id int, text string, raw string")
    got = {}
    for r in expansion.expanded(rows, "raw").collect():
        got.setdefault(r["query_id"], []).append((r["kind"], r["text"]))
    assert got == {1: [("lex", "rust"), ("vec", "how rust works")], 2: expansion.fallback("q"), 3: expansion.fallback("q")}

    class Broken:
        model_id = "b"

        def expand_query(self, query):
            raise RuntimeError

    assert expansion.expand_all(["q"], Broken())["q"] == (expansion.fallback("q"), False)


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "c", "a", 0.5, 1, "h1"), (1, "c", "b", 0.4, 2, "h2"), (1, "c", "z", 0.3, 3, "none")], "query_id int, collection string, path string, score double, rank int, hash string")
    queries = spark.createDataFrame([(1, "Rust Memory")], "query_id int, text string")
    content = spark.createDataFrame([("h1", "nothing"), ("h2", "rust memory")], "hash string, doc string")
    cache = spark.createDataFrame([], "key string, score double, created_at timestamp")
    result, made = rerank.rerank(rows, queries, content, cache, models.OverlapScorer())
    assert [(r["path"], round(r["score"], 6)) for r in result.orderBy("rank").collect()] == [("b", 0.76), ("z", 0.3), ("a", 0.2)]
    stored = made.withColumn("created_at", F.lit(NOW))
    split = rerank.cache_split(rerank.keyed(rows, queries, "overlap"), stored)
    assert {r["path"]: r["rerank"] for r in split.collect()} == {"a": 0.0, "b": 1.0, "z": None}


# ---- evaluation


def test_metrics(spark):
    runs = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "x", 3), (3, "a", 1)], "query_id int, doc string, rank int")
    qrels = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (1, "a", 0), (2, "a", 1)], "query_id int, doc string, relevance int")
    got = {r["query_id"]: (r["ndcg"], r["recall"]) for r in evaluation.metrics(runs, qrels, 10).collect()}
    assert got.keys() == {1, 2} and got[2] == (0, 0)
    assert np.isclose(got[1][0], (3 / np.log2(3)) / (3 + 1 / np.log2(3))) and got[1][1] == 0.5
    assert evaluation.means(evaluation.metrics(runs, qrels.limit(0))).first()["ndcg"] == 0
    one = spark.createDataFrame([(1, 0.5)], "query_id int, ndcg double")
    assert evaluation.paired_t(one, one).count() == 0
    two = spark.createDataFrame([(1, 0.5), (2, 0.7)], "query_id int, ndcg double")
    row = evaluation.paired_t(two, two).first()
    assert row["t"] == 0 and not row["significant"]
    assert evaluation.run_key({"a": 1, "b": 2}) == evaluation.run_key({"b": 2, "a": 1}) != evaluation.run_key({"a": 1})


# ---- output


def test_render():
    row = {"collection": "c", "path": "a,b.md", "title": 'T "x"', "score": 0.51234, "snippet": "<b>hit</b> x", "hash": "abc", "doc_id": "#abc"}
    assert output.render([row], "csv").split("\n")[1] == 'c,"a,b.md","T ""x""",0.5123,#abc'
    assert json.loads(output.render([row], "json"))[0]["snippet"] == "<b>hit</b> x"
    assert output.render([row], "md") == '- [T "x"](a,b.md) `0.512` #abc\n  > **hit** x'
    assert output.render([row], "files") == "a,b.md" and output.render([]) == "no results"
    assert "    hit x" in output.render([row]) and output.render([row | {"title": "a,b"}]).count("\n    ") == 1
    assert output.chosen_format(True, True) == "json" and output.chosen_format() == "pretty"


# ---- sources


def test_files(spark, tmp_path):
    for name, data in {"a.md": b"# A\r\nx", "sub/b.md": b"bad \xff", ".hid/c.md": b"", "skip/d.md": b"x", "e.txt": b"x", "sub/ig.md": b"x", ".gitignore": b"ig.md\n"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    assert files.wanted_paths(str(tmp_path), excludes=["skip/**"]) == [".hid/c.md", "a.md", "sub/b.md"]
    assert files.wanted_paths(str(tmp_path), ["*.txt"]) == ["e.txt"]
    got = {r["path"]: r for r in files.read_files(spark, "c", str(tmp_path), excludes=["skip"]).collect()}
    import hashlib

    assert got["a.md"]["hash"] == hashlib.sha256(b"# A\r\nx").hexdigest() and got["a.md"]["doc"] == "# A\nx" and got["a.md"]["title"] == "A"
    assert got["sub/b.md"]["doc"] == "bad �" and got[".hid/c.md"]["title"] == "c"
    assert files.read_files(spark, "c", str(tmp_path / "skip"), ["*.none"]).count() == 0


def test_beir(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "1", "title": "T", "text": "x"}\n\n{"_id": "2"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "x"}\n')
    (tmp_path / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t1\nq\t2\t0\nq\t1\t2\nq\t3\tbad\nshort\tx\n")
    assert [tuple(r) for r in beir.read_corpus(spark, str(tmp_path / "corpus.jsonl")).orderBy("_id").collect()] == [("1", "T", "x"), ("2", "", "")]
    qrels = beir.read_qrels(spark, str(tmp_path / "test.tsv"))
    assert [tuple(r) for r in qrels.collect()] == [("q", "1", 2)]
    queries = beir.read_queries(spark, str(tmp_path / "queries.jsonl"))
    assert beir.judged(queries, qrels).count() == 1
    corpus = spark.createDataFrame([(str(i), "", f"text {i}") for i in range(40)], "_id string, title string, text string")
    pairs = beir.rerank_pairs(queries, corpus, qrels).collect()
    assert sum(r["relevant"] for r in pairs) == 1 and all(r["document"] == "text 1" for r in pairs if r["relevant"])
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):  # noqa: B017
        beir.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()


def test_registry(tmp_path):
    registry = Registry(str(tmp_path / "r.yml"))
    for name in ("", "a/b", "..", "a..b", "a\0"):
        with pytest.raises(InvalidName):
            registry.add(Collection(name, "/x"))
    (tmp_path / "x/y").mkdir(parents=True)
    registry.add(Collection("my-notes_2024", str(tmp_path / "x")))
    registry.add(Collection("deep", str(tmp_path / "x/y")))
    with pytest.raises(CollectionExists):
        registry.rename("deep", "my-notes_2024")
    assert registry.resolve([], str(tmp_path / "x/y/z")) == ["deep"] and registry.resolve([], "/") == ["my-notes_2024", "deep"]
    with pytest.raises(CollectionNotFound):
        registry.resolve(["no"], "/")
    registry.rename("deep", "low")
    registry.set_path("low", str(tmp_path))
    registry.remove("my-notes_2024")
    assert Registry(registry.path).names() == ["low"] and Registry(registry.path).get("low").path == os.path.realpath(tmp_path)


# ---- pipeline


def test_pipeline(spark):
    texts = ["rust memory safety", "rust tools", "cooking with fire", "memory of summer", "garden notes", "train tables"]
    docs = spark.createDataFrame([("c" if i % 2 else "d", f"{i}.md", f"t{i}", t, f"{i:064d}") for i, t in enumerate(texts)], "collection string, path string, title string, body string, hash string")
    embedder = models.HashingEmbedder()
    chunks = spark.createDataFrame([(f"{i:064d}", embedder.embed_query(t).tolist()) for i, t in enumerate(texts)], "hash string, embedding array<float>")
    content = docs.select("hash", F.col("body").alias("doc"))
    session = SearchSession(docs, chunks, content, embedder, models.FallbackExpander(), models.OverlapScorer(), profile="generic")
    for mode in ("bm25", "vector", "hybrid"):
        found = session.search("rust memory", 5, mode).results.collect()
        assert found[0]["path"] == "0.md" and found[0]["doc_id"] == "#000000"
    outcome = session.search("memory fire", 5, "hybrid")
    assert outcome.results.count() > 0 and "reranked" in outcome.log
    assert {r["collection"] for r in session.search("memory", 5, "vec", collections=["c"]).results.collect()} <= {"c"}
