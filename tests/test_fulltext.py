"""The query language, and ranking against SQLite's full-text index."""

import random
import sqlite3

import pytest

from larkspur.errors import InvalidQuery
from larkspur.functions.analysis import fold, porter, stemmed
from larkspur.operators import fulltext, postings
from larkspur.operators.ingest import SnapshotStore
from larkspur.operators.fulltext import Phrase, parse_query


def test_query_language():
    assert parse_query("rust memory") == [Phrase(("rust",), True), Phrase(("memory",), True)]
    assert parse_query('"exact phrase"') == [Phrase(("exact", "phrase"))]
    assert parse_query("good -bad") == [Phrase(("good",), True), Phrase(("bad",), negated=True)]
    assert parse_query('"open end') == [Phrase(("open", "end"))]
    assert parse_query("half-open") == [Phrase(("half", "open"), True)]
    assert parse_query('x -"a b"') == [Phrase(("x",), True), Phrase(("a",), negated=True), Phrase(("b",), True)]
    assert parse_query("x -") == [Phrase(("x",), True)]
    assert parse_query("x --y") == [Phrase(("x",), True), Phrase(("y",), negated=True)]
    assert parse_query("a\nb") == [Phrase(("a", "b"), True)]
    for text in ("", "  ", "-only", '""'):
        with pytest.raises(InvalidQuery):
            parse_query(text)


def fts(rows):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(path, title, body, tokenize = 'porter unicode61')")
    db.executemany("insert into f values (?, ?, ?)", rows)
    return db


def test_stemmer_against_sqlite():
    words = "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll running generalizations oscillators".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(x, tokenize = 'porter unicode61')")
    db.execute("create virtual table v using fts5vocab(f, instance)")
    db.executemany("insert into f(rowid, x) values (?, ?)", enumerate(words, 1))
    terms = dict(db.execute("select doc, term from v"))
    assert {w: porter(w) for w in words} == {w: terms[i] for i, w in enumerate(words, 1)}
    assert fold("Café ÀÉ") == "cafe ae"
    assert stemmed(None) == []


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    words = "run running runner rust rusts rustic café open opened half map maps mapping cat dog".split()
    return [(f"p{i}.md", " ".join(r.choices(words, k=2)), " ".join(r.choices(words, k=r.randint(3, 60)))) for i in range(60)]


@pytest.mark.parametrize("query", ["running", '"half open" cat', "rust -map", '"run"', "half-open", "caf dog -rustic -cats"])
def test_ranking_against_sqlite(spark, corpus, query):
    phrases = parse_query(query, "porter")
    docs = spark.createDataFrame([("c", p, t, b, "0123456789") for p, t, b in corpus], "collection string, path string, title string, body string, hash string")
    got = {r["path"]: r["score"] for r in fulltext.matches(docs, phrases, "porter").collect()}
    quote = lambda p: '"' + " ".join(p.tokens) + '"' + "*" * p.prefix
    # SQLite stems the words of a query itself, so the tokens given are their own stems or whole words.
    match = " AND ".join(quote(p) for p in phrases if not p.negated) + "".join(" NOT " + quote(p) for p in phrases if p.negated)
    want = {p: -s / (1 - s) for p, s in fts(corpus).execute("select path, bm25(f, 10.0, 1.0, 1.0) from f where f match ?", (match,))}
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize("many", [False, True])
def test_batch_equals_single(spark, corpus, monkeypatch, many):
    if many:
        monkeypatch.setattr(postings, "MANY", 2)
    docs = spark.createDataFrame([("c" if i % 3 else "d", p, t, b, "0123456789") for i, (p, t, b) in enumerate(corpus)], "collection string, path string, title string, body string, hash string")
    texts = ["run", '"half open"', "rust -map", "ca do", "-x", '"run run" -"cat', "o", 'rust ?', "half-op", "path"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    index = postings.Index.of(docs)
    got = postings.search_batch(index, fulltext.phrase_rows(asked), 1000).collect()
    for i, text in enumerate(texts):
        have = {(r["collection"], r["path"]): r["score"] for r in got if r["query_id"] == i}
        want = {} if text == "-x" else {(r["collection"], r["path"]): r["score"] for r in fulltext.matches(docs, parse_query(text)).collect()}
        assert have.keys() == want.keys()
        assert all(abs(have[k] - want[k]) < 1e-9 for k in want)
        if text != "-x" and not many:
            one = {(r["collection"], r["path"]): r["score"] for r in postings.matches(index, text).collect()}
            assert one.keys() == want.keys() and all(abs(one[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("analyzer", ["simple", "porter"])
def test_stored_index(spark, corpus, tmp_path, analyzer, monkeypatch):
    """Segments, changed and removed documents, and the merge answer like a scan of the current texts."""
    monkeypatch.setattr(postings, "SEGMENTS", 3)
    schema = "collection string, path string, title string, body string, hash string"
    now = {p: ("c" if i % 3 else "d", p, t, b, f"{i:08d}") for i, (p, t, b) in enumerate(corpus)}
    now["null"] = ("c", "null", None, None, "00000000")
    store = postings.IndexStore(SnapshotStore(spark, f"file://{tmp_path}/index"), analyzer)
    assert store.index() is None
    store.add(spark.createDataFrame(list(now.values()), schema))
    for step in range(2):
        changed = {p: (*row[:3], "mapping the rust " * (step + 1), row[4]) for p, row in list(now.items())[step * 5 : step * 5 + 10]}
        lost = list(now)[30 + step * 3 : 33 + step * 3]
        gone = spark.createDataFrame([now[p][:2] for p in [*changed, *lost]], "collection string, path string")
        store.add(spark.createDataFrame(list(changed.values()), schema), gone)
        now = {p: r for p, r in (now | changed).items() if p not in lost}
        docs, index = spark.createDataFrame(list(now.values()), schema), store.index()
        for text in ('"half open" rust', "map -cat") if step else ('"mapping"',):
            want = {(r["collection"], r["path"]): r["score"] for r in fulltext.matches(docs, parse_query(text, analyzer), analyzer).collect()}
            have = {(r["collection"], r["path"]): r["score"] for r in postings.matches(index, text).collect()}
            assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)
    assert len(store.store.current()[f"postings_{analyzer}"]) == 1  # merged
    plan = postings.matches(store.index(), '"mapping"')._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1][:60]
    top = postings.search(store.index(), "rust", 5, bodies=docs).collect()
    assert len(top) == 5 and all("<b>" in r["snippet"] for r in top) and [r["score"] for r in top] == sorted((r["score"] for r in top), reverse=True)


def test_two_writers(spark, corpus, tmp_path):
    from larkspur.errors import Conflict

    store = SnapshotStore(spark, f"file://{tmp_path}/index")
    rows = spark.range(3)
    base = store.version()
    store.commit({"a": rows})
    with pytest.raises(Conflict):
        store.commit({"a": rows}, base=base)
    with pytest.raises(Conflict):
        store._publish(store.version(), {})
    store.commit(appended={"a": rows})
    assert store.read("a").count() == 6
    store.commit({"a": rows})
    store.clean()
    assert store.read("a").count() == 3 and len(store.current()["a"]) == 1
    store.wipe()
    assert store.read("a") is None


def test_no_tokens_match_nothing(spark, corpus):
    docs = spark.createDataFrame([("c", *row, "0") for row in corpus], "collection string, path string, title string, body string, hash string")
    assert fulltext.matches(docs, parse_query("cat ?")).count() == 0
    assert fulltext.matches(docs.limit(0), parse_query("cat")).count() == 0


def test_snippets_against_sqlite():
    r = random.Random(8)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    for _ in range(300):
        body = " ".join(r.choices(words, weights=[9, 9, 9, 9, 9, 9, 9, 9, 1, 1], k=r.randint(5, 120)))
        query = r.choice(["kappa", "iota", "kappa iota"])
        db = sqlite3.connect(":memory:")
        db.execute("create virtual table f using fts5(path, title, body, tokenize = 'unicode61')")
        db.execute("insert into f values ('p', 't', ?)", (body,))
        found = db.execute("select snippet(f, 2, '<b>', '</b>', '...', 32) from f where f match ?", (" AND ".join(f'"{w}"*' for w in query.split()),)).fetchall()
        if found:
            assert fulltext.snippet_of(body, parse_query(query)) == found[0][0]
