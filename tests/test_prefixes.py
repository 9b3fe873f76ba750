"""Batches of prefix queries by one scan of the texts, against the single search and the SQL twin."""

import random

import pytest

from compare import connection, rows
from larkspur import oracle, queries
from larkspur.operators import fulltext, prefixes

DOCS = "collection string, path string, title string, body string, hash string"
ASKED = [["run"], ["rust", "map"], ["rust", "rustic"], ["run", "half", "cat"], ["map", "rust"], ["nothing"], ["run", "nothing"], [], ["p1"]]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    words = "run Running runner rust rusts Rustic café open half map maps cat dog".split()
    made = [("c" if i % 3 else "d", f"p{i}.md", r.choice(words) if i % 4 else None, " ".join(r.choices(words, k=r.randint(0, 40)))) for i in range(90)]
    copies = [(c, f"copy-{p}", t, b) for c, p, t, b in made[:30]] + [("c", "blank.md", "", " - ")]
    return spark.createDataFrame([(*row, "0123456789") for row in made + copies], DOCS)


@pytest.mark.parametrize("limit, batch", [(1000, 10_000), (3, 10_000), (3, 2)])
def test_batch_equals_single(spark, docs, limit, batch):
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id int, terms array<string>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = prefixes.search_batch(docs, asked, limit).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, terms in enumerate(ASKED):
        found = fulltext.matches(docs, fulltext.parse_query(" ".join(terms))).collect() if terms else []
        want = sorted((-round(r["score"], 9), r["collection"], r["path"]) for r in found)[:limit]
        have = sorted((r["rank"], -round(r["score"], 9), r["collection"], r["path"]) for r in got if r["query_id"] == i)
        assert have == [(rank, *row) for rank, row in enumerate(want, 1)]


def test_no_documents(spark, docs):
    asked = spark.createDataFrame([(1, ["run"])], "query_id int, terms array<string>")
    assert prefixes.search_batch(docs.limit(0), asked).collect() == []
    assert prefixes.search_batch(docs, asked.limit(0)).collect() == []


def test_prf_fusion_needs_no_index(spark, sf, monkeypatch):
    """Asked once, the whole index of all tokens is far dearer than the few that are looked for."""

    def index(*_):
        raise AssertionError("an index is made")

    monkeypatch.setattr(queries, "index", index)
    got = queries.prf_fusion(spark, sf).toPandas()
    want = connection(sf).execute(oracle.SQL["prf_fusion"]).df()
    assert len(got) and rows(got) == rows(want)
