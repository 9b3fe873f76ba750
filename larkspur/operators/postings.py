"""Stored postings: the inverted index that full-text searches read instead of texts.

A posting is one row per token and document with the token's places.  Postings are kept in buckets of the
tokens' first two letters and sorted by token, so that a search reads the buckets of its tokens, a prefix
those of its first letters, and no text.  An index grows by segments; what an update changes or removes is
noted in a table ``gone``, which hides older rows until the segments are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.analysis import simple_tokens, stemmed_tokens
from ..functions.scalars import doc_id
from .fulltext import MANY, WEIGHTS, B, K1, Phrase, idf, normalized, parse_query, per_collection, phrase_rows, snippet
from .ingest import SnapshotStore

KEY = ["collection", "path"]
#: Buckets of tokens, and letters of a token that choose its bucket.
BUCKETS, HEAD = 64, 2
#: Documents a bucket's file holds the postings of; more are spread over several files by document.
DOCS_A_FILE = 2_000_000
#: Parts that hot tokens are split into when more than ``MANY`` terms are looked up.
SALTS = 16
#: Segments from which on they are merged.
SEGMENTS = 16
_FIELDS = tuple(WEIGHTS)
_ID = ["query_id", "phrase_no", "negated"]


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, HEAD)), F.lit(BUCKETS)).cast("int")


def tokens(text: Column, analyzer: str) -> Column:
    return stemmed_tokens(text) if analyzer == "porter" else simple_tokens(text)


def postings(docs: DataFrame, analyzer: str = "simple") -> DataFrame:
    """``token, collection, path, len, n_path, n_title, n_body, places`` of ``collection, path, title, body``.

    len counts the document's tokens; a place is ``4 * position + field``.  Each text moves once, to the task
    that gathers its places; null texts have no tokens.
    """
    arrays = docs.select(*KEY, *_FIELDS[1:]).repartition(*KEY).select(*KEY, *(tokens(F.col(c), analyzer).alias(f"_{c}") for c in _FIELDS))
    length = sum((F.size(f"_{c}") for c in _FIELDS), F.lit(0)).alias("len")
    placed = [F.transform(f"_{c}", _placed(n)) for n, c in enumerate(_FIELDS)]
    rows = arrays.select(*KEY, length, F.explode(F.concat(*placed)).alias("s")).select(*KEY, "len", "s.token", "s.place")
    counts = [F.count(F.when(F.col("place") % 4 == n, 1)).cast("int").alias(f"n_{c}") for n, c in enumerate(_FIELDS)]
    return rows.groupBy(*KEY, "len", "token").agg(*counts, F.collect_list("place").alias("places")).select("token", *KEY, "len", *(f"n_{c}" for c in _FIELDS), "places")


def _placed(field: int) -> Callable[[Column, Column], Column]:
    return lambda token, at: F.struct(token.alias("token"), (at * 4 + field).alias("place"))


def entries(docs: DataFrame, analyzer: str = "simple") -> DataFrame:
    """``collection, path, title, hash, len`` of each document."""
    return docs.select(*KEY, "title", "hash", sum((F.size(tokens(F.col(c), analyzer)) for c in _FIELDS), F.lit(0)).alias("len"))


def statistics(entries: DataFrame) -> DataFrame:
    """``collection, docs, avg``: a row per collection."""
    return entries.groupBy("collection").agg(F.count("*").alias("docs"), F.avg("len").alias("avg"))


@dataclass(frozen=True)
class Index:
    """Postings, entries and statistics that searches work on, stored or not."""

    postings: DataFrame
    entries: DataFrame
    stats: DataFrame
    analyzer: str = "simple"
    stored: bool = False

    @staticmethod
    def of(docs: DataFrame, analyzer: str = "simple") -> Index:
        """The index of a table of documents for one use; nothing is stored."""
        known = entries(docs, analyzer)
        return Index(postings(docs, analyzer), known, statistics(known), analyzer)

    @staticmethod
    def union(parts: Sequence[Index]) -> Index:
        return Index(*(reduce(DataFrame.unionByName, [getattr(p, t) for p in parts]) for t in ("postings", "entries", "stats")), parts[0].analyzer, all(p.stored for p in parts))

    def within(self, collections: Sequence[str]) -> Index:
        own = F.col("collection").isin(*collections)
        return Index(self.postings.where(own), self.entries.where(own), self.stats.where(own), self.analyzer, self.stored)


class IndexStore:
    """The stored index of a set of documents, for one analyzer."""

    def __init__(self, store: SnapshotStore, analyzer: str = "simple") -> None:
        self.store, self.analyzer = store, analyzer

    def _name(self, table: str) -> str:
        return f"{table}_{self.analyzer}"

    def _live(self, table: str, state: dict[str, list[str]] | None = None) -> DataFrame | None:
        state = self.store.current() if state is None else state
        parts = [self.store.spark.read.parquet(f).withColumn("_segment", F.lit(i)) for i, f in enumerate(state.get(self._name(table), []))]
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, parts)
        if gone := state.get(self._name("gone")):
            newest = self.store.spark.read.parquet(*gone).groupBy(*KEY).agg(F.max("before").alias("_before"))
            rows = rows.join(newest, KEY, "left").where("_before is null or _segment >= _before").drop("_before")
        return rows.drop("_segment")

    def index(self) -> Index | None:
        """The index as it is stored now; None when nothing was."""
        known = self._live("postings")
        return None if known is None else Index(known, self._live("entries"), self.store.read(self._name("stats")), self.analyzer, True)

    def _laid_out(self, rows: DataFrame, docs: int) -> DataFrame:
        salt = F.pmod(F.xxhash64(*KEY), F.lit(-(-docs // DOCS_A_FILE) or 1))
        return rows.withColumn("bucket", _bucket(F.col("token"))).repartition("bucket", salt).sortWithinPartitions("bucket", "token")

    def add(self, docs: DataFrame, gone: DataFrame | None = None, base: int | None = None) -> None:
        """Add a segment for ``collection, path, title, body, hash``; ``gone`` names documents whose older rows are void.

        Segments, what is gone and the new statistics become visible in one commit.
        """
        number = len(self.store.current().get(self._name("postings"), []))
        n = docs.count()
        appended = {self._name("postings"): self._laid_out(postings(docs, self.analyzer), n), self._name("entries"): entries(docs, self.analyzer)}
        if gone is not None and number:
            appended[self._name("gone")] = gone.select(*KEY).distinct().withColumn("before", F.lit(number))
        stats = {self._name("stats"): lambda state: statistics(self._live("entries", state))}
        self.store.commit({}, appended, {self._name("postings"): "bucket"}, stats, base=base)
        if number + 1 >= SEGMENTS:
            self.merge()

    def replace(self, docs: DataFrame) -> None:
        """Index ``docs`` anew, in one commit."""
        replaced = {self._name("postings"): self._laid_out(postings(docs, self.analyzer), docs.count()), self._name("entries"): entries(docs, self.analyzer)}
        stats = {self._name("stats"): lambda state: statistics(self._live("entries", state))}
        self.store.commit(replaced, None, {self._name("postings"): "bucket"}, stats, [self._name("gone")])

    def merge(self) -> None:
        """Rewrite the live rows as one segment, and forget what is gone."""
        known, docs = self._live("entries"), self._live("postings")
        replaced = {self._name("postings"): self._laid_out(docs.drop("bucket"), known.count()), self._name("entries"): known}
        self.store.commit(replaced, None, {self._name("postings"): "bucket"}, dropped=[self._name("gone")])


def _buckets(index: Index, heads: Sequence[str]) -> list[int]:
    """Buckets of tokens with these first letters."""
    made = index.postings.sparkSession.range(1).select(F.transform(F.array(*map(F.lit, heads)).cast("array<string>"), _bucket).alias("b")).first()
    return sorted(set(made["b"]))


def _read(index: Index, exact: Sequence[str], begun: Sequence[str], buckets: Sequence[int] | None) -> DataFrame:
    """The postings of some tokens and of all that begin in some way; of a stored index only the files of their buckets."""
    found = index.postings
    if index.stored and buckets is not None:
        found = found.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
    tests = [F.col("token").isin(*exact)] if exact else []
    for n in sorted({len(t) for t in begun}):
        own = [t for t in begun if len(t) == n]
        # A few of them reach the files as filters.
        tests.append(reduce(lambda a, b: a | b, (F.col("token").startswith(t) for t in own)) if len(own) <= 20 else F.substring("token", 1, n).isin(*own))
    return found.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def _terms(queries: DataFrame) -> DataFrame:
    rows = queries.select(*_ID, F.size("tokens").alias("m"), "prefix", F.posexplode("tokens").alias("j", "t"))
    return rows.withColumn("open", F.col("prefix") & (F.col("j") == F.col("m") - 1)).drop("prefix")


def _known(queries: DataFrame) -> tuple[DataFrame, list[Row] | None]:
    """The phrases, and where they are at most ``MANY`` also their rows: few ones are parsed once and sent along with the plan."""
    rows = queries.limit(MANY + 1).collect()
    if len(rows) > MANY:
        return queries, None
    columns = {c: [r[c] for r in rows] for c in queries.columns}
    local = queries.sparkSession.createDataFrame(pa.table({c: pa.array(columns[c], to_arrow_type(queries.schema[c].dataType)) for c in queries.columns}))
    return local.select(*(F.col(f.name).cast(f.dataType) for f in queries.schema)), rows


def _hits(index: Index, queries: DataFrame, rows: list[Row] | None) -> DataFrame:
    """Postings of each term of each phrase: an equi-join by token, for prefixes by first letters of the same length.

    Terms of few phrases choose the buckets and tokens to be read; with more of them tokens are split by a salt, as one of them
    may stand in most documents.
    """
    terms, found, many = _terms(queries), index.postings, rows is None
    if rows is not None:
        pairs = {(t, r["prefix"] and j == len(r["tokens"]) - 1) for r in rows for j, t in enumerate(r["tokens"])}
        exact, begun = sorted(t for t, is_open in pairs if not is_open), sorted(t for t, is_open in pairs if is_open)
        heads = sorted({t[:HEAD] for t, _ in pairs})
        found = _read(index, exact, begun, None if any(len(t) < HEAD for t in begun) else _buckets(index, heads))
    columns = [*KEY, "len", *(f"n_{c}" for c in _FIELDS), "places", *_ID, "m", "j"]
    sizes = terms.where("open").select(F.length("t").alias("size")).distinct().agg(F.sort_array(F.collect_set("size")).alias("sizes"))  # a few lengths of words
    exact_terms, open_terms, on = terms.where("not open").withColumnRenamed("t", "token"), terms.where("open").withColumn("size", F.length("t")), []
    if many:
        on = ["salt"]
        found = found.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
        exact_terms, open_terms = (t.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))) for t in (exact_terms, open_terms))
    met = found.join(exact_terms, ["token", *on]).select(*columns)
    heads = found.join(F.broadcast(sizes)).withColumn("size", F.explode("sizes")).where(F.length("token") >= F.col("size")).withColumn("t", F.expr("substring(token, 1, size)"))
    return met.unionByName(heads.join(open_terms, ["t", "size", *on]).select(*columns))


def scored(index: Index, queries: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(query_id, collection, path, score)`` of every match; queries as ``phrase_rows`` gives them.

    A document matches when it has all of a query's phrases and none of its negated ones.  Statistics are per collection.
    """
    weights = WEIGHTS | (weights or {})
    queries, rows = _known(queries)
    hits = _hits(index, queries, rows)
    per_field = [float(weights[c]) for c in _FIELDS]
    phrases = hits.where("m = 1").select(*_ID, *KEY, "len", sum((F.lit(w) * F.col(f"n_{c}") for c, w in zip(_FIELDS, per_field, strict=True)), F.lit(0.0)).alias("f"))
    if rows is None or any(len(r["tokens"]) > 1 for r in rows):
        # Only where all words of a phrase are in a document their places are compared: it is where each word gives the same start.
        shifted = F.transform("places", lambda x: x - 4 * F.col("j"))
        words = hits.where("m > 1").groupBy(*_ID, *KEY, "len", "m").agg(F.collect_list(F.struct("j", shifted.alias("places"))).alias("xs"), F.size(F.collect_set("j")).alias("n")).where("n = m")
        of = lambda j: F.flatten(F.transform(F.filter("xs", lambda x: x["j"] == j), lambda x: x["places"]))
        starts = F.aggregate(F.sequence(F.lit(1), F.col("m") - 1), of(F.lit(0)), lambda left, j: F.array_intersect(left, of(j)))
        found = words.select(*_ID, *KEY, "len", F.aggregate(starts, F.lit(0.0), _weighed(per_field)).alias("f")).where("f > 0")
        phrases = phrases.unionByName(found)
    phrases = phrases.groupBy(*_ID, *KEY, "len").agg(F.sum("f").alias("f"))
    df = phrases.groupBy("collection", "query_id", "phrase_no").agg(F.count("*").alias("df"))
    needed = queries.where("not negated").groupBy("query_id").agg(F.countDistinct("phrase_no").alias("needed"))
    part = phrases.join(df, ["collection", "query_id", "phrase_no"]).join(index.stats, "collection")
    norm = K1 * (F.lit(1 - B) + B * F.col("len") / F.col("avg"))
    score = F.when(~F.col("negated"), idf(F.col("docs"), F.col("df")) * F.col("f") * (K1 + 1) / (F.col("f") + norm))
    total = part.groupBy("query_id", *KEY).agg(F.sum(score).alias("raw"), F.count(score).alias("n"), F.max("negated").alias("bad"))
    total = total.join(needed, "query_id").where("n = needed and not bad")
    return total.select("query_id", *KEY, normalized(F.col("raw")).alias("score"))


def search_batch(index: Index, queries: DataFrame, limit: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """``(query_id, collection, path, score, rank)`` of many queries at once."""
    ranked = scored(index, queries, weights).withColumn("rank", F.expr("row_number() over (partition by query_id order by round(score, 9) desc, collection, path)"))
    return ranked.where(F.col("rank") <= limit)


def matches(index: Index, query: str, title_weight: float | None = None) -> DataFrame:
    """``(collection, path, score)`` of every match of one search string; InvalidQuery when it asks for nothing.

    One aggregation gathers each document's postings, all phrases at once; a phrase's starts are what its words' places share.
    """
    phrases = parse_query(query, index.analyzer)
    weights = WEIGHTS | ({} if title_weight is None else {"title": title_weight})
    terms = {(t, p.prefix and j == len(p.tokens) - 1) for p in phrases for j, t in enumerate(p.tokens)}
    begun = [t for t, is_open in sorted(terms) if is_open]
    buckets = None if any(len(t) < HEAD for t in begun) else _buckets(index, sorted({t[:HEAD] for t, _ in terms}))
    found = _read(index, [t for t, is_open in sorted(terms) if not is_open], begun, buckets)

    def equal(p: Phrase, j: int) -> Column:
        return F.col("token").startswith(p.tokens[j]) if p.prefix and j == len(p.tokens) - 1 else F.col("token") == p.tokens[j]

    worth = sum((F.lit(float(weights[c])) * F.col(f"n_{c}") for c in _FIELDS), F.lit(0.0))
    gathered, counted = [], []
    for i, p in enumerate(phrases):
        if len(p.tokens) == 1:
            gathered.append(F.sum(F.when(equal(p, 0), worth).otherwise(0.0)).alias(f"_f{i}"))
            counted.append(F.col(f"_f{i}"))
        elif p.tokens:
            gathered += [F.flatten(F.collect_list(F.when(equal(p, j), _shifted(j)))).alias(f"_p{i}_{j}") for j in range(len(p.tokens))]
            starts = reduce(F.array_intersect, (F.col(f"_p{i}_{j}") for j in range(len(p.tokens))))
            counted.append(F.aggregate(starts, F.lit(0.0), _weighed([float(weights[c]) for c in _FIELDS])).alias(f"_f{i}"))
        else:
            counted.append(F.lit(0.0).alias(f"_f{i}"))
    rows = found.groupBy(*KEY, "len").agg(*gathered or [F.lit(0)]).select(*KEY, "len", *counted)
    wanted = [i for i, p in enumerate(phrases) if not p.negated]
    df = rows.groupBy("collection").agg(*(F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"_df{i}") for i in wanted))
    keep = reduce(lambda a, b: a & b, [(F.col(f"_f{i}") == 0) if p.negated else (F.col(f"_f{i}") > 0) for i, p in enumerate(phrases)])
    # A row per collection: as few as there are statistics.
    known = rows.where(keep).join(df.join(index.stats, "collection"), "collection")
    norm = K1 * (F.lit(1 - B) + B * F.col("len") / F.col("avg"))
    raw = sum((idf(F.col("docs"), F.col(f"_df{i}")) * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + norm) for i in wanted), F.lit(0.0))
    return known.select(*KEY, normalized(raw).alias("score"))


def _shifted(by: int) -> Column:
    return F.transform("places", lambda x: x - 4 * by)


def _weighed(weights: Sequence[float]) -> Callable[[Column, Column], Column]:
    return lambda total, place: total + F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(4)).cast("int") + 1)


def search(index: Index, query: str, limit: int = 10, min_score: float | None = None, title_weight: float | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` documents over all collections: per collection the best ``2 * limit``, then together.

    Titles and hashes are looked up for these only, and with ``bodies`` (``collection, path, body``) snippets are made for them.
    """
    top = per_collection(matches(index, query, title_weight), 2 * limit)
    if min_score is not None:
        top = top.where(F.col("score") >= min_score)
    top = top.orderBy(F.round("score", 9).desc(), "collection", "path").limit(limit)
    # At most limit rows are sent round.
    top = index.entries.select(*KEY, "title", "hash").join(F.broadcast(top), KEY)
    if bodies is not None:
        top = bodies.select(*KEY, "body").join(F.broadcast(top), KEY).withColumn("snippet", snippet("body", parse_query(query, index.analyzer), index.analyzer)).drop("body")
    return top.withColumn("doc_id", doc_id(F.col("hash"))).orderBy(F.round("score", 9).desc(), "collection", "path")


__all__ = ["Index", "IndexStore", "Phrase", "entries", "matches", "phrase_rows", "postings", "scored", "search", "search_batch", "statistics"]
