"""Boolean, phrase and prefix full-text search ranked by BM25, as DataFrame algebra."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..functions.analysis import simple_tokens, stemmed, stemmed_tokens
from ..functions.scalars import doc_id

K1, B = 1.2, 0.75
#: Distinct terms of a batch of queries up to which tokens are tested before they are joined.
MANY = 5000
#: The searched columns and their weights.
WEIGHTS = {"path": 10.0, "title": 1.0, "body": 1.0}

_QUERY = re.compile(r'[ \t]+|-(?P<no>[^ \t]*)|"(?P<phrase>[^"]*)"?|(?P<term>[^ \t]+)')
_WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Phrase:
    """Tokens in a row; with ``prefix`` the last one may go on; ``negated`` ones exclude a document."""

    tokens: tuple[str, ...]
    prefix: bool = False
    negated: bool = False


def analyzed(text: str, analyzer: str = "simple") -> tuple[str, ...]:
    return tuple(stemmed(text) if analyzer == "porter" else _WORDS.findall(text.lower()))


def parse_query(text: str, analyzer: str = "simple") -> list[Phrase]:
    """Phrases of a search string.

    Spaces and tabs separate; a leading dash negates a term; double quotes make an exact phrase, an open one
    running to the end; every other term is a prefix.  Only negations, or nothing at all, is no query.
    """
    out = []
    for m in _QUERY.finditer(text):
        if m["no"]:
            out.append(Phrase(analyzed(m["no"], analyzer), negated=True))
        elif m["phrase"]:
            out.append(Phrase(analyzed(m["phrase"], analyzer)))
        elif m["term"]:
            out.append(Phrase(analyzed(m["term"], analyzer), prefix=True))
    if not any(not p.negated for p in out):
        raise InvalidQuery(f"nothing to look for in {text!r}")
    return out


def _tokens(text: Column, analyzer: str) -> Column:
    return stemmed_tokens(text) if analyzer == "porter" else simple_tokens(text)


def _occurrences(tokens: Column, phrase: Phrase) -> Column:
    """How often a phrase occurs in an array of tokens."""

    def equal(token: Column, j: int) -> Column:
        word = F.lit(phrase.tokens[j])
        return token.startswith(word) if phrase.prefix and j == len(phrase.tokens) - 1 else token == word

    n = len(phrase.tokens)
    if not n:
        return F.lit(0)
    if n == 1:
        return F.size(F.filter(tokens, lambda t: equal(t, 0)))
    # Tokens hold letters and digits only, so in a line of tokens a phrase is a pattern.  What follows the first
    # token is looked at without being consumed: occurrences may overlap.  (Indexing the array inside a lambda
    # would make the optimizer tokenize the text again for every position.)
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    rest = " ".join(phrase.tokens[1:]) + ("" if phrase.prefix else " ")
    return F.regexp_count(line, F.lit(f"(?<= ){phrase.tokens[0]}(?= {rest})"))


def idf(n: Column, df: Column) -> Column:
    value = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(value > 0, value).otherwise(F.lit(1e-6))


def normalized(score: Column) -> Column:
    """A positive raw score on a scale from 0 to 1."""
    return score / (F.lit(1.0) + score)


def matches(docs: DataFrame, phrases: Sequence[Phrase], analyzer: str = "simple", weights: dict[str, float] | None = None) -> DataFrame:
    """Every document that matches, with its normalized ``score``; statistics are per collection.

    docs: ``collection, path, title, body, hash``, active documents only.  Two scans: one for the
    statistics, a few numbers per collection, one that scores.  Nothing is exploded, no text is shuffled.
    A phrase without tokens matches nothing, which empties the result.
    """
    weights = WEIGHTS | (weights or {})
    wanted = [p for p in phrases if not p.negated]
    arrays = docs.select("collection", "path", "title", "hash", *(_tokens(F.col(c), analyzer).alias(f"_{c}") for c in weights))
    counts = [sum((_occurrences(F.col(f"_{c}"), p) for c in weights), F.lit(0)).alias(f"_n{i}") for i, p in enumerate(phrases)]
    weighted = [sum((F.lit(w) * _occurrences(F.col(f"_{c}"), p) for c, w in weights.items()), F.lit(0.0)).alias(f"_f{i}") for i, p in enumerate(wanted)]
    length = sum((F.size(f"_{c}") for c in weights), F.lit(0)).alias("_len")
    rows = arrays.select("collection", "path", "title", "hash", length, *counts, *weighted)
    position = [i for i, p in enumerate(phrases) if not p.negated]
    stats = rows.groupBy("collection").agg(F.count("*").alias("_docs"), F.avg("_len").alias("_avg"), *(F.count(F.when(F.col(f"_n{i}") > 0, 1)).alias(f"_df{k}") for k, i in enumerate(position)))
    keep = reduce(lambda a, b: a & b, [(F.col(f"_n{i}") == 0) if p.negated else (F.col(f"_n{i}") > 0) for i, p in enumerate(phrases)])
    hits = rows.where(keep).join(stats, "collection")
    norm = K1 * (F.lit(1 - B) + B * F.col("_len") / F.col("_avg"))
    raw = sum((idf(F.col("_docs"), F.col(f"_df{k}")) * F.col(f"_f{k}") * (K1 + 1) / (F.col(f"_f{k}") + norm) for k in range(len(wanted))), F.lit(0.0))
    return hits.select("collection", "path", "title", "hash", normalized(raw).alias("score"))


def search(docs: DataFrame, query: str, limit: int = 10, min_score: float | None = None, analyzer: str = "simple", title_weight: float | None = None, snippets: bool = False) -> DataFrame:
    """The best ``limit`` documents over all collections: per collection the best ``2 * limit``, then together."""
    phrases = parse_query(query, analyzer)
    found = matches(docs, phrases, analyzer, None if title_weight is None else {"title": title_weight})
    top = per_collection(found, 2 * limit)
    if min_score is not None:
        top = top.where(F.col("score") >= min_score)
    top = top.orderBy(F.round("score", 9).desc(), "collection", "path").limit(limit)
    if snippets:
        bodies = docs.select("collection", "path", "body")
        top = top.join(bodies, ["collection", "path"], "left").withColumn("snippet", snippet("body", phrases, analyzer)).drop("body")
    return top.withColumn("doc_id", doc_id(F.col("hash")))


def per_collection(found: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` rows of each collection."""
    return found.withColumn("_r", F.expr("row_number() over (partition by collection order by round(score, 9) desc, path)")).where(F.col("_r") <= limit).drop("_r")


def phrase_rows(queries: DataFrame, query_id: str = "query_id", text: str = "text", analyzer: str = "simple") -> DataFrame:
    """One row per phrase of each query string; strings without a positive phrase give none."""

    def run(batches):
        for batch in batches:
            rows = []
            for q, t in zip(batch["q"], batch["t"], strict=True):
                try:
                    rows += [(q, i, p.negated, p.prefix, list(p.tokens)) for i, p in enumerate(parse_query(t or "", analyzer))]
                except InvalidQuery:
                    continue
            yield pd.DataFrame(rows, columns=["query_id", "phrase_no", "negated", "prefix", "tokens"])

    kind = queries.schema[query_id].dataType.simpleString()
    return queries.select(F.col(query_id).alias("q"), F.col(text).alias("t")).mapInPandas(run, f"query_id {kind}, phrase_no int, negated boolean, prefix boolean, tokens array<string>")


# ---- snippets -------------------------------------------------------------------------------------

WINDOW, OPEN, CLOSE, MORE = 32, "<b>", "</b>", "..."


def snippet_of(body: str | None, phrases: Sequence[Phrase], analyzer: str = "simple") -> str | None:
    """The stretch of 32 tokens with the most distinct phrases, hits marked.

    The stretch is centred on its hits and kept inside the text; a sentence start before a hit, above all the
    text's start, is preferred.  Without a hit it is the text's beginning.
    """
    if body is None:
        return None
    spans = [m.span() for m in _WORDS.finditer(body)]
    tokens = [analyzed(body[a:b], analyzer)[:1] or ("",) for a, b in spans]
    words = [t[0] for t in tokens]
    n = len(words)
    hits: list[tuple[int, int, int]] = []
    for i, p in enumerate(p for p in phrases if not p.negated and p.tokens):
        m = len(p.tokens)
        for at in range(n - m + 1):
            last = words[at + m - 1]
            if all(words[at + j] == p.tokens[j] for j in range(m - 1)) and (last.startswith(p.tokens[-1]) if p.prefix else last == p.tokens[-1]):
                hits.append((at, i, m))
    hits.sort()

    def score(pos: int) -> tuple[int, int]:
        seen: set[int] = set()
        value, first, last_end = 0, -1, 0
        for at, i, m in hits:
            if pos <= at < pos + WINDOW:
                value += 1 if i in seen else 1000
                seen.add(i)
                first = at if first < 0 else first
                last_end = max(last_end, at + m)
        start = first - int((WINDOW - (last_end - first)) / 2) if first >= 0 else pos
        return value, max(0, min(start, n - WINDOW))

    best, start = 0, 0
    starts = [0] + [k for k in range(1, n) if re.search(r"[.:]", body[spans[k - 1][1] : spans[k][0]])]
    for at, _, _ in hits:
        value, place = score(at)
        if value > best:
            best, start = value, place
        if n > WINDOW:
            before = max(k for k in starts if k <= at)
            value = score(before)[0] + (120 if before == 0 else 100)
            if value > best:
                best, start = value, before
    stop = min(n, start + WINDOW)
    if not n:
        return body
    marked = [False] * n
    joined = [False] * n
    for at, _, m in hits:
        for k in range(at, at + m):
            marked[k] = True
            joined[k] = joined[k] or k > at
    out, at = [], 0 if start == 0 else spans[start][0]
    for k in range(start, stop):
        a, b = spans[k]
        inside = joined[k] and k > start and marked[k - 1]
        if marked[k] and not inside:
            out.append(body[at:a] + OPEN)
            at = a
        out.append(body[at:b])
        at = b
        if marked[k] and not (k + 1 < stop and joined[k + 1]):
            out.append(CLOSE)
    text = "".join(out) + (body[at:] if stop == n else "")
    return (MORE if start else "") + text + (MORE if stop < n else "")


def snippet(body: str, phrases: Sequence[Phrase], analyzer: str = "simple") -> Column:
    """``snippet_of`` a column; meant for the few rows of a result."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet_of(t, phrases, analyzer), na_action="ignore")

    return run(F.col(body))
