"""Typed query expansion: parsing, validity, fallback, cache."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cache_key


class SubQuery(NamedTuple):
    kind: str
    text: str


KINDS = ("lex", "vec", "hyde")


def parse_output(raw: str) -> list[SubQuery]:
    """Lines ``lex: …``, ``vec: …`` and ``hyde: …`` of a model's output; all others are ignored."""
    out = []
    for line in raw.split("\n"):
        kind, colon, text = line.strip().partition(":")
        if colon and kind in KINDS and text.strip():
            out.append(SubQuery(kind, text.strip()))
    return out


def fallback(query: str) -> list[SubQuery]:
    return [SubQuery("lex", query), SubQuery("vec", query), SubQuery("hyde", f"Information about {query}")]


def is_valid(query: str, subs: list[SubQuery]) -> bool:
    """Whether some word of some sub-query occurs in the query."""
    query = query.lower()
    return any(word.lower() in query for s in subs for word in s.text.split())


def parsed(raw: Column) -> Column:
    """``parse_output`` as an expression: an array of ``(kind, text)``."""
    lines = F.transform(F.split(raw, "\n"), lambda line: F.trim(line))
    typed = F.transform(lines, lambda line: F.struct(F.regexp_extract(line, "^(lex|vec|hyde):", 1).alias("kind"), F.trim(F.regexp_replace(line, "^(lex|vec|hyde):", "")).alias("text")))
    return F.filter(typed, lambda s: (s["kind"] != "") & (s["text"] != ""))


def fallback_subs(query: Column) -> Column:
    parts = (("lex", query), ("vec", query), ("hyde", F.concat(F.lit("Information about "), query)))
    return F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in parts))


def expanded(queries: DataFrame, raw: str) -> DataFrame:
    """``(query_id, seq, kind, text)``: sub-queries of the column ``raw``, or the fallback where they aren't valid."""
    subs = parsed(F.coalesce(F.col(raw), F.lit("")))
    query = F.lower("text")
    words = F.flatten(F.transform(subs, lambda s: F.filter(F.split(s["text"], r"\s+"), lambda w: w != "")))
    good = F.exists(words, lambda w: F.contains(query, F.lower(w)))
    chosen = F.when(F.coalesce(good, F.lit(False)), subs).otherwise(fallback_subs(F.col("text")))
    return queries.select("query_id", F.posexplode(chosen).alias("seq", "s")).select("query_id", "seq", "s.kind", "s.text")


def cached(queries: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Queries with their cached sub-queries, and those without; cache: ``key, subs, created_at``."""
    newest = cache.groupBy("key").agg(F.max_by("subs", "created_at").alias("subs"))
    both = queries.withColumn("key", cache_key(F.lit(model), F.col("text"))).join(newest, "key", "left")
    return both.where("subs is not null"), both.where("subs is null").drop("subs")


def expand_all(queries: list[str], expander, use_fallback_on_error: bool = True) -> dict[str, tuple[list[SubQuery], bool]]:
    """Sub-queries of each query, and whether they are the model's own and may be cached."""
    out = {}
    for query in queries:
        try:
            subs, genuine = expander.expand_query(query), True
        except Exception:
            if not use_fallback_on_error:
                raise
            subs, genuine = fallback(query), False
        out[query] = (subs if is_valid(query, subs) else fallback(query), genuine)
    return out
