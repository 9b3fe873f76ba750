"""Scalar functions as column expressions; only line scans and byte cuts run in Python."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Stop words of feedback terms.
STOPWORDS = (
    "the and for with from that this are was were has have had but you your about into than then they them their can will would should could there what when where which while "
    "using use used also such these those our his her its who why how"
).split()

# Prompt formats of the embedding profiles.
QUERY_FORMATS = {"embeddinggemma": "task: search result | query: {query}", "bge-m3": "Represent this sentence: {query}", "generic": "{query}"}
#: Bytes of a document that a scorer sees.
SCORED_BYTES = 6000


def doc_id(content_hash: Column) -> Column:
    return F.concat(F.lit("#"), F.substring(content_hash, 1, 6))


def stored_text(raw: Column) -> Column:
    """Bytes as text: invalid UTF-8 replaced, CRLF as LF."""
    return F.replace(F.call_function("make_valid_utf8", raw.cast("string")), F.lit("\r\n"), F.lit("\n"))


def normal_query(query: Column) -> Column:
    return F.lower(F.trim(query))


def cache_key(model: Column, query: Column, content_hash: Column | None = None) -> Column:
    """SHA-256 of model, normal query and, for scores, content hash, with NUL between them."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    parts = [model, nul, normal_query(query)] + ([nul, content_hash] if content_hash is not None else [])
    return F.sha2(F.concat(*parts), 256)


def eval_text(title: Column, text: Column) -> Column:
    """Title, blank line, text; the text alone without a title."""
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    return F.when(title == "", text).otherwise(F.concat(title, F.lit("\n\n"), text))


def query_prompt(query: Column, profile: str) -> Column:
    before, after = QUERY_FORMATS[profile].split("{query}")
    return F.concat(F.lit(before), query, F.lit(after))


def document_prompt(title: Column, text: Column, profile: str) -> Column:
    if profile == "embeddinggemma":
        return F.concat(F.lit("title: "), title, F.lit(" | text: "), text)
    return text if profile == "bge-m3" else eval_text(title, text)


def profile_of(model_path: str) -> str:
    name = os.path.basename(model_path).lower()
    return next((p for p in ("embeddinggemma", "bge-m3") if p in name), "generic")


def feedback_terms(text: Column) -> Column:
    """Lower-case ASCII words of three letters or more that are no stop words."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+"), F.lower)
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def l2_normalized(vector: Column) -> Column:
    """The vector by its length; unchanged when the length is 1e-10 or less."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size > 1e-10, F.transform(vector, lambda x: (x.cast("double") / size).cast("float"))).otherwise(vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def yes_no(yes: Column, no: Column) -> Column:
    """Softmax of the yes logit against the no logit."""
    top = F.greatest(yes, no)
    return F.exp(yes - top) / (F.exp(yes - top) + F.exp(no - top))


_BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
#: Front matter: a first line ``---`` up to a line ``---`` or ``...``, or all of the text where none comes.
_FRONT = r"(?sd)\A---\r?(?:\n|\z)(.*?)(?:\z|(?<=\n)(?:---|\.\.\.)\r?(?:\n|\z))"


def _stripped(value: Column, of: str = _BLANK) -> Column:
    return F.regexp_replace(value, f"\\A{of}+|{of}+\\z", "")


def extract_title(text: str | Column, path: str | Column) -> Column:
    """Title of a Markdown text: the last ``title`` or ``name`` of its front matter, else its first line that isn't blank, else the
    file's stem."""
    text, path = (F.col(c) if isinstance(c, str) else c for c in (text, path))
    text = F.coalesce(text, F.lit(""))
    values = F.regexp_extract_all(F.regexp_extract(text, _FRONT, 1), F.lit(r"(?md)^(?:title|name):(.*)$"), 1)
    named = F.filter(F.transform(values, lambda v: _stripped(_stripped(_stripped(v), '"'), "'")), lambda v: v != "")
    rest = F.substr(text, F.length(F.regexp_extract(text, _FRONT, 0)) + 1)
    line = _stripped(F.regexp_extract(rest, rf"\A{_BLANK}*([^\n]*)", 1))
    head = F.when(line.startswith("# "), _stripped(F.substr(line, F.lit(3)))).otherwise(line)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\A(\.*[^.].*)\.[^.]*\z", "$1")
    return F.when(F.size(named) > 0, F.element_at(named, -1)).when(line != "", head).when(stem != "", stem).otherwise(path)


@F.pandas_udf(StringType())
def truncated(text: pd.Series) -> pd.Series:
    """The first 6000 bytes of each text, less a character that is cut in two."""
    return text.map(lambda t: t if t is None or len(t) * 4 <= SCORED_BYTES else t.encode()[:SCORED_BYTES].decode("utf-8", "ignore"), na_action="ignore")


def csv_field(value: Column) -> Column:
    """Quoted when it holds a comma, quote or line break."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.contains(",") | value.contains('"') | value.contains("\n"), quoted).otherwise(value)
