"""Results as JSON, CSV, Markdown, file names or readable text."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import csv_field

FIELDS = ("collection", "path", "title", "score", "snippet", "hash", "doc_id")


def csv_lines(results: DataFrame) -> DataFrame:
    """``line``: collection, path, title, score to 4 places, doc_id."""
    return results.select(F.concat_ws(",", csv_field(F.col("collection")), csv_field(F.col("path")), csv_field(F.coalesce("title", F.lit(""))), F.format_string("%.4f", "score"), "doc_id").alias("line"))


def json_lines(results: DataFrame) -> DataFrame:
    """``line``: one object per result."""
    return results.select(F.to_json(F.struct(*(c for c in FIELDS if c in results.columns)), {"ignoreNullFields": "false"}).alias("line"))


def markdown_lines(results: DataFrame) -> DataFrame:
    marked = F.replace(F.replace(F.col("snippet"), F.lit("<b>"), F.lit("**")), F.lit("</b>"), F.lit("**"))
    head = F.format_string("- [%s](%s) `%.3f` %s", F.coalesce("title", F.lit("")), "path", "score", "doc_id")
    return results.select(F.concat(head, F.when(F.col("snippet").isNotNull(), F.concat(F.lit("\n  > "), marked)).otherwise("")).alias("line"))


def render(rows: Iterable[dict], form: str = "pretty", full: bool = False) -> str:
    """The few rows of a search result as text."""
    rows = list(rows)
    if form == "json":
        return json.dumps([{f: r.get(f) for f in FIELDS} for r in rows], indent=2, ensure_ascii=False)
    if form == "files":
        return "\n".join(r["path"] for r in rows)
    if form == "csv":

        def field(v: str) -> str:
            return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v

        return "\n".join(["collection,path,title,score,doc_id", *(f"{field(r['collection'])},{field(r['path'])},{field(r['title'] or '')},{r['score']:.4f},{r['doc_id']}" for r in rows)])
    if form == "md":
        return "\n".join(f"- [{r['title']}]({r['path']}) `{r['score']:.3f}` {r['doc_id']}" + (f"\n  > {r['snippet'].replace('<b>', '**').replace('</b>', '**')}" if r.get("snippet") is not None else "") for r in rows)
    if not rows:
        return "no results"
    out = []
    for r in rows:
        out.append(f"{r['score']:.3f} {r['doc_id']} {r['path']}")
        if r["title"] != os.path.splitext(os.path.basename(r["path"]))[0]:
            out.append(f"    {r['title']}")
        text = r.get("doc") if full else r.get("snippet")
        if text:
            out.append("    " + text.replace("<b>", "").replace("</b>", ""))
        out.append("")
    return "\n".join(out)


def chosen_format(as_json: bool = False, as_csv: bool = False, as_md: bool = False, as_files: bool = False) -> str:
    return "json" if as_json else "csv" if as_csv else "md" if as_md else "files" if as_files else "pretty"
