"""Markdown files of a collection: which ones, and their contents."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import extract_title, stored_text

DEFAULT_GLOBS = ("**/*.md",)


def glob_pattern(glob: str) -> re.Pattern[str]:
    """A glob as a pattern over relative paths; one without a slash matches at any depth."""
    anchored = "/" in glob.rstrip("/")
    glob = glob.strip("/")
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end + 1
        elif glob[i] == "{" and (end := glob.find("}", i)) > 0:
            out.append("(?:" + "|".join(re.escape(x) for x in glob[i + 1 : end].split(",")) + ")")
            i = end + 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return re.compile(("" if anchored else "(?:.*/)?") + "".join(out) + "(?:/.*)?\\Z", re.S)


def _ignored(root: str, folder: str, known: dict[str, list[tuple[re.Pattern[str], bool]]]) -> list[tuple[re.Pattern[str], bool]]:
    """Patterns of a folder's .gitignore, over paths relative to it, and whether each re-includes."""
    if folder not in known:
        rules = []
        try:
            with open(os.path.join(root, folder, ".gitignore"), encoding="utf-8", errors="replace") as lines:
                for line in lines:
                    line = line.rstrip("\n").rstrip()
                    if line and not line.startswith("#"):
                        rules.append((glob_pattern(line.removeprefix("!")), line.startswith("!")))
        except OSError:
            pass
        known[folder] = rules
    return known[folder]


def wanted_paths(root: str, globs: Sequence[str] = (), excludes: Sequence[str] = (), gitignore: bool = True) -> list[str]:
    """Sorted relative paths of the regular files below ``root`` that a glob includes and none excludes.

    Hidden files count.  Files named by a .gitignore are left out unless ``globs`` were given.
    """
    include = [glob_pattern(g) for g in (globs or DEFAULT_GLOBS)]
    exclude = [glob_pattern(g) for g in excludes]
    known: dict[str, list[tuple[re.Pattern[str], bool]]] = {}
    out = []
    for folder, _, names in os.walk(root):
        base = os.path.relpath(folder, root)
        for name in names:
            path = name if base == "." else f"{base}/{name}"
            if not os.path.isfile(os.path.join(root, path)) or os.path.islink(os.path.join(root, path)):
                continue
            if not any(p.match(path) for p in include) or any(p.match(path) for p in exclude):
                continue
            hidden = False
            if gitignore and not globs:
                parts = path.split("/")
                for depth in range(len(parts)):
                    for pattern, back in _ignored(root, "/".join(parts[:depth]), known):
                        if pattern.match("/".join(parts[depth:])):
                            hidden = not back
            if not hidden:
                out.append(path)
    return sorted(out)


def read_files(spark: SparkSession, collection: str, root: str, globs: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """``collection, path, title, hash, doc`` of the collection's files.

    hash is of the raw bytes; doc is the text with CRLF as LF.
    """
    paths = wanted_paths(root, globs, excludes)
    if not paths:
        return spark.createDataFrame([], "collection string, path string, title string, hash string, doc string")
    root = os.path.abspath(root)
    # Spark's reader passes over names that begin with a dot or an underscore; those are read by path.
    special = [p for p in paths if re.search(r"(^|/)[._]", os.path.join(root, p))]
    parts = []
    if usual := sorted(set(paths) - set(special)):
        raw = spark.read.format("binaryFile").load([os.path.join(root, p) for p in usual])
        path = F.url_decode(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
        parts.append(raw.select(F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path)).alias("path"), "content"))
    if special:

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for p in batch["path"]:
                    with open(os.path.join(root, p), "rb") as f:
                        yield pd.DataFrame({"path": [p], "content": [f.read()]})

        parts.append(spark.createDataFrame([(p,) for p in special], "path string").mapInPandas(read, "path string, content binary"))
    raw = reduce(DataFrame.unionByName, parts)
    rows = raw.select(F.lit(collection).alias("collection"), "path", F.sha2("content", 256).alias("hash"), stored_text(F.col("content")).alias("doc"))
    return rows.select("collection", "path", extract_title("doc", "path").alias("title"), "hash", "doc")
