"""Duplicates hidden by formatting: canonical form, 128-bit key, counts with collision checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import all_pairs

#: Front matter: a first line ``---`` (a byte-order mark or trailing blanks don't matter) up to the next line ``---``.
FRONT_MATTER = r"(?s)\A\x{FEFF}?---[ \t\r]*\n((?:.*?\n)??)---[ \t\r]*(?:\n|\z)"


def canonical(text: Column) -> Column:
    """Letters and digits of ``text`` in one letter case, front-matter lines in sorted order.

    Only case is taken away: a ligature or a sharp s stays another letter than its parts.  Both small sigmas
    are one letter.
    """

    def fold(x: Column) -> Column:
        return F.regexp_replace(F.replace(F.lower(x), F.lit("ς"), F.lit("σ")), r"[^\p{L}\p{N}]+", "")

    head = F.regexp_extract(text, FRONT_MATTER, 0)
    lines = F.array_join(F.array_sort(F.transform(F.split(F.regexp_extract(text, FRONT_MATTER, 1), "\n"), fold)), "")
    with_head = F.concat(lines, fold(F.substr(text, F.length(head) + 1)))
    return F.when(text.startswith("---") | text.startswith("﻿---"), F.when(head != "", with_head).otherwise(fold(text))).otherwise(fold(text))


def formatting_keys(content: DataFrame, key: str = "hash", text: str = "doc") -> DataFrame:
    """One row per distinct key: ``(key, form, check)``; ``form`` is the 128-bit hash of the canonical form.

    ``check`` is an independent 64-bit hash of the same form: two forms that met in ``form`` would still
    differ there.  Keys or texts that are null, and texts without letter or digit, give no row.
    """
    form = content.select(F.col(key).alias("key"), canonical(F.col(text)).alias("c")).where("key is not null and c <> ''")
    return form.select("key", F.unhex(F.md5(F.col("c").cast("binary"))).alias("form"), F.xxhash64("c").alias("check")).distinct()


def formatting_groups(content: DataFrame, key: str = "hash", text: str = "doc") -> DataFrame:
    """One row per class of equal records: ``(representative, copies, collided)``.

    copies counts distinct keys; sums are pre-aggregated before the shuffle, so one class may hold most
    rows.  ``collided`` tells whether another canonical form shares the 128-bit key; such forms are kept
    apart.  An empty table gives no rows.
    """
    groups = formatting_keys(content, key, text).groupBy("form", "check").agg(F.min("key").alias("representative"), F.count("*").alias("copies"))
    per_form = groups.groupBy("form").agg(F.count("*").alias("checks"), F.collect_list(F.struct("representative", "copies")).alias("g"))
    return per_form.select(F.inline("g"), (F.col("checks") > 1).alias("collided"))


def formatting_pairs(content: DataFrame, key: str = "hash", text: str = "doc") -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of keys whose texts have the same canonical form."""
    return all_pairs(formatting_keys(content, key, text), ["form", "check"], "key")
