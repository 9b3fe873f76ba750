"""Running a query and its SQL twin, and comparing their rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(frame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in frame.where(frame.notna(), None).values.tolist()), key=repr)
