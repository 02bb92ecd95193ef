"""Rows of a DataFrame and of its SQL in one comparable form."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(df) -> tuple[list[str], list[str]]:
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return db


def rows_of_sql(db, text: str) -> tuple[list[str], list[str]]:
    cursor = db.execute(text)
    names = [c[0] for c in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in order)) for r in cursor.fetchall())
