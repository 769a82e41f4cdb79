"""Rows of a query and of its SQL in one comparable form."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, int):
        return float(v) if abs(v) < 2**50 else v
    if isinstance(v, list):
        return tuple(map(norm, v))
    return v


def tables(folder: str):
    c = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def same_rows(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    mine = sorted(([norm(r[c]) for c in cols] for r in df.collect()), key=repr)
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted(([norm(x[i]) for i in at] for x in r.fetchall()), key=repr)
