"""Runs a query and its SQL on the same tables and compares rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "item"):
        return cell(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(df, sql: str, con) -> str:
    """Empty if both give the same bag of rows, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = Counter(tuple(cell(v) for _, v in sorted(zip(names, r))) for r in cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    cols = sorted(df.columns)
    got = Counter(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if got == want:
        return "" if sum(got.values()) else "no rows"
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want))[:3]}; only there {list((want - got))[:3]}"
