"""Compare a query with its SQL on the same tables, the order of rows aside."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v}"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_value(r[i]) for i in order) for r in rows])


def difference(df, con, sql: str) -> str | None:
    """What differs first, or None."""
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} / {sorted(want_names)}"
    if len(got) != len(want):
        a, b = set(_rows(got_names, got)), set(_rows(want_names, want))
        return f"rows {len(got)} / {len(want)}; extra {sorted(a - b)[:3]}; missing {sorted(b - a)[:3]}"
    if not want:
        return "both are empty"
    for a, b in zip(_rows(got_names, got), _rows(want_names, want)):
        if a != b:
            return f"spark {a} / sql {b}"
    return None
