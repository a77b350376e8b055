"""Runs a query and its SQL side by side: sorted columns, rows as a multiset, floats to nine digits."""

from __future__ import annotations

import datetime as dt
import decimal
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}" if float(v) == float(v) else "nan"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    return str(v)


def rows_of(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    own = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    other = rows_of([d[0] for d in result.description], result.fetchall())
    if own[0] != other[0]:
        return f"columns {own[0]} and {other[0]}"
    if own[1] != other[1]:
        return f"{sum(own[1].values())} and {sum(other[1].values())} rows; only here {list((own[1] - other[1]).items())[:2]}; only there {list((other[1] - own[1]).items())[:2]}"
    return None
