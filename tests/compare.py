"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, Decimal):
        return repr(float(v))
    if isinstance(v, datetime):
        return v.isoformat()
    return None if v is None else repr(v)


def table(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cells, key=lambda r: tuple((c is None, c or "") for c in r))


def from_spark(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def from_sql(con, sql: str):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())
