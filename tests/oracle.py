"""Side-by-side run of a registered query and its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}") + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value):
    return None if value is None else type(value).__name__


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(con, sql, df):
    """Empty text when equal, else what differs."""
    got = df.collect()
    cols, have = rows(df.columns, [tuple(r) for r in got])
    cur = con.execute(sql)
    sql_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
    if cols != sql_cols:
        return f"columns {cols} vs {sql_cols}", len(got)
    kinds = [{kind(r[i]) for r in have} - {None} for i in range(len(cols))]
    sql_kinds = [{kind(r[i]) for r in want} - {None} for i in range(len(cols))]
    if kinds != sql_kinds and have and want:
        return f"types {list(zip(cols, kinds, sql_kinds))}", len(got)
    if have != want:
        more, less = have - want, want - have
        return (f"{sum(have.values())} vs {sum(want.values())} rows; "
                f"only Spark {sum(more.values())}: {list(more)[:2]}; only SQL {sum(less.values())}: {list(less)[:2]}"), len(got)
    return "", len(got)
