"""Runs a query and its SQL on one folder of tables and compares the rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.10g}")
    return str(v) if not isinstance(v, int | bool) else v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(sql: str, folder: Path):
    con = duckdb.connect()
    for p in folder.iterdir():
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, Counter(tuple(_plain(r[i]) for i in at) for r in got.fetchall())


def assert_same(df, sql: str, folder: Path):
    a, b = rows_of_spark(df), rows_of_sql(sql, folder)
    assert a[0] == b[0]
    assert a[1] - b[1] == Counter() and b[1] - a[1] == Counter(), (list((a[1] - b[1]).items())[:3], list((b[1] - a[1]).items())[:3])
