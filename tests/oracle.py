"""Rows of a Spark query and of its SQL in one comparable form."""

import datetime
import decimal
from pathlib import Path

import duckdb
import numpy as np

DATA = "/root/testdata/sf0.001"


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, (int, float, decimal.Decimal, np.number)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(repr([plain(r[k]) for k in order]) for r in values)


def same(con, df, sql):
    found = con.sql(sql)
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())
