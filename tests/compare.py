"""Run a query and its SQL counterpart and compare all rows, whatever their order."""

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return Counter(tuple(_value(r[n]) for n in order) for r in data)


def compare(df, con, sql):
    """(same, message)"""
    result = con.sql(sql)
    if sorted(df.columns) != sorted(result.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(result.columns)}"
    got, want = rows(df.columns, df.collect()), rows(result.columns, result.fetchall())
    if got == want:
        return True, f"{sum(got.values())} rows"
    return False, (
        f"{sum(got.values())} rows, expected {sum(want.values())}; only here: {list((got - want).items())[:3]}; "
        f"only there: {list((want - got).items())[:3]}"
    )
