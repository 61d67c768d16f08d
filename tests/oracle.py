"""Run a query in Spark and its SQL twin in DuckDB and compare the rows, order aside."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, decimal.Decimal)) and value == int(value):
        return int(value)
    if isinstance(value, (float, decimal.Decimal)):
        return int(value) if float(value).is_integer() else float(f"{float(value):.10g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in at) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def spark_rows(df):
    return ordered(df.columns, df.collect())


def duck_rows(con, sql: str):
    found = con.execute(sql)
    return ordered([c[0] for c in found.description], found.fetchall())


def compare(df, con, sql: str):
    """Empty text when both sides agree, else a short description of the first difference."""
    (ca, a), (cb, b) = spark_rows(df), duck_rows(con, sql)
    if ca != cb:
        return f"columns {ca} against {cb}"
    if len(a) != len(b):
        extra = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return f"{len(a)} rows against {len(b)}: {extra}"
    differing = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(differing)} of {len(a)} rows differ: {differing[0]}" if differing else ""
