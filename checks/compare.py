"""Run a registered query and its SQL on the same files and compare all values."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _normal(v):
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_normal(r[i]) for i in order) for r in rows)


def difference(spark_df, sql: str, con) -> str | None:
    """None when equal, else a short description."""
    rel = con.sql(sql)
    if sorted(rel.columns) != sorted(spark_df.columns):
        only_a = sorted(set(spark_df.columns) - set(rel.columns))
        only_b = sorted(set(rel.columns) - set(spark_df.columns))
        return f"columns differ: spark only {only_a}, sql only {only_b}"
    kinds = {
        "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    }
    sql_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    off = [(n, t, sql_types[n]) for n, t in spark_df.dtypes if kinds.get(t) != sql_types[n]]
    if off:
        return f"types differ: {off[:6]}"
    mine = rows_of(spark_df.columns, spark_df.collect())
    theirs = rows_of(rel.columns, rel.fetchall())
    if len(mine) != len(theirs):
        return f"rows differ: {len(mine)} vs {len(theirs)}"
    names = sorted(spark_df.columns)
    for a, b in zip(mine, theirs):
        if a != b:
            return f"first difference: {[(n, x, y) for n, x, y in zip(names, a, b) if x != y][:6]}"
    return None if mine else "no rows"
