"""Registered queries with the SQL that states their result.

Names start with the identifiers of the operators a query exercises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def times_as_text(df: DataFrame) -> DataFrame:
    """Days and times as ISO text, which both engines print alike."""
    return df.withColumns({n: F.col(n).cast("string") for n, t in df.dtypes if t in ("date", "timestamp_ntz")})
