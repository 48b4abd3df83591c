"""Whole-table summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarise(df: DataFrame, count_as: str, means: Mapping[str, Column]) -> DataFrame:
    """Row count and named aggregates in one scan."""
    return df.agg(F.count("*").alias(count_as), *[expr.alias(name) for name, expr in means.items()])


def present_metrics(summary: DataFrame) -> DataFrame:
    """Turn a one-row summary into (metric, value), without NULL and NaN values."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in summary.columns]
    )
    long = summary.select(F.inline(entries))
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many values are missing in each column."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}

    def missing(c: str) -> Column:
        col = F.col(c)
        return col.isNull() | F.isnan(col) if c in floating else col.isNull()

    return df.agg(*[F.count_if(missing(c)).alias(c) for c in columns])


def day_span(df: DataFrame, day: str) -> DataFrame:
    """First day, last day and number of points."""
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("points"))


def latest_day(df: DataFrame, day: str, fallback: str) -> DataFrame:
    """The newest day, or the fallback for an empty table."""
    return df.agg(F.coalesce(F.max(day).cast("date"), F.lit(fallback).cast("date")).alias("latest_day"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count), exact."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
