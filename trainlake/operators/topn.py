"""Ordered extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, by: str, limit: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The ``limit`` newest rows (per-task top-k, then one small merge)."""
    order: list[Column] = [F.col(by).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tiebreak]]
    return df.orderBy(*order).limit(limit)


def ascending(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])
