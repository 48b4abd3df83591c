"""Latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Column,
    tiebreak: Sequence[Column | str] = (),
) -> DataFrame:
    """Keep the row with the highest ``order`` per key; NULL order ranks last.

    The ``= 1`` filter lets Spark place a rank limit below the shuffle, so each
    map task sends at most one row per key and a hot key costs nothing extra.
    """
    by = F.col(order) if isinstance(order, str) else order
    window = Window.partitionBy(*keys).orderBy(by.desc_nulls_last(), *tiebreak)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def row_fingerprint(columns: Sequence[str]) -> Column:
    """A cheap, stable tie-break over the given columns."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])
