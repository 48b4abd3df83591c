"""Long-to-wide conditional pivot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_pivot(
    df: DataFrame,
    keys: Sequence[str],
    on: str,
    picks: Mapping[str, Mapping[str, Column]],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per key; ``picks[value][alias]`` is the maximum of that expression over rows where ``on`` is value.

    A single grouped aggregate: partial maxima are formed before the shuffle.
    """
    return df.groupBy(*keys).agg(*extra, *pivot_aggregates(F.col(on), picks))


def pivot_aggregates(on: Column, picks: Mapping[str, Mapping[str, Column]]) -> list[Column]:
    """The aggregates of a conditional pivot, each under its alias."""
    return [F.max(F.when(on == value, expr)).alias(alias) for value, fields in picks.items() for alias, expr in fields.items()]


def any_row(condition: Column) -> Column:
    """True when the condition holds on any row of the group, false when on none."""
    return F.coalesce(F.max(F.coalesce(condition, F.lit(False))), F.lit(False))
