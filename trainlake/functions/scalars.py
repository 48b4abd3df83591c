"""Scalar expressions shared by staging, marts and queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import micros


def round_dp(col: Column, places: int) -> Column:
    """Round half away from zero, scaling first and rounding the product."""
    if places == 0:
        return F.round(col.cast("double"), 0)
    scale = float(10**places)
    return F.round(col.cast("double") * F.lit(scale), 0) / F.lit(scale)


def round_dp_even(col: Column, places: int) -> Column:
    """Round half to even, scaling first and rounding the product."""
    scale = float(10**places)
    return F.rint(col.cast("double") * F.lit(scale)) / F.lit(scale)


def seconds_between(a: Column, b: Column) -> Column:
    """Absolute difference in seconds, microseconds kept."""
    return F.abs(micros(a) - micros(b)) / F.lit(1e6)


def day_gap(a: Column, b: Column) -> Column:
    """Absolute difference in calendar days."""
    return F.abs(F.date_diff(a.cast("date"), b.cast("date")))


def iso_day(col: Column) -> Column:
    return col.cast("date").cast("string")


def safe_divide(a: Column, b: Column) -> Column:
    """``a / b`` with NULL instead of a division by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def guarded(condition: Column, value: Column) -> Column:
    """``value`` where the condition holds, NULL elsewhere."""
    return F.when(condition, value)


def tier_bucket(score: Column, default: float = 50.0) -> Column:
    """Readiness score -> tier; a missing score counts as ``default``."""
    s = F.coalesce(score.cast("double"), F.lit(default))
    return F.when(s > 70.0, "PRIME").when(s > 55.0, "MODERATE").otherwise("LOW")


def above(col: Column, threshold: float) -> Column:
    """``col > threshold`` where NULL and NaN both count as not above."""
    return F.coalesce(~F.isnan(col) & (col > F.lit(threshold)), F.lit(False))


def weather_category(rain: Column, cloud: Column) -> Column:
    return (
        F.when(above(rain.cast("double"), 0.05), "rainy")
        .when(above(cloud.cast("double"), 0.65), "overcast")
        .otherwise("clear")
    )


def dummy(category: Column, level: str) -> Column:
    return F.when(category == level, F.lit(1.0)).otherwise(F.lit(0.0))


def member_of(col: Column, families: Mapping[str, Sequence[str]]) -> Column:
    """Name of the family whose member list holds the value, else NULL."""
    expr = None
    for name, members in families.items():
        hit = col.isin(*members)
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    return expr if expr is not None else F.lit(None).cast("string")


def to_km(metres: Column) -> Column:
    return metres / F.lit(1000.0)


def to_kph(metres_per_second: Column) -> Column:
    return metres_per_second * F.lit(3.6)


def to_minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)


def to_hours(seconds: Column) -> Column:
    return seconds / F.lit(3600.0)


def to_percent(fraction: Column) -> Column:
    return fraction * F.lit(100.0)
