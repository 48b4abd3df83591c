"""Composable predicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column | None]) -> Column | None:
    """AND of the conditions that are present."""
    present = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, present) if present else None


def where_all(df: DataFrame, conditions: Iterable[Column | None]) -> DataFrame:
    condition = all_of(conditions)
    return df if condition is None else df.filter(condition)


def sport_is(col: Column, sport: str | None) -> Column | None:
    """Case-insensitive equality; absent or ``all`` means no filter."""
    if not sport or sport.lower() == "all":
        return None
    return F.lower(col) == sport.lower()


def tier_is(col: Column, tier: str | None) -> Column | None:
    return (F.upper(col) == tier.upper()) if tier else None


# Stored columns that hold the sport in lower and the tier in upper case.
FOLDED_SPORT, FOLDED_TIER = "_sport", "_tier"


def with_folded(df: DataFrame, sport: str = "activity_type", tier: str = "readiness_level") -> DataFrame:
    """Add the folded columns, so that a stored table's files answer for a sport or tier in any spelling."""
    return df.withColumns({FOLDED_SPORT: F.lower(sport), FOLDED_TIER: F.upper(tier)})


def on_or_after(col: Column, day: date | str | None) -> Column | None:
    return (col >= F.lit(str(day)).cast("date")) if day else None


def on_or_before(col: Column, day: date | str | None) -> Column | None:
    return (col <= F.lit(str(day)).cast("date")) if day else None


def activity_conditions(
    sport_type: str | None = None,
    start_date: date | str | None = None,
    end_date: date | str | None = None,
    readiness_tier: str | None = None,
    alias: str = "",
    folded: bool = False,
) -> list[Column | None]:
    """The optional activity filters, as Columns, on an optionally aliased table.

    ``folded`` compares the stored folded columns, which reaches the files.
    """
    dot = f"{alias}." if alias else ""
    if folded:
        no_sport = sport_is(F.lit(""), sport_type) is None
        sport = None if no_sport else F.col(f"{dot}{FOLDED_SPORT}") == sport_type.lower()
        tier = F.col(f"{dot}{FOLDED_TIER}") == readiness_tier.upper() if readiness_tier else None
        return [sport, on_or_after(F.col(f"{dot}activity_date"), start_date), on_or_before(F.col(f"{dot}activity_date"), end_date), tier]
    return [
        sport_is(F.col(f"{dot}activity_type"), sport_type),
        on_or_after(F.col(f"{dot}activity_date"), start_date),
        on_or_before(F.col(f"{dot}activity_date"), end_date),
        tier_is(F.col(f"{dot}readiness_level"), readiness_tier),
    ]


def not_in_or_null(col: Column, banned: Sequence[str]) -> Column:
    """True unless the value is banned; NULL passes."""
    return ~F.coalesce(col, F.lit("")).isin(*banned)


def present(col: Column) -> Column:
    """Neither NULL nor NaN."""
    return col.isNotNull() & ~F.isnan(col.cast("double"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every listed column is neither NULL nor NaN."""
    return df.na.drop(subset=list(columns))
