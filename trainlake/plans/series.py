"""Metric time series: date, value, label, optional rolling mean, summary."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_day, round_dp, to_hours, to_minutes
from ..operators.filters import on_or_after, on_or_before, present, sport_is, where_all
from ..operators.ordered import SERIES_ROWS, rolling_mean
from ..operators.summary import day_span


@dataclass(frozen=True)
class Metric:
    title: str
    source: str
    places: int | None = None
    unit: Callable[[Column], Column] | None = None

    def value(self) -> Column:
        col = F.col(self.source)
        if self.unit:
            col = self.unit(col)
        return col.cast("double") if self.places is None else round_dp(col, self.places)


@dataclass(frozen=True)
class Family:
    table: str
    day: str
    label: str | None
    by_sport: bool
    metrics: Mapping[str, Metric]


def _activity_family(table: str, by_sport: bool, metrics: Mapping[str, Metric]) -> Family:
    return Family(table, "activity_date", "activity_name", by_sport, metrics)


def _day_family(table: str, metrics: Mapping[str, Metric]) -> Family:
    return Family(table, "calendar_date", None, False, metrics)


# The catalogue of metric families.
CATALOGUE: dict[str, Family] = {
    "activity": _activity_family("fct_activity", True, {
        "avg_speed_kph": Metric("Avg Speed (km/h)", "average_speed_kph", 2),
        "distance_km": Metric("Distance (km)", "distance_km", 2),
        "elevation_gain_m": Metric("Elevation Gain (m)", "elevation_gain_m", 0),
        "average_watts": Metric("Avg Power (W)", "average_watts", 1),
        "average_heart_rate_bpm": Metric("Avg HR (bpm)", "average_heart_rate_bpm"),
        "moving_time_min": Metric("Moving Time (min)", "moving_time_s", 1, to_minutes),
        "relative_effort": Metric("Relative Effort", "relative_effort", 0),
        "calories_kcal": Metric("Calories (kcal)", "calories_kcal"),
    }),
    "health": _day_family("int_garmin__daily", {
        "hrv_ms": Metric("HRV (ms)", "hrv_ms", 1),
        "sleep_score": Metric("Sleep Score", "sleep_score"),
        "readiness_score": Metric("Readiness Score", "readiness_score"),
        "body_battery_start_of_day": Metric("Body Battery (start of day)", "body_battery_start_of_day"),
        "stress_avg": Metric("Avg Stress", "stress_avg"),
        "total_sleep_h": Metric("Total Sleep (h)", "total_sleep_s", 2, to_hours),
        "recovery_time_h": Metric("Recovery Time (h)", "recovery_time_h"),
        "resting_hr_7d_avg_bpm": Metric("Resting HR 7d avg (bpm)", "resting_hr_7d_avg_bpm", 1),
    }),
    "run_pace": _activity_family("fct_run", False, {
        "pace_min_per_km": Metric("Pace (min/km) - lower is faster", "pace_min_per_km", 2),
        "gap_min_per_km": Metric("Grade-Adjusted Pace (min/km) - lower is faster", "gap_min_per_km", 2),
    }),
    "ride_power": _activity_family("fct_ride", False, {
        "average_watts": Metric("Avg Power (W)", "average_watts", 1),
        "weighted_average_power_w": Metric("Normalized Power (W)", "weighted_average_power_w", 1),
        "average_wkg": Metric("Avg W/kg", "average_wkg", 3),
    }),
    "race_predictions": _day_family("stg_garmin__run_race_predictions", {
        f"predicted_{race}_pace_min_per_km": Metric(f"Predicted {name} Pace (min/km)", f"predicted_{race}_pace_min_per_km", 2)
        for race, name in (("5k", "5K"), ("10k", "10K"), ("half", "Half Marathon"), ("marathon", "Marathon"))
    }),
}


class SeriesError(ValueError):
    """An unknown family or metric, or no data under the filters."""


def find_metric(chart_type: str, metric: str) -> tuple[Family, Metric]:
    family = CATALOGUE.get(chart_type)
    if family is None:
        raise SeriesError(f"Unknown chart_type {chart_type!r}. Valid: {list(CATALOGUE)}")
    if metric not in family.metrics:
        raise SeriesError(f"Unknown metric {metric!r} for {chart_type!r}. Valid: {list(family.metrics)}")
    return family, family.metrics[metric]


def metric_points(
    table: DataFrame,
    family: Family,
    metric: Metric,
    sport_type: str | None = None,
    start_date: str | date | None = None,
    end_date: str | date | None = None,
    rolling_points: int = 0,
    keys: Sequence[str] = (),
    max_rows: int = SERIES_ROWS,
    measure: DataFrame | None = None,
) -> DataFrame:
    """keys, date, value, label[, rolling]; rows without a value are left out first.

    The rolling mean runs per key.  Equal days are ordered by activity id, or by
    value where rows have none.  ``measure`` is a narrower table with about as
    many rows per key, counted in place of ``table``.
    """
    day = F.col(family.day)
    sport = sport_is(F.col("activity_type"), sport_type) if family.by_sport else None
    label = F.col(family.label) if family.label else F.lit(None).cast("string")
    tie = F.col("activity_id") if family.label else F.lit(None).cast("bigint")
    kept = where_all(table, [sport, on_or_after(day, start_date), on_or_before(day, end_date)])
    points = kept.select(
        *keys, day.cast("date").alias("date"), metric.value().alias("value"), label.alias("label"), tie.alias("_tie")
    ).filter(present(F.col("value")))
    if rolling_points > 0:
        order = [F.col("date").asc_nulls_last(), F.col("_tie").asc_nulls_last(), F.col("value").asc()]
        points = rolling_mean(points, "value", rolling_points, order, keys, max_rows=max_rows, measure=None if measure is None else measure.select(*keys))
    return points


@dataclass(frozen=True)
class Series:
    points: DataFrame
    title: str
    start_date: str | date | None
    end_date: str | date | None

    def ordered(self) -> DataFrame:
        """Points from old to new with the date as text."""
        by = [F.col(c).asc_nulls_last() for c in ("date", "_tie", "value")]
        return self.points.orderBy(*by).withColumn("date", iso_day(F.col("date"))).drop("_tie")

    def span(self) -> DataFrame:
        return day_span(self.points, "date")

    def summary(self) -> dict[str, object]:
        """One sentence and the number of points; fails when there is none."""
        row = self.span().first()
        n = row["points"]
        if n == 0:
            raise SeriesError("No data found for the requested filters.")
        first, last = str(row["first_day"]), str(row["last_day"])
        title = self.title
        if self.start_date or self.end_date:
            title += f" ({self.start_date or first} to {self.end_date or last})"
        plural = "" if n == 1 else "s"
        return {"summary": f"{title}: {n} point{plural}, {first} to {last}", "data_points": n}


def metric_series(
    lake,
    chart_type: str,
    metric: str,
    sport_type: str | None = None,
    start_date: str | date | None = None,
    end_date: str | date | None = None,
    rolling_days: int = 0,
    keys: Sequence[str] = (),
) -> Series:
    """A catalogue metric as a series; ``rolling_days`` counts data points."""
    family, found = find_metric(chart_type, metric)
    # The day spine has a row per daily summary; counting those spares running its joins twice.
    measure = lake.table("stg_garmin__daily_summary") if family.table == "int_garmin__daily" else None
    points = metric_points(lake.table(family.table), family, found, sport_type, start_date, end_date, rolling_days, keys, measure=measure)
    title = found.title
    if sport_type and sport_type.lower() != "all":
        title += f" - {sport_type}"
    return Series(points, title, start_date, end_date)
