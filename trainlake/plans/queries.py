"""Parameterised questions over the marts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import repair_date_argument
from ..functions.scalars import iso_day, round_dp, to_hours, to_minutes, to_percent
from ..operators.filters import FOLDED_SPORT, activity_conditions, on_or_after, on_or_before, where_all
from ..operators.summary import latest_day, present_metrics, summarise
from ..operators.topn import ascending, newest

# Fixed value: the day reported when the activity mart is empty.
FALLBACK_DAY = "2026-04-04"


def _c(name: str) -> Column:
    return F.col(name)


def _mean(name: str, places: int) -> Column:
    return round_dp(F.avg(name), places)


# Fixed values below: result names, their sources and decimals.


def activity_means() -> dict[str, Column]:
    return {
        "avg_distance_km": _mean("distance_km", 2),
        "avg_moving_time_min": round_dp(to_minutes(F.avg("moving_time_s")), 1),
        "avg_hr_bpm": _mean("average_heart_rate_bpm", 1),
        "avg_strava_relative_effort": _mean("relative_effort", 1),
        "avg_garmin_training_load": _mean("activity_training_load", 1),
        "avg_readiness_score": _mean("readiness_score", 1),
    }


def health_means() -> dict[str, Column]:
    return {
        "avg_readiness_score": _mean("readiness_score", 1),
        "avg_hrv_ms": _mean("hrv_ms", 1),
        "avg_sleep_score": _mean("sleep_score", 1),
        "avg_sleep_h": round_dp(to_hours(F.avg("total_sleep_s")), 2),
        "avg_resting_hr_bpm": _mean("current_resting_hr_bpm", 1),
        "avg_stress_score": _mean("stress_avg", 1),
        "avg_active_kcal": _mean("active_kcal", 0),
        "avg_steps": _mean("total_steps", 0),
    }


def activity_row() -> dict[str, Column]:
    """Result columns of one activity, in order."""
    return {
        "date": iso_day(_c("activity_date")),
        "sport": _c("activity_type"),
        "name": _c("activity_name"),
        "distance_km": round_dp(_c("distance_km"), 2),
        "moving_time_min": round_dp(to_minutes(_c("moving_time_s")), 1),
        "avg_speed_kph": round_dp(_c("average_speed_kph"), 1),
        "elevation_gain_m": round_dp(_c("elevation_gain_m"), 0),
        "avg_hr": _c("average_heart_rate_bpm"),
        "max_hr": _c("max_heart_rate_bpm"),
        "average_watts": _c("average_watts"),
        "aerobic_training_effect": round_dp(_c("aerobic_training_effect"), 1),
        "anaerobic_training_effect": round_dp(_c("anaerobic_training_effect"), 1),
        "training_effect_label": _c("training_effect_label"),
        "activity_training_load": _c("activity_training_load"),
        "relative_effort": _c("relative_effort"),
        "zone_2_aerobic_min": round_dp(to_minutes(_c("hr_zone_2_s")), 1),
        "zone_5_anaerobic_min": round_dp(to_minutes(_c("hr_zone_5_s")), 1),
        "readiness_score": _c("readiness_score"),
        "readiness_level": _c("readiness_level"),
        "residual_recovery_needed_h": _c("recovery_time_h"),
        "temperature_c": round_dp(_c("weather_temperature_c"), 1),
        "feels_like_c": round_dp(_c("apparent_temperature_c"), 1),
        "humidity_pct": round_dp(to_percent(_c("humidity_fraction")), 0),
        "wind_speed_ms": round_dp(_c("wind_speed_ms"), 1),
    }


def health_row() -> dict[str, Column]:
    """Result columns of one day, in order."""
    plain = lambda text: {n: _c(n) for n in text.split()}
    return {
        "calendar_date": iso_day(_c("calendar_date")),
        **plain("readiness_score readiness_level readiness_feedback_short training_status"),
        "hrv_ms": round_dp(_c("hrv_ms"), 1),
        "hrv_baseline_lower_ms": round_dp(_c("hrv_baseline_lower_ms"), 1),
        "hrv_baseline_upper_ms": round_dp(_c("hrv_baseline_upper_ms"), 1),
        **plain("hrv_status sleep_score"),
        "total_sleep_h": round_dp(to_hours(_c("total_sleep_s")), 2),
        "deep_sleep_h": round_dp(to_hours(_c("deep_sleep_s")), 2),
        "rem_sleep_h": round_dp(to_hours(_c("rem_sleep_s")), 2),
        **plain(
            "sleep_score_recovery sleep_score_restfulness sleep_score_feedback stress_avg stress_avg_awake"
            " body_battery_highest body_battery_lowest body_battery_gained_during_sleep"
            " current_resting_hr_bpm resting_hr_7d_avg_bpm avg_waking_respiration_brpm"
            " total_steps active_kcal is_vigorous_day recovery_time_h recovery_time_factor_feedback"
        ),
        "acwr": round_dp(_c("acwr"), 2),
        "acwr_status": _c("acwr_status"),
    }


@dataclass(frozen=True)
class Answer:
    """Aggregates over everything that passed the filters, and the newest rows of it."""

    summary: DataFrame
    rows: DataFrame
    count_name: str
    rows_name: str

    def metrics(self) -> DataFrame:
        """(metric, value) without missing values."""
        return present_metrics(self.summary)

    def as_dict(self) -> dict[str, Any]:
        """Plain values: one summary row and at most ``limit`` result rows."""
        aggregates = {k: v for k, v in self.summary.first().asDict().items() if v is not None and v == v}
        found = [{k: (None if v != v else v) for k, v in r.asDict().items()} for r in self.rows.collect()]
        return {"count": aggregates[self.count_name], "aggregates": aggregates, self.rows_name: found}

    def rows_as_json(self) -> DataFrame:
        """One JSON object per row; missing values are written as null."""
        return self.rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def _projected(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def query_activities(
    activities: DataFrame,
    sport_type: str | None = None,
    start_date: str | date | None = None,
    end_date: str | date | None = None,
    readiness_tier: str | None = None,
    limit: int = 20,
    extra: Sequence[str] = (),
) -> Answer:
    """Activities under optional filters: count, rounded means, newest ``limit`` rows.

    Days at equal date are ordered by activity id.  ``extra`` adds key columns to the rows.
    """
    folded = FOLDED_SPORT in activities.columns
    kept = where_all(activities, activity_conditions(sport_type, start_date, end_date, readiness_tier, folded=folded))
    summary = summarise(kept, "n_activities", activity_means())
    top = newest(kept, "activity_date", limit, [*extra, "activity_id"])
    return Answer(summary, _projected(top, {**{k: _c(k) for k in extra}, **activity_row()}), "n_activities", "activities")


def query_daily_health(
    days: DataFrame,
    start_date: str | date | None = None,
    end_date: str | date | None = None,
    limit: int = 20,
    extra: Sequence[str] = (),
) -> Answer:
    """Days in an optional range; dates given as year-day-month are repaired."""
    start = repair_date_argument(start_date, "start_date")
    end = repair_date_argument(end_date, "end_date")
    day = _c("calendar_date")
    kept = where_all(days, [on_or_after(day, start), on_or_before(day, end)])
    summary = summarise(kept, "n_days", health_means())
    top = newest(kept, "calendar_date", limit, extra)
    return Answer(summary, _projected(top, {**{k: _c(k) for k in extra}, **health_row()}), "n_days", "days")


def newest_activity_day(activities: DataFrame) -> DataFrame:
    return latest_day(activities, "activity_date", FALLBACK_DAY)


# Predictors taken into the modelling extracts, ``column:name``.
EXTRACT_COLUMNS = """
    readiness_score readiness_hrv_weekly_avg_ms:hrv_weekly_avg_ms sleep_score recovery_time_h acwr stress_avg
    weather_temperature_c:temperature_c humidity_fraction:humidity wind_speed_ms
    precipitation_intensity cloud_cover_fraction
"""


def _extract(mart: DataFrame, target: str, keep: Sequence[str], kept: Column) -> DataFrame:
    columns = [_c(raw).alias(name or raw) for raw, _, name in (t.partition(":") for t in EXTRACT_COLUMNS.split())]
    chosen = mart.filter(_c("readiness_score").isNotNull() & _c(target).isNotNull() & kept)
    return chosen.select(*keep, "activity_id", "activity_date", "started_at", target, *columns)


def ride_extract(rides: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rides fit for modelling; an unknown commute flag counts as no commute."""
    fit = (_c("average_watts") > 0) & (_c("distance_km") > 5) & ~F.coalesce(_c("commute"), F.lit(False))
    return _extract(rides, "average_watts", keep, fit)


def run_extract(runs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Runs fit for modelling."""
    gap = _c("gap_min_per_km")
    return _extract(runs, "gap_min_per_km", keep, (gap > 3) & (gap < 12) & (_c("distance_km") > 1))


def in_date_order(extract: DataFrame) -> DataFrame:
    return ascending(extract, "activity_date", "activity_id")
