"""Day spine and activity marts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.scalars import guarded, to_km, to_kph
from ..operators.match import PROBE, match_table, with_probe
from ..operators.spine import left_join_spine
from ..session import partly_partitioned
from . import contracts as C
from . import staging

DAY = "calendar_date"
SPINE_SOURCES = ("sleep", "training_load", "training_status", "training_readiness", "health_status")


def _take(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    return df.selectExpr(*keys, *[f"{c} AS {n}" for c, n in C.pairs(text).items()])


def days(raw: Callable[[str], DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """One row per daily summary with the day's other sources beside it, from the raw tables.

    The sources that give one row per day are brought beside each other in one
    grouped aggregate; the summaries and the nights, which may repeat a day,
    are joined to it.  Each source is shuffled once, nothing runs while the
    plan is built, and no group is held in memory: a day with very many
    summaries streams past its one row of the other sources.
    """
    on = [*keys, DAY]
    spine = _take(staging.daily_summary(raw("garmin__daily_summary"), keys), C.DAY_SPINE["daily_summary"], on)
    nights = _take(staging.sleep(raw("garmin__sleep"), keys), C.DAY_SPINE["sleep"], on)
    sides = staging.day_sides(raw, {s: C.pairs(C.DAY_SPINE[s]) for s in SPINE_SOURCES if s != "sleep"}, keys)
    return spine.join(nights, on, "left").join(sides, on, "left")


def daily(staged: Mapping[str, DataFrame], keys: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """The same from staged tables, joined one by one.

    With ``hot_rows`` the days are counted while the plan is built, and those
    with more rows are joined apart.
    """
    on = [*keys, DAY]
    spine = _take(staged["stg_garmin__daily_summary"], C.DAY_SPINE["daily_summary"], on)
    sides = [_take(staged[f"stg_garmin__{s}"], C.DAY_SPINE[s], on) for s in SPINE_SOURCES]
    return left_join_spine(spine, sides, on, hot_rows)


def activity(
    log: DataFrame,
    device: DataFrame,
    days: DataFrame,
    keys: Sequence[str] = (),
    max_diff_s: float | None = None,
    hot_rows: int | None = None,
    step: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """One row per logged activity: its best device recording and its day's context.

    No limit applies to the time between the two starts unless ``max_diff_s``
    is given.  With ``hot_rows`` the join keys are counted while the plan is
    built, and those with more rows are joined apart.  ``step`` writes a step
    of the plan and returns it as read back; without it all is one lazy plan.
    """
    step = step or (lambda df, name: df)
    keys = list(keys)
    base = log.select(*keys, *C.pairs(C.ACTIVITY_COLUMNS))
    asking = with_probe(base, "activity_date", "started_at", "activity_type", C.TYPE_FAMILIES)
    asking = asking.select(*keys, "activity_date", *[c for c in asking.columns if c not in (*keys, "activity_date")])
    matches = match_table(
        asking,
        device,
        right_id="activity_id",
        right_time="start_time_local",
        right_type="activity_type",
        families=C.TYPE_FAMILIES,
        payload=C.pairs(C.MATCHED_COLUMNS),
        match_id="garmin_activity_id",
        keys=keys,
        max_diff_s=max_diff_s,
    )
    context = days.select(*keys, F.col(DAY).alias("_day"), *C.pairs(C.DAY_CONTEXT_COLUMNS))
    # Both joins begin with the day, so that a partitioning by it can serve both.
    # If counted, hot keys are counted on the log itself, which is only a narrow scan.
    joined = left_join_spine(asking, [step(context, "days")], [*keys, "_day"], hot_rows)
    joined = left_join_spine(joined, [step(matches, "matches")], [*keys, *PROBE], hot_rows, measure=asking)
    with partly_partitioned(log.sparkSession):
        joined = step(joined, "joined")
    return joined.withColumns(
        {
            "late_start_utc_risk": M.starts_late(F.col("started_at")),
            "garmin_activity_matched": F.col("garmin_activity_id").isNotNull(),
            "garmin_match_type_compatible": F.coalesce(F.col("type_mismatch") == 0, F.lit(False)),
            "garmin_match_start_diff_s": F.col("start_diff_s"),
            "distance_km": to_km(F.col("distance_m")),
            "average_speed_kph": to_kph(F.col("average_speed_ms")),
        }
    ).drop("date_diff_days", "type_mismatch", "start_diff_s", *PROBE)


def _gated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank device columns whose recording is of another type."""
    ok = F.col("garmin_match_type_compatible")
    return df.withColumns({c: guarded(ok, F.col(c)) for c in columns if c in df.columns})


def _sport_mart(activities: DataFrame, types: Sequence[str], derived: Mapping[str, Column], drops: str) -> DataFrame:
    chosen = activities.filter(F.col("activity_type").isin(*types))
    gated = _gated(chosen, list(C.pairs(C.MATCHED_COLUMNS).values()))
    return gated.withColumns(dict(derived)).drop(*drops.split())


def ride(activities: DataFrame) -> DataFrame:
    derived = {
        "average_speed_mph": M.kph_to_mph(F.col("average_speed_kph")),
        "max_speed_kph": to_kph(F.col("max_speed_ms")),
        "average_wkg": M.watts_per_kg(F.col("average_watts"), F.col("athlete_weight_kg")),
        "weighted_average_wkg": M.watts_per_kg(F.col("weighted_average_power_w"), F.col("athlete_weight_kg")),
        "watts_per_bpm": M.watts_per_bpm(F.col("average_watts"), F.col("average_heart_rate_bpm")),
    }
    return _sport_mart(activities, C.RIDE_TYPES, derived, C.RIDE_DROPS)


def run(activities: DataFrame) -> DataFrame:
    moving, km = F.col("moving_time_s"), F.col("distance_km")
    derived = {
        "grade_adjusted_distance_km": to_km(F.col("grade_adjusted_distance_m")),
        "pace_min_per_km": M.pace_min_per_km(moving, km),
        "pace_min_per_mile": M.pace_min_per_mile(moving, km),
        "gap_min_per_km": M.graded_pace_min_per_km(moving, F.col("grade_adjusted_distance_m")),
        "max_speed_kph": to_kph(F.col("max_speed_ms")),
        "pace_per_bpm": M.pace_per_bpm(moving, km, F.col("average_heart_rate_bpm")),
    }
    return _sport_mart(activities, C.RUN_TYPES, derived, C.RUN_DROPS)
