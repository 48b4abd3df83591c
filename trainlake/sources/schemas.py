"""Schemas of the export files as written by the device vendor.

Measures are read as DOUBLE because one export writes ``35`` and another
``35.0``; identifiers and epoch values are read as text and made integers
without passing through floating point.
"""

from __future__ import annotations

import re

from ..plans import contracts as C

# Where each table's files lie below the export folder.
FILE_PATTERNS = {
    "garmin__health_status": "DI-Connect-Wellness/*_healthStatusData.json",
    "garmin__sleep": "DI-Connect-Wellness/*_sleepData.json",
    "garmin__daily_summary": "DI-Connect-Aggregator/UDSFile_*.json",
    "garmin__activities": "DI-Connect-Fitness/*_summarizedActivities.json",
    "garmin__training_readiness": "DI-Connect-Metrics/TrainingReadinessDTO_*.json",
    "garmin__training_load": "DI-Connect-Metrics/MetricsAcuteTrainingLoad_*.json",
    "garmin__training_status": "DI-Connect-Metrics/TrainingHistory_*.json",
    "garmin__vo2max": "DI-Connect-Metrics/MetricsMaxMetData_*.json",
    "garmin__endurance_score": "DI-Connect-Metrics/EnduranceScore_*.json",
    "garmin__hill_score": "DI-Connect-Metrics/HillScore_*.json",
    "garmin__run_race_predictions": "DI-Connect-Metrics/RunRacePredictions_*.json",
}
ACTIVITY_CSV = "activities.csv"

# Names whose spelling in the files does not follow the rule of ``wire_name``.
IRREGULAR = {
    "sleep_start_timestamp_gmt": "sleepStartTimestampGMT",
    "sleep_end_timestamp_gmt": "sleepEndTimestampGMT",
    "resting_heart_rate_timestamp_ms": "restingHeartRateTimestamp",
    "create_timestamp_utc": "createTimestampUTC",
    "update_timestamp_utc": "updateTimestampUTC",
    "latest_respiration_time_gmt": "latestRespirationTimeGMT",
}
# The profile key is spelled in two ways.
PROFILE_KEYS = ("userProfilePK", "userProfilePk")


def wire_name(raw: str) -> str:
    """``recovery_time`` -> ``recoveryTime``; an underscore before digits stays."""
    if raw in IRREGULAR:
        return IRREGULAR[raw]
    return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), raw)


def flat_fields(fields: tuple[C.Field, ...], epoch: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(raw name, raw type) of a flat source; ``epoch`` names epoch-millisecond columns."""
    kinds = {"int": "double", "double": "double", "bigint": "bigint", "boolean": "boolean"}
    named = [(f.raw, kinds.get(f.kind, "string")) for f in fields if f.raw != "user_profile_pk"]
    return named + [(n, "bigint") for n in epoch]


FLAT_SOURCES = {
    "garmin__training_readiness": flat_fields(C.TRAINING_READINESS),
    "garmin__training_load": flat_fields(C.TRAINING_LOAD, ("calendar_date", "timestamp")),
    "garmin__training_status": flat_fields(C.TRAINING_STATUS),
    "garmin__vo2max": flat_fields(C.VO2MAX),
    "garmin__hill_score": flat_fields(C.HILL_SCORE, ("calendar_date", "timestamp")),
    "garmin__run_race_predictions": flat_fields(C.RACE_PREDICTIONS),
}

DEVICE_ACTIVITY_FIELDS = flat_fields(C.DEVICE_ACTIVITIES, ("begin_timestamp",)) + [
    (n, "double")
    for n in (
        "start_time_gmt", "start_time_local", "duration", "moving_duration", "elapsed_duration",
        *[f"hr_time_in_zone_{z}" for z in range(7)],
    )
]

# Scalar fields of the daily summary that staging does not read.
DAILY_EXTRA = ("wellness_kilocalories", "resting_calories_from_activity")
# Raw column -> field, for the nested parts of the daily summary.
STRESS_FIELDS = {
    "TOTAL": {
        "stress_avg_total": "averageStressLevel",
        "stress_max_total": "maxStressLevel",
        "stress_duration_total_s": "stressDuration",
        "stress_rest_duration_total_s": "restDuration",
    },
    "AWAKE": {"stress_avg_awake": "averageStressLevel"},
}
BATTERY_FIELDS = {"body_battery_charged": "chargedValue", "body_battery_drained": "drainedValue"}
BATTERY_STATS = {
    "body_battery_highest": "HIGHEST",
    "body_battery_lowest": "LOWEST",
    "body_battery_start_of_day": "STARTOFDAY",
    "body_battery_end_of_day": "ENDOFDAY",
    "body_battery_sleep_start": "SLEEPSTART",
    "body_battery_sleep_end": "SLEEPEND",
    "body_battery_during_sleep": "DURINGSLEEP",
}
RESPIRATION_FIELDS = {
    "avg_waking_respiration": "avgWakingRespirationValue",
    "highest_respiration": "highestRespirationValue",
    "lowest_respiration": "lowestRespirationValue",
    "latest_respiration": "latestRespirationValue",
    "latest_respiration_time_gmt": "latestRespirationTimeGMT",
}
HYDRATION_FIELDS = {
    "hydration_value_ml": "valueInML",
    "hydration_goal_ml": "goalInML",
    "hydration_sweat_loss_ml": "sweatLossInML",
    "hydration_adjusted_goal_ml": "adjustedGoalInML",
}
# Raw column -> field of the sleep score structure.
SLEEP_SCORES = {
    "sleep_score_overall": "overallScore",
    "sleep_score_quality": "qualityScore",
    "sleep_score_duration": "durationScore",
    "sleep_score_recovery": "recoveryScore",
    "sleep_score_deep": "deepScore",
    "sleep_score_rem": "remScore",
    "sleep_score_light": "lightScore",
    "sleep_score_awakenings_count": "awakeningsCountScore",
    "sleep_score_awake_time": "awakeTimeScore",
    "sleep_score_combined_awake": "combinedAwakeScore",
    "sleep_score_restfulness": "restfulnessScore",
    "sleep_score_interruptions": "interruptionsScore",
    "sleep_score_feedback": "feedback",
    "sleep_score_insight": "insight",
}
# Contributor group number of each endurance column.
ENDURANCE_GROUPS = {
    "cycling_contribution": 0,
    "running_contribution": 1,
    "hiking_walking_contribution": 3,
    "other_aerobic_contribution": 8,
}

_NESTED_DAILY = {
    *STRESS_FIELDS["TOTAL"], *STRESS_FIELDS["AWAKE"], *BATTERY_FIELDS, *BATTERY_STATS, *RESPIRATION_FIELDS, *HYDRATION_FIELDS,
}
DAILY_SCALARS = [f for f in flat_fields(C.DAILY_SUMMARY) if f[0] not in _NESTED_DAILY] + [
    ("resting_heart_rate_timestamp_ms", "bigint"),
    *[(n, "double") for n in DAILY_EXTRA],
]
SLEEP_SCALARS = [f for f in flat_fields(C.SLEEP) if f[0] not in SLEEP_SCORES]


def wire_ddl(fields: list[tuple[str, str]]) -> str:
    """DDL of the listed columns as they appear in a file."""
    return ", ".join(f"`{wire_name(n)}` {'STRING' if t == 'bigint' else t.upper()}" for n, t in fields)


def _struct(fields: dict[str, str], texts: tuple[str, ...] = ()) -> str:
    return ", ".join(f"{f}: {'STRING' if f in texts else 'DOUBLE'}" for f in fields.values())


_PROFILE = ", ".join(f"{k} STRING" for k in PROFILE_KEYS)
_STRESS_ITEM = "type: STRING, averageStressLevel: DOUBLE, maxStressLevel: DOUBLE, stressDuration: DOUBLE, restDuration: DOUBLE"

HEALTH_DDL = (
    "calendarDate STRING, createTimestampUTC STRING, updateTimestampUTC STRING, outliersCount DOUBLE,"
    " metrics ARRAY<STRUCT<type: STRING, value: DOUBLE, baselineUpperLimit: DOUBLE, baselineLowerLimit: DOUBLE,"
    " status: STRING, percentage: DOUBLE, feedbackKey: STRING>>"
)
SLEEP_DDL = f"{wire_ddl(SLEEP_SCALARS)}, sleepScores STRUCT<{_struct(SLEEP_SCORES, ('feedback', 'insight'))}>"
DAILY_DDL = (
    f"{_PROFILE}, {wire_ddl(DAILY_SCALARS)},"
    f" allDayStress STRUCT<aggregatorList: ARRAY<STRUCT<{_STRESS_ITEM}>>>,"
    " bodyBattery STRUCT<chargedValue: DOUBLE, drainedValue: DOUBLE,"
    " bodyBatteryStatList: ARRAY<STRUCT<bodyBatteryStatType: STRING, statsValue: DOUBLE>>>,"
    f" respiration STRUCT<{_struct(RESPIRATION_FIELDS, ('latestRespirationTimeGMT',))}>,"
    f" hydration STRUCT<{_struct(HYDRATION_FIELDS)}>"
)
# The list that holds the device recordings of a record.
ACTIVITY_ENVELOPE = "summarizedActivitiesExport"
ACTIVITIES_DDL = (
    f"{ACTIVITY_ENVELOPE} ARRAY<STRUCT<"
    + ", ".join(f"`{wire_name(n)}`: {'STRING' if t == 'bigint' else t.upper()}" for n, t in DEVICE_ACTIVITY_FIELDS)
    + ">>"
)
ENDURANCE_DDL = (
    f"{_PROFILE}, calendarDate STRING, timestamp STRING, deviceId STRING, overallScore DOUBLE, classification DOUBLE,"
    " feedbackPhrase DOUBLE, primaryTrainingDevice BOOLEAN,"
    " enduranceScoreContributor ARRAY<STRUCT<`group`: INT, contribution: DOUBLE, sport: STRING, subSport: STRING>>"
)


def flat_ddl(table: str) -> str:
    return f"{_PROFILE}, {wire_ddl(FLAT_SOURCES[table])}"
