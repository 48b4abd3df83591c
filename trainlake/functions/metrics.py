"""Derived training metrics (plain Column expressions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import guarded, round_dp, to_km, to_minutes

KM_PER_MILE = 1.60934
# Race lengths in km by the name used in the prediction columns.
RACE_KM = {"5k": 5.0, "10k": 10.0, "half": 21.0975, "marathon": 42.195}


def total_sleep_s(deep: Column, light: Column, rem: Column) -> Column:
    """Time asleep; only a missing REM phase counts as zero."""
    return deep + light + F.coalesce(rem, F.lit(0))


def kph_to_mph(kph: Column) -> Column:
    return kph / F.lit(KM_PER_MILE)


def watts_per_kg(watts: Column, weight_kg: Column) -> Column:
    return guarded(weight_kg > 0, watts / weight_kg)


def watts_per_bpm(watts: Column, bpm: Column) -> Column:
    return guarded((bpm > 0) & (watts > 0), watts / bpm)


def pace_min_per_km(moving_s: Column, km: Column) -> Column:
    return guarded(km > 0, to_minutes(moving_s) / km)


def pace_min_per_mile(moving_s: Column, km: Column) -> Column:
    return guarded(km > 0, to_minutes(moving_s) / (km / F.lit(KM_PER_MILE)))


def graded_pace_min_per_km(moving_s: Column, graded_m: Column) -> Column:
    return guarded(graded_m > 0, to_minutes(moving_s) / to_km(graded_m))


def pace_per_bpm(moving_s: Column, km: Column, bpm: Column) -> Column:
    return guarded((bpm > 0) & (km > 0), to_minutes(moving_s) / km / bpm)


def predicted_pace(race_s: Column, race: str) -> Column:
    return round_dp(to_minutes(race_s.cast("double")) / F.lit(RACE_KM[race]), 2)


def utc_offset_h(local_ms: Column, gmt_ms: Column) -> Column:
    return (local_ms.cast("double") - gmt_ms.cast("double")) / F.lit(3600000.0)


def starts_late(started_at: Column) -> Column:
    """Starts at or after 22:00, when the UTC date may differ from the local one."""
    return F.hour(started_at) >= 22


def speed_from_pace(pace: Column) -> Column:
    """Turn a pace into a target where higher means faster."""
    return -pace
