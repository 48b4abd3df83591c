"""Predictors of the performance study."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import speed_from_pace
from ..functions.scalars import dummy, weather_category
from ..operators.filters import complete_cases

# Predictor sets of the three nested models.
RAW_COMPONENTS = ("hrv_weekly_avg_ms", "sleep_score", "recovery_time_h", "acwr", "stress_avg")
CONTEXT = ("temperature_c", "humidity", "wind_speed_ms", "hour_of_day")
MODELS: dict[str, tuple[str, ...]] = {
    "A — readiness only": ("readiness_score",),
    "B — readiness + context": ("readiness_score", *CONTEXT),
    "C — raw components + context": (*RAW_COMPONENTS, *CONTEXT),
}
# Weather levels, alphabetical; the first one present is the ridge reference level.
WEATHER_LEVELS = ("clear", "overcast", "rainy")
# Targets by sport.
TARGETS = {"ride": "average_watts", "run": "gap_speed"}


def engineer(extract: DataFrame) -> DataFrame:
    """Add hour of day, weather category and, for runs, a target where higher is faster."""
    df = extract.withColumns(
        {
            "hour_of_day": F.hour("started_at"),
            "weather_category": weather_category(F.col("precipitation_intensity"), F.col("cloud_cover_fraction")),
        }
    )
    if "gap_min_per_km" in df.columns:
        df = df.withColumn("gap_speed", speed_from_pace(F.col("gap_min_per_km")))
    return df


def uses_weather(predictors: Sequence[str]) -> bool:
    return "temperature_c" in predictors


def weather_columns(levels: Sequence[str]) -> tuple[str, ...]:
    return tuple(f"w_{level}" for level in levels)


def design(df: DataFrame, predictors: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    """Complete cases as doubles, with one dummy per weather level where weather is used."""
    weather = uses_weather(predictors)
    needed = [*predictors, *(["weather_category"] if weather else []), target]
    rows = complete_cases(df, needed)
    dummies = [dummy(F.col("weather_category"), w).alias(f"w_{w}") for w in WEATHER_LEVELS] if weather else []
    return rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in [*predictors, target]], *dummies)
