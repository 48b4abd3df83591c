"""Nested export records -> flat raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import convert, nan_to_null
from ..functions.names import snake_columns
from ..session import case_sensitive
from . import schemas as S


def _whole(name: str) -> Column:
    return convert(name, T.StringType(), "bigint")


def profile_key(df: DataFrame) -> Column:
    """The profile key under whichever of its spellings is filled."""
    names = [f.name for f in df.schema.fields]
    return F.coalesce(*[_whole(k) for k in S.PROFILE_KEYS if k in names])


def _case_sensitive_select(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    with case_sensitive(df.sparkSession):
        return df.select(*columns)


def scalars(fields: Sequence[tuple[str, str]]) -> list[Column]:
    """Scalar file fields under their raw names."""
    return [
        (_whole(f"`{S.wire_name(n)}`") if t == "bigint" else F.col(f"`{S.wire_name(n)}`")).alias(n) for n, t in fields
    ]


def drop_nested(df: DataFrame) -> DataFrame:
    """Drop columns that hold lists or objects (judged by type, no data pass)."""
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    return df.drop(*[f.name for f in df.schema.fields if isinstance(f.dataType, nested)])


def unwrap(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per element of an array of objects; records without it give none."""
    return df.select(*keep, F.inline(column))


def last_where(items: str | Column, field: str, key: str, value) -> Column:
    """``field`` of the last element whose ``key`` equals ``value``; NULL when none does."""
    array = F.col(items) if isinstance(items, str) else items
    hits = F.filter(array, lambda x: x[key] == F.lit(value))
    return F.try_element_at(hits, F.lit(-1))[field]


def fields_of(struct: str, fields: Mapping[str, str]) -> list[Column]:
    """Scalar columns from a structure; NULL throughout when it is missing."""
    return [F.col(f"{struct}.{field}").alias(name) for name, field in fields.items()]


def flat_records(df: DataFrame) -> DataFrame:
    """Flat records with inferred columns: snake_case names, nested columns dropped, NaN as NULL."""
    return nan_to_null(drop_nested(snake_columns(df)))


def flat_table(df: DataFrame, table: str, keep: Sequence[str] = (), extra: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """One of the flat sources under its declared columns, and the ``extra`` (field, column, type) ones."""
    columns = [*[F.col(k) for k in keep], profile_key(df).alias("user_profile_pk"), *scalars(S.FLAT_SOURCES[table])]
    return nan_to_null(_case_sensitive_select(df, [*columns, *_extra(extra)]))


def device_activities(df: DataFrame, keep: Sequence[str] = (), extra: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    with case_sensitive(df.sparkSession):
        records = drop_nested(unwrap(df, S.ACTIVITY_ENVELOPE, keep))
    return nan_to_null(_case_sensitive_select(records, [*[F.col(k) for k in keep], *scalars(S.DEVICE_ACTIVITY_FIELDS), *_extra(extra)]))


def _extra(fields: Sequence[tuple[str, str, str]]) -> list[Column]:
    return [F.col(f"`{name}`").alias(column) for name, column, _ in fields]


def health_status(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per metric of a day; days without metrics give none."""
    base = [*keep, *scalars([("calendar_date", "string"), ("create_timestamp_utc", "string"), ("update_timestamp_utc", "string"), ("outliers_count", "double")])]
    long = df.select(*base, F.explode("metrics").alias("_m"))
    metric = snake_columns(long.select("_m.*")).columns
    renamed = [
        F.col(f"_m.{f}").alias("metric_type" if n == "type" else n) for f, n in zip(long.select("_m.*").columns, metric)
    ]
    return long.select(*[c for c in long.columns if c != "_m"], *renamed)


def sleep(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *scalars(S.SLEEP_SCALARS), *fields_of("sleepScores", S.SLEEP_SCORES))


def daily_summary(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    stress = [
        last_where("allDayStress.aggregatorList", field, "type", kind).alias(name)
        for kind, fields in S.STRESS_FIELDS.items()
        for name, field in fields.items()
    ]
    battery = [
        last_where("bodyBattery.bodyBatteryStatList", "statsValue", "bodyBatteryStatType", kind).alias(name)
        for name, kind in S.BATTERY_STATS.items()
    ]
    columns = [
        *[F.col(k) for k in keep],
        profile_key(df).alias("user_profile_pk"),
        *scalars(S.DAILY_SCALARS),
        *stress,
        *fields_of("bodyBattery", S.BATTERY_FIELDS),
        *battery,
        *fields_of("respiration", S.RESPIRATION_FIELDS),
        *fields_of("hydration", S.HYDRATION_FIELDS),
    ]
    return _case_sensitive_select(df, columns)


def endurance_score(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    shares = [
        last_where("enduranceScoreContributor", "contribution", "group", group).alias(name)
        for name, group in S.ENDURANCE_GROUPS.items()
    ]
    columns = [
        *[F.col(k) for k in keep],
        profile_key(df).alias("user_profile_pk"),
        _whole("calendarDate").alias("calendar_date_ms"),
        _whole("timestamp").alias("timestamp_ms"),
        _whole("deviceId").alias("device_id"),
        F.col("overallScore").alias("overall_score"),
        F.col("classification"),
        F.col("feedbackPhrase").alias("feedback_phrase"),
        F.col("primaryTrainingDevice").alias("primary_training_device"),
        *shares,
    ]
    return _case_sensitive_select(df, columns)


# Raw table -> (schema of its files, flattener).
NESTED_SOURCES = {
    "garmin__health_status": (S.HEALTH_DDL, health_status),
    "garmin__sleep": (S.SLEEP_DDL, sleep),
    "garmin__daily_summary": (S.DAILY_DDL, daily_summary),
    "garmin__activities": (S.ACTIVITIES_DDL, device_activities),
    "garmin__endurance_score": (S.ENDURANCE_DDL, endurance_score),
}
