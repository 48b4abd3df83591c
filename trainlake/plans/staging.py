"""Raw tables -> staged tables: rename, cast, filter, keep the latest per day.

Every function is lazy.  ``keys`` names extra identity columns (such as an
athlete id) that are carried along and take part in every grouping; with no
keys the tables are those of a single athlete.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.casts import convert, epoch_ms, epoch_ms_frac
from ..operators.cogroup import Grouped, Latest, beside
from ..operators.dedupe import latest_per_key, row_fingerprint
from ..operators.filters import not_in_or_null
from ..operators.pivot import any_row, conditional_pivot, pivot_aggregates
from . import contracts as C

DAY = "calendar_date"


def stage(raw: DataFrame, fields: Sequence[C.Field], keys: Sequence[str] = (), computed: Mapping[str, Column] | None = None) -> DataFrame:
    """Cast and rename the contract columns, then add computed ones."""
    types = {f.name: f.dataType for f in raw.schema.fields}
    missing = [f.raw for f in fields if f.raw not in types]
    if missing:
        raise ValueError(f"raw table lacks {missing}")
    cast = [convert(f"`{f.raw}`", types[f.raw], f.kind, f.staged) for f in fields]
    return raw.select(*keys, *cast, *[c.alias(n) for n, c in (computed or {}).items()])


def _int(raw: DataFrame, name: str) -> Column:
    return convert(name, raw.schema[name].dataType, "int")


def _clock(raw: DataFrame, name: str) -> Column:
    return convert(f"`{name}`", raw.schema[name].dataType, "timestamp")


# Columns that ``keep_day`` adds to a raw table.
TYPED_DAY, ROW_HASH = "_day", "_row_hash"


def _text_day(raw: DataFrame) -> Column:
    return F.col(DAY).cast("date")


def _epoch_text_day(raw: DataFrame) -> Column:
    return epoch_ms(F.col("calendar_date_ms" if "calendar_date_ms" in raw.columns else DAY)).cast("date")


# Raw tables of day grain -> their typed day.
DAY_OF = {
    "garmin__daily_summary": _text_day,
    "garmin__sleep": _text_day,
    "garmin__health_status": _text_day,
    "garmin__training_readiness": _text_day,
    "garmin__training_load": _epoch_text_day,
    "garmin__training_status": _text_day,
    "garmin__endurance_score": _epoch_text_day,
    "garmin__hill_score": _epoch_text_day,
    "garmin__run_race_predictions": _text_day,
}


def keep_day(raw: DataFrame, source: str) -> DataFrame:
    """Add the typed day and a fingerprint of the row, so that staged days can be pruned in the files
    and ties broken without reading every column."""
    if source not in DAY_OF or TYPED_DAY in raw.columns:
        return raw
    return raw.withColumns({TYPED_DAY: DAY_OF[source](raw), ROW_HASH: row_fingerprint(raw.columns)})


def _typed(raw: DataFrame, day: Column) -> DataFrame:
    """The raw table with its day as a date, the stored one where there is one."""
    return raw.withColumn(DAY, F.col(TYPED_DAY) if TYPED_DAY in raw.columns else day)


def _assessed_day(raw: DataFrame, day: Column, assessed: Column) -> DataFrame:
    """The raw table with its typed day, its assessment time and a tie-break."""
    tie = F.col(ROW_HASH) if ROW_HASH in raw.columns else row_fingerprint(raw.columns)
    return _typed(raw.withColumns({"_tie": tie, "_assessed": assessed}), day)


def _latest_day(raw: DataFrame, day: Column, assessed: Column, keys: Sequence[str]) -> DataFrame:
    """One row per day by assessment time.

    The day is typed before the window, so the later joins on it reuse the
    window's partitioning.
    """
    typed = _assessed_day(raw, day, assessed)
    return latest_per_key(typed, [*keys, DAY], "_assessed", ["_tie"])


def activity_log(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return stage(raw, C.ACTIVITY_LOG, keys)


def device_activities(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    def ms_to_s(name: str) -> Column:
        return F.col(name).cast("double") / F.lit(1000.0)

    computed = {
        "started_at_utc": epoch_ms(F.col("begin_timestamp")),
        "start_time_utc": epoch_ms_frac(F.col("start_time_gmt")),
        "start_time_local": epoch_ms_frac(F.col("start_time_local")),
        "utc_offset_h": M.utc_offset_h(F.col("start_time_local"), F.col("start_time_gmt")),
        "duration_s": ms_to_s("duration"),
        "moving_duration_s": ms_to_s("moving_duration"),
        "elapsed_duration_s": ms_to_s("elapsed_duration"),
    }
    for zone in range(7):
        computed[f"hr_zone_{zone}_s"] = _int(raw, f"hr_time_in_zone_{zone}").cast("double") / F.lit(1000.0)
    return stage(raw, C.DEVICE_ACTIVITIES, keys, computed)


def daily_summary(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    measured = epoch_ms_frac(F.col("resting_heart_rate_timestamp_ms"))
    return stage(_typed(raw, _text_day(raw)), C.DAILY_SUMMARY, keys, {"resting_hr_measured_at": measured})


def sleep(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    worn = raw.filter(not_in_or_null(F.col("sleep_window_confirmation_type"), ("OFF_WRIST", "UNCONFIRMED")))
    total = M.total_sleep_s(
        _int(raw, "deep_sleep_seconds"), _int(raw, "light_sleep_seconds"), _int(raw, "rem_sleep_seconds")
    )
    return stage(_typed(worn, _text_day(raw)), C.SLEEP, keys, {"total_sleep_s": total})


def _health_picks(field: Callable[[str], Column]) -> dict[str, dict[str, Column]]:
    """Metric -> staged name -> expression; ``field`` finds a column of the metric row."""
    sources = {
        "value": field("value").cast("double"),
        "hi": field("baseline_upper_limit").cast("double"),
        "lo": field("baseline_lower_limit").cast("double"),
        "status": field("status"),
        "percentage": field("percentage").cast("double"),
    }
    return {metric: {alias: sources[name] for name, alias in C.pairs(text).items()} for metric, text in C.HEALTH_METRICS.items()}


def health_status(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long metric rows -> one row per day."""
    known = _typed(raw.filter(F.col("status") != "UNKNOWN"), _text_day(raw))
    extra = [
        any_row(F.col("status") == "ONBOARDING").alias("is_onboarding"),
        F.max(_int(raw, "outliers_count")).alias("outliers_count"),
        F.max(_clock(raw, "create_timestamp_utc")).alias("created_at_utc"),
    ]
    return conditional_pivot(known, [*keys, DAY], "metric_type", _health_picks(F.col), extra)


def training_readiness(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    assessed = _clock(raw, "timestamp")
    latest = _latest_day(raw, _text_day(raw), assessed, keys)
    return stage(latest.filter(F.col("level") != "NONE"), C.TRAINING_READINESS, keys)


def _epoch_day(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest per day for sources whose day and time are epoch milliseconds."""
    time_ms = "timestamp_ms" if "timestamp_ms" in raw.columns else "timestamp"
    return _latest_day(raw, _epoch_text_day(raw), epoch_ms(F.col(time_ms)), keys)


def _epoch_stage(latest: DataFrame, fields: Sequence[C.Field], keys: Sequence[str]) -> DataFrame:
    return stage(latest, fields, [*keys, DAY], {"assessed_at_utc": F.col("_assessed")})


def training_load(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    latest = _epoch_day(raw, keys).filter(F.col("acwr_status") != "NONE")
    return _epoch_stage(latest, C.TRAINING_LOAD, keys)


def training_status(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    assessed = _clock(raw, "timestamp")
    return stage(_latest_day(raw, _text_day(raw), assessed, keys), C.TRAINING_STATUS, keys)


def vo2max(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The full history: several estimates of one day are all kept."""
    return stage(raw, C.VO2MAX, keys)


def endurance_score(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _epoch_stage(_epoch_day(raw, keys), C.ENDURANCE_SCORE, keys)


def hill_score(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _epoch_stage(_epoch_day(raw, keys), C.HILL_SCORE, keys)


def run_race_predictions(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    assessed = _clock(raw, "timestamp")
    latest = _latest_day(raw, _text_day(raw), assessed, keys)
    seconds = {"5k": "race_time5_k", "10k": "race_time10_k", "half": "race_time_half", "marathon": "race_time_marathon"}
    paces = {f"predicted_{race}_pace_min_per_km": M.predicted_pace(F.col(c), race) for race, c in seconds.items()}
    return stage(latest, C.RACE_PREDICTIONS, keys, paces)


# Sources of one assessment a day: contract, and the status whose latest row leaves the day out.
DAY_ASSESSMENTS = {
    "training_load": (C.TRAINING_LOAD, ("acwr_status", "NONE")),
    "training_status": (C.TRAINING_STATUS, None),
    "training_readiness": (C.TRAINING_READINESS, ("level", "NONE")),
}


def day_sides(raw: Callable[[str], DataFrame], taken: Mapping[str, Mapping[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """One row per day with the chosen columns of the day's assessments and health metrics.

    ``taken`` gives for ``health_status`` and each of ``DAY_ASSESSMENTS`` the
    staged columns and their names in the result.  The same rules as the
    staged tables, whose rows it equals, in one grouped aggregate.
    """
    parts: dict[str, Latest | Grouped] = {}
    out: list[Column] = []
    for source, (fields, leaves) in DAY_ASSESSMENTS.items():
        if source not in taken:
            continue
        table = raw(f"garmin__{source}")
        types = {f.name: f.dataType for f in table.schema.fields}
        chosen = [f for f in fields if f.staged in taken[source]]
        columns = dict.fromkeys([*[f.raw for f in chosen], *([leaves[0]] if leaves else [])])
        if source == "training_load":
            time_ms = "timestamp_ms" if "timestamp_ms" in types else "timestamp"
            typed = _assessed_day(table, _epoch_text_day(table), epoch_ms(F.col(time_ms)))
        else:
            typed = _assessed_day(table, _text_day(table), _clock(table, "timestamp"))
        parts[source] = Latest(typed, F.col("_assessed"), F.col("_tie"), list(columns))
        staged = {f.staged: convert(f"{source}.`{f.raw}`", types[f.raw], f.kind) for f in chosen}
        if leaves:
            staged = {n: F.when(F.col(source)[leaves[0]] != leaves[1], value) for n, value in staged.items()}
        out += [staged[n].alias(name) for n, name in taken[source].items()]
    if "health_status" in taken:
        table = raw("garmin__health_status")
        known = _typed(table.filter(F.col("status") != "UNKNOWN"), _text_day(table))

        def aggregates(field: Callable[[str], Column]) -> list[Column]:
            return [any_row(field("status") == "ONBOARDING").alias("is_onboarding"), *pivot_aggregates(field("metric_type"), _health_picks(field))]

        columns = ["metric_type", "value", "baseline_upper_limit", "baseline_lower_limit", "status", "percentage"]
        parts["health_status"] = Grouped(known, columns, aggregates)
        out += [F.col("health_status")[staged].alias(name) for staged, name in taken["health_status"].items()]
    return beside(parts, [*keys, DAY]).select(*keys, DAY, *out)


# Raw table name -> (staged table name, function).
STAGED = {
    "strava__activities": ("stg_strava__activities", activity_log),
    "garmin__activities": ("stg_garmin__activities", device_activities),
    "garmin__daily_summary": ("stg_garmin__daily_summary", daily_summary),
    "garmin__sleep": ("stg_garmin__sleep", sleep),
    "garmin__health_status": ("stg_garmin__health_status", health_status),
    "garmin__training_readiness": ("stg_garmin__training_readiness", training_readiness),
    "garmin__training_load": ("stg_garmin__training_load", training_load),
    "garmin__training_status": ("stg_garmin__training_status", training_status),
    "garmin__vo2max": ("stg_garmin__vo2max", vo2max),
    "garmin__endurance_score": ("stg_garmin__endurance_score", endurance_score),
    "garmin__hill_score": ("stg_garmin__hill_score", hill_score),
    "garmin__run_race_predictions": ("stg_garmin__run_race_predictions", run_race_predictions),
}


def stage_all(raw: Mapping[str, DataFrame], keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Stage every raw table that is present."""
    return {name: fn(raw[source], keys) for source, (name, fn) in STAGED.items() if source in raw}
