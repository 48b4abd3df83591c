"""Queries over the staged tables, the marts and the export readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.operators.summary import day_span, null_counts
from trainlake.plans import build, marts, queries, series, staging
from trainlake.session import scratch_path
from trainlake.sources import flatten, readers, schemas, tables
from trainlake.stats import features, report

from . import export_files as files
from .inputs import ATHLETE, RAW_SQL, spark_raw
from .models_sql import as_text, model_sql, with_models
from .registry import query, times_as_text

# --- staged tables -----------------------------------------------------------

STAGED_QUERIES = {
    "p1_activity_log": "strava__activities",
    "p2_e3_m11_device_activities": "garmin__activities",
    "p3_daily_summary": "garmin__daily_summary",
    "p4_f1_m1_sleep": "garmin__sleep",
    "p5_a1_a2_a3_f2_health_pivot": "garmin__health_status",
    "p6_w1_f3_training_readiness": "garmin__training_readiness",
    "p7_w1_f4_training_load": "garmin__training_load",
    "p8_w1_training_status": "garmin__training_status",
    "p9_vo2max": "garmin__vo2max",
    "p10_w1_endurance_score": "garmin__endurance_score",
    "p11_w1_hill_score": "garmin__hill_score",
    "p12_w1_m8_race_predictions": "garmin__run_race_predictions",
}


def _register_staged(name: str, source: str) -> None:
    model, stage = staging.STAGED[source]

    @query(name, model_sql(model))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return times_as_text(stage(spark_raw(spark, sf_dir, source)[source], ATHLETE))


for _name, _source in STAGED_QUERIES.items():
    _register_staged(_name, _source)


# --- export files, read back through the readers and staged -----------------

EXPORT_QUERIES = {
    "s5_s3_s10_readiness_files": ("garmin__training_readiness", None),
    "s5_training_load_files": ("garmin__training_load", None),
    "s5_training_status_files": ("garmin__training_status", None),
    "s5_vo2max_files": ("garmin__vo2max", None),
    "s5_hill_score_files": ("garmin__hill_score", None),
    "s5_race_prediction_files": ("garmin__run_race_predictions", None),
    "s6_s7_device_activity_files": ("garmin__activities", files.activities),
    "s8_health_status_files": ("garmin__health_status", files.health),
    "s9_sleep_files": ("garmin__sleep", files.sleep),
    "s11_s12_s14_daily_summary_files": ("garmin__daily_summary", files.daily),
    "s13_s15_endurance_files": ("garmin__endurance_score", files.endurance),
}


def _register_export(name: str, source: str, write) -> None:
    model, stage = staging.STAGED[source]

    @query(name, model_sql(model))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = spark_raw(spark, sf_dir, source)[source]
        path = write(raw) if write else files.flat(raw, source)
        nested = flatten.NESTED_SOURCES.get(source)
        ddl = f"{nested[0] if nested else schemas.flat_ddl(source)}, athlete_id BIGINT"
        records = readers.read_json(spark, path, ddl, multi_line=False)
        flat = nested[1](records, ATHLETE) if nested else flatten.flat_table(records, source, ATHLETE)
        stored = build.write_raw(spark, {source: flat}, scratch_path(spark, "raw"))
        return times_as_text(stage(stored[source], ATHLETE))


for _name, (_source, _write) in EXPORT_QUERIES.items():
    _register_export(_name, _source, _write)


@query(
    "s2_s4_activity_csv",
    with_models(
        """SELECT * REPLACE (CAST(date_trunc('second', started_at) AS VARCHAR) AS started_at,
        CAST(activity_date AS VARCHAR) AS activity_date) FROM stg_strava__activities""",
        "stg_strava__activities",
    ),
)
def activity_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with repeated headers and human-written times, staged."""
    path = files.activity_csv(spark, spark_raw(spark, sf_dir, "strava__activities")["strava__activities"])
    raw = readers.read_activity_csv(spark, path).withColumn("athlete_id", F.col("athlete_id").cast("bigint"))
    return times_as_text(staging.activity_log(raw, ATHLETE))


@query("s1_s5_s7_whole_document_files", model_sql("stg_garmin__training_readiness"))
def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many files of one array each, read as whole documents by ingest; nested fields go."""
    source = "garmin__training_readiness"
    path = files.whole_documents(spark_raw(spark, sf_dir, source)[source], source, 16)
    # Documents above SPLIT_OVER bytes are read by several tasks, cut at the array's commas.
    records = readers.read_json(spark, path, f"{schemas.flat_ddl(source)}, athlete_id BIGINT", multi_line=True, split_over=readers.SPLIT_OVER)
    stored = build.write_raw(spark, {source: flatten.flat_table(records, source, ATHLETE)}, scratch_path(spark, "raw"))
    return times_as_text(staging.STAGED[source][1](stored[source], ATHLETE))


@query("s1_split_documents", model_sql("stg_garmin__training_readiness"))
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one array each, cut at the array's commas by byte ranges; texts hold brackets, quotes and backslashes."""
    source = "garmin__training_readiness"
    path = files.newer_documents(spark_raw(spark, sf_dir, source)[source], source, 4)
    raw = build.read_source(spark, source, path, ATHLETE, all_fields=False, split_over=0, key_types="athlete_id BIGINT")
    stored = build.write_raw(spark, {source: raw}, scratch_path(spark, "raw"))
    return times_as_text(staging.STAGED[source][1](stored[source], ATHLETE))


def _newer_sql(number: str) -> str:
    """Fields that only a newer export has, under the names and types they are landed with."""
    return f"""CAST({number} % 1000 AS BIGINT) AS extra_whole, {number} / 4 AS extra_share, '}}],[{{"x": "\\' || {number} AS extra_note, {number} % 2 = 0 AS extra_flag,
        CASE WHEN {number} % 2 = 0 THEN CAST({number} % 7 AS VARCHAR) ELSE 'seven' END AS extra_mixed"""


@query("s5_s7_every_flat_field", with_models(f"SELECT athlete_id, device_id, level, {_newer_sql('(device_id // 1000)')} FROM garmin__training_readiness", "garmin__training_readiness"))
def every_flat_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat fields that are not declared are found and landed typed, nested ones are dropped."""
    source = "garmin__training_readiness"
    path = files.newer_documents(spark_raw(spark, sf_dir, source)[source], source, 16)
    raw = build.read_source(spark, source, path, ATHLETE, key_types="athlete_id BIGINT")
    stored = build.write_raw(spark, {source: raw}, scratch_path(spark, "raw"))[source]
    landed = [c for c in stored.columns if c.startswith("extra_")]
    return stored.select(*ATHLETE, "device_id", "level", *landed)


@query("s6_s7_every_activity_field", with_models(f"SELECT athlete_id, activity_id, activity_type, {_newer_sql('activity_id')} FROM garmin__activities", "garmin__activities"))
def every_activity_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same inside the envelopes of the device recordings."""
    source = "garmin__activities"
    path = files.newer_activities(spark_raw(spark, sf_dir, source)[source])
    raw = build.read_source(spark, source, path, ATHLETE, multi_line=False, key_types="athlete_id BIGINT")
    stored = build.write_raw(spark, {source: raw}, scratch_path(spark, "raw"))[source]
    landed = [c for c in stored.columns if c.startswith("extra_")]
    return stored.select(*ATHLETE, "activity_id", "activity_type", *landed)


# The activities whose file has no such column show NULL; which file is decided by Spark's hash.
@query("s2_activity_csv_header_orders", with_models(
    """SELECT athlete_id, activity_id, activity_name, activity_type, distance_m, moving_time_s, elevation_gain_m, average_heart_rate_bpm,
       CAST(date_trunc('second', started_at) AS VARCHAR) AS started_at FROM stg_strava__activities""", "stg_strava__activities"))
def csv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three headers, each read under its own."""
    path = files.activity_csv_orders(spark, spark_raw(spark, sf_dir, "strava__activities")["strava__activities"])
    raw = readers.read_activity_csv(spark, path).withColumn("athlete_id", F.col("athlete_id").cast("bigint"))
    staged = staging.activity_log(raw, ATHLETE)
    columns = ("activity_id", "activity_name", "activity_type", "distance_m", "moving_time_s", "elevation_gain_m", "average_heart_rate_bpm", "started_at")
    return times_as_text(staged.select(*ATHLETE, *columns))


# --- marts -------------------------------------------------------------------


SPINE_RAW = tuple(
    f"garmin__{n}" for n in ("daily_summary", "sleep", "training_load", "training_status", "training_readiness", "health_status")
)


def _lazy(spark: SparkSession, sf_dir: str) -> build.Lake:
    return build.lazy_lake(spark_raw(spark, sf_dir, "strava__activities", "garmin__activities", *SPINE_RAW), ATHLETE)


@query("p15_j1_day_spine_mart", model_sql("int_garmin__daily"))
def day_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's sources beside each other in one grouped aggregate."""
    return times_as_text(marts.days(spark_raw(spark, sf_dir, *SPINE_RAW).__getitem__, ATHLETE))


@query("p15_j1_day_spine_from_staged_tables", model_sql("int_garmin__daily"))
def day_spine_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table, the staged sources joined one by one."""
    return times_as_text(marts.daily(staging.stage_all(spark_raw(spark, sf_dir, *SPINE_RAW), ATHLETE), ATHLETE))


@query("p16_j2_j3_j4_j5_w2_e8_m2_m10_activity_mart", model_sql("fct_activity"))
def activity_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(_lazy(spark, sf_dir).activity)


@query("p13_f5_m3_m4_m5_m7_m9_ride_mart", model_sql("fct_ride"))
def ride_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(_lazy(spark, sf_dir).ride)


@query("p14_m6_m9_run_mart", model_sql("fct_run"))
def run_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(_lazy(spark, sf_dir).run)


# --- the written lake and the questions asked of it --------------------------


_WRITTEN: dict[tuple[str, str], str] = {}


def _lake_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the lake of this folder is; written once per session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _WRITTEN:
        path = scratch_path(spark, "lake")
        build.build(spark, spark_raw(spark, sf_dir), path, ATHLETE)
        _WRITTEN[at] = path
    return _WRITTEN[at]


def _lake(spark: SparkSession, sf_dir: str) -> build.Lake:
    return build.open_lake(spark, _lake_path(spark, sf_dir), ATHLETE)


_MARTS = ("fct_activity", "fct_ride", "fct_run")


@query(
    "k1_k2_k3_s16_lake_row_counts",
    with_models(
        " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in [*RAW_SQL, *_MARTS]),
        *RAW_SQL, *_MARTS,
    ),
)
def lake_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lake_path(spark, sf_dir)
    found = tables.read_tables(spark, path, "raw", list(RAW_SQL)) | tables.read_tables(spark, path, "marts", _MARTS)
    return tables.count_tables(found)


_Q1_WHERE = "lower(activity_type) = 'ride' AND activity_date >= DATE '2024-01-05' AND activity_date <= DATE '2024-01-25'"
_Q1_MEANS = """count(*) AS n_activities, round(avg(distance_km), 2) AS avg_distance_km,
    round(avg(moving_time_s) / 60, 1) AS avg_moving_time_min, round(avg(average_heart_rate_bpm), 1) AS avg_hr_bpm,
    round(avg(relative_effort), 1) AS avg_strava_relative_effort,
    round(avg(activity_training_load), 1) AS avg_garmin_training_load, round(avg(readiness_score), 1) AS avg_readiness_score"""


def _q1(spark: SparkSession, sf_dir: str, **filters) -> queries.Answer:
    return queries.query_activities(_lake(spark, sf_dir).activity, extra=ATHLETE, **filters)


@query(
    "q1_a4_a5_f6_f7_activities_summary",
    with_models(f"SELECT {_Q1_MEANS} FROM fct_activity WHERE {_Q1_WHERE}", "fct_activity"),
)
def q1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q1(spark, sf_dir, sport_type="RIDE", start_date="2024-01-05", end_date="2024-01-25").summary


@query(
    "q1_f8_a7_activities_metrics_by_tier",
    with_models(
        f"""SELECT metric, value FROM (SELECT * REPLACE (CAST(n_activities AS DOUBLE) AS n_activities)
            FROM (SELECT {_Q1_MEANS} FROM fct_activity WHERE upper(readiness_level) = 'HIGH'))
            UNPIVOT (value FOR metric IN (n_activities, avg_distance_km, avg_moving_time_min, avg_hr_bpm,
            avg_strava_relative_effort, avg_garmin_training_load, avg_readiness_score))""",
        "fct_activity",
    ),
)
def q1_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q1(spark, sf_dir, sport_type="all", readiness_tier="high").metrics()


@query(
    "q1_t1_e13_e15_e16_newest_activities",
    with_models(
        f"""SELECT athlete_id, CAST(activity_date AS VARCHAR) AS date, activity_type AS sport, activity_name AS name,
        round(distance_km, 2) AS distance_km, round(moving_time_s / 60, 1) AS moving_time_min,
        round(average_speed_kph, 1) AS avg_speed_kph, round(elevation_gain_m, 0) AS elevation_gain_m,
        average_heart_rate_bpm AS avg_hr, max_heart_rate_bpm AS max_hr, average_watts,
        round(aerobic_training_effect, 1) AS aerobic_training_effect, round(anaerobic_training_effect, 1) AS anaerobic_training_effect,
        training_effect_label, activity_training_load, relative_effort, round(hr_zone_2_s / 60, 1) AS zone_2_aerobic_min,
        round(hr_zone_5_s / 60, 1) AS zone_5_anaerobic_min, readiness_score, readiness_level,
        recovery_time_h AS residual_recovery_needed_h, round(weather_temperature_c, 1) AS temperature_c,
        round(apparent_temperature_c, 1) AS feels_like_c, round(humidity_fraction * 100, 0) AS humidity_pct,
        round(wind_speed_ms, 1) AS wind_speed_ms
        FROM (SELECT * FROM fct_activity WHERE {_Q1_WHERE} ORDER BY activity_date DESC, athlete_id DESC, activity_id DESC LIMIT 50)""",
        "fct_activity",
    ),
)
def q1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q1(spark, sf_dir, sport_type="ride", start_date="2024-01-05", end_date="2024-01-25", limit=50).rows


_Q2_WHERE = "calendar_date >= DATE '2024-01-04' AND calendar_date <= DATE '2024-01-28'"


def _q2(spark: SparkSession, sf_dir: str, **args) -> queries.Answer:
    # The end date is given as year-day-month and must be repaired.
    return queries.query_daily_health(_lake(spark, sf_dir).daily, "2024-01-04", "2024-28-01", extra=ATHLETE, **args)


@query(
    "q2_a6_f14_daily_health_summary",
    with_models(
        f"""SELECT count(*) AS n_days, round(avg(readiness_score), 1) AS avg_readiness_score, round(avg(hrv_ms), 1) AS avg_hrv_ms,
        round(avg(sleep_score), 1) AS avg_sleep_score, round(avg(total_sleep_s) / 3600, 2) AS avg_sleep_h,
        round(avg(current_resting_hr_bpm), 1) AS avg_resting_hr_bpm, round(avg(stress_avg), 1) AS avg_stress_score,
        round(avg(active_kcal), 0) AS avg_active_kcal, round(avg(total_steps), 0) AS avg_steps
        FROM int_garmin__daily WHERE {_Q2_WHERE}""",
        "int_garmin__daily",
    ),
)
def q2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q2(spark, sf_dir).summary


_HEALTH_PLAIN = """readiness_score, readiness_level, readiness_feedback_short, training_status, hrv_status, sleep_score,
    sleep_score_recovery, sleep_score_restfulness, sleep_score_feedback, stress_avg, stress_avg_awake, body_battery_highest,
    body_battery_lowest, body_battery_gained_during_sleep, current_resting_hr_bpm, resting_hr_7d_avg_bpm,
    avg_waking_respiration_brpm, total_steps, active_kcal, is_vigorous_day, recovery_time_h, recovery_time_factor_feedback, acwr_status"""


@query(
    "q2_t2_newest_days",
    with_models(
        f"""SELECT athlete_id, CAST(calendar_date AS VARCHAR) AS calendar_date, {_HEALTH_PLAIN}, round(hrv_ms, 1) AS hrv_ms,
        round(hrv_baseline_lower_ms, 1) AS hrv_baseline_lower_ms, round(hrv_baseline_upper_ms, 1) AS hrv_baseline_upper_ms,
        round(total_sleep_s / 3600, 2) AS total_sleep_h, round(deep_sleep_s / 3600, 2) AS deep_sleep_h,
        round(rem_sleep_s / 3600, 2) AS rem_sleep_h, round(acwr, 2) AS acwr
        FROM (SELECT * FROM int_garmin__daily WHERE {_Q2_WHERE} ORDER BY calendar_date DESC, athlete_id DESC LIMIT 100)""",
        "int_garmin__daily",
    ),
)
def q2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q2(spark, sf_dir, limit=100).rows


@query("a8_newest_activity_day", with_models("SELECT CAST(max(activity_date) AS VARCHAR) AS latest_day FROM fct_activity", "fct_activity"))
def newest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(queries.newest_activity_day(_lake(spark, sf_dir).activity))


def _series_sql(model: str, value: str, day: str, label: str | None, order: str, points: int, where: str = "true") -> str:
    """Value in whole units, so that both engines sum exactly; rolling mean half to even."""
    least = max(1, points // 2)
    rolling = f"""CASE WHEN count(*) OVER w >= {least} THEN round_even(avg(value) OVER w * 100, 0) / 100 END AS rolling"""
    return with_models(
        f"""SELECT athlete_id, CAST(date AS VARCHAR) AS date, value, label, {rolling}
        FROM (SELECT athlete_id, {day} AS date, CAST({value} AS DOUBLE) AS value, {label or 'CAST(NULL AS VARCHAR)'} AS label, {order} AS tie
              FROM {model} WHERE {where}) WHERE value IS NOT NULL
        WINDOW w AS (PARTITION BY athlete_id ORDER BY date, tie, value ROWS BETWEEN {points - 1} PRECEDING AND CURRENT ROW)""",
        model,
    )


@query("q3_w3_t3_activity_series_rolling_7", _series_sql("fct_activity", "average_heart_rate_bpm", "activity_date", "activity_name", "activity_id", 7, "lower(activity_type) = 'run'"))
def activity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.metric_series(_lake(spark, sf_dir), "activity", "average_heart_rate_bpm", "Run", rolling_days=7, keys=ATHLETE)
    return found.ordered()


@query("q3_w3_health_series_rolling_14", _series_sql("int_garmin__daily", "readiness_score", "calendar_date", None, "NULL", 14, "calendar_date >= DATE '2024-01-03'"))
def health_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.metric_series(_lake(spark, sf_dir), "health", "readiness_score", start_date="2024-01-03", rolling_days=14, keys=ATHLETE)
    return found.ordered()


@query(
    "q3_f10_run_pace_series",
    with_models(
        """SELECT athlete_id, CAST(activity_date AS VARCHAR) AS date, round(gap_min_per_km, 2) AS value, activity_name AS label
        FROM fct_run WHERE gap_min_per_km IS NOT NULL""",
        "fct_run",
    ),
)
def run_pace_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.metric_series(_lake(spark, sf_dir), "run_pace", "gap_min_per_km", keys=ATHLETE).ordered()


@query(
    "q3_a9_race_prediction_span",
    with_models(
        """SELECT CAST(min(calendar_date) AS VARCHAR) AS first_day, CAST(max(calendar_date) AS VARCHAR) AS last_day, count(*) AS points
        FROM stg_garmin__run_race_predictions WHERE predicted_10k_pace_min_per_km IS NOT NULL""",
        "stg_garmin__run_race_predictions",
    ),
)
def race_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _lake(spark, sf_dir)
    return times_as_text(series.metric_series(lake, "race_predictions", "predicted_10k_pace_min_per_km", keys=ATHLETE).span())


def _catalogue_sql() -> str:
    unit = {"moving_time_min": "moving_time_s / 60", "total_sleep_h": "total_sleep_s / 3600"}
    parts, models = [], []
    for family, f in series.CATALOGUE.items():
        models.append(f.table)
        for name, m in f.metrics.items():
            value = unit.get(name, m.source)
            value = value if m.places is None else f"round({value}, {m.places})"
            parts.append(
                f"SELECT '{family}' AS family, '{name}' AS metric, '{m.title}' AS title, count(v) AS points,"
                f" CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high FROM (SELECT {value} AS v FROM {f.table})"
            )
    return with_models(" UNION ALL ".join(parts), *models)


@query("q4_metric_catalogue", _catalogue_sql())
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every family: title, number of points, lowest and highest value (one scan per family)."""
    lake = _lake(spark, sf_dir)
    out = None
    for family, f in series.CATALOGUE.items():
        values = lake.table(f.table).select(*[m.value().alias(n) for n, m in f.metrics.items()])
        stats = values.agg(
            *[F.struct(F.count(n).alias("points"), F.min(n).alias("low"), F.max(n).alias("high")).alias(n) for n in f.metrics]
        )
        rows = F.array(
            *[F.struct(F.lit(family).alias("family"), F.lit(n).alias("metric"), F.lit(m.title).alias("title"), F.col(n).alias("s")) for n, m in f.metrics.items()]
        )
        long = stats.select(F.inline(rows)).select("family", "metric", "title", "s.*")
        out = long if out is None else out.unionByName(long)
    return out


# --- modelling extracts and the study ---------------------------------------

_PREDICTORS = """readiness_score, readiness_hrv_weekly_avg_ms AS hrv_weekly_avg_ms, sleep_score, recovery_time_h, acwr, stress_avg,
    weather_temperature_c AS temperature_c, humidity_fraction AS humidity, wind_speed_ms, precipitation_intensity, cloud_cover_fraction"""
_IDENTITY = "athlete_id, activity_id, activity_date, started_at"
_RIDE_FIT = """SELECT {identity}, average_watts, {predictors} FROM fct_ride WHERE readiness_score IS NOT NULL
    AND average_watts > 0 AND distance_km > 5 AND commute IS DISTINCT FROM true""".format(identity=_IDENTITY, predictors=_PREDICTORS)
_RUN_FIT = """SELECT {identity}, gap_min_per_km, {predictors} FROM fct_run WHERE readiness_score IS NOT NULL
    AND gap_min_per_km > 3 AND gap_min_per_km < 12 AND distance_km > 1""".format(identity=_IDENTITY, predictors=_PREDICTORS)
_TEXT_TIMES = "CAST(activity_date AS VARCHAR) AS activity_date, CAST(started_at AS VARCHAR) AS started_at"


def _rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.ride_extract(_lake(spark, sf_dir).ride, ATHLETE)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.run_extract(_lake(spark, sf_dir).run, ATHLETE)


@query("q5_f11_ride_extract", with_models(f"SELECT * REPLACE ({_TEXT_TIMES}) FROM ({_RIDE_FIT})", "fct_ride"))
def ride_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(queries.in_date_order(_rides(spark, sf_dir)))


@query("q5_f12_run_extract", with_models(f"SELECT * REPLACE ({_TEXT_TIMES}) FROM ({_RUN_FIT})", "fct_run"))
def run_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(queries.in_date_order(_runs(spark, sf_dir)))


_FEATURES = """hour(started_at) AS hour_of_day,
    CASE WHEN precipitation_intensity > 5e-2 THEN 'rainy' WHEN cloud_cover_fraction > 65e-2 THEN 'overcast' ELSE 'clear' END AS weather_category"""


@query(
    "r1_e7_e17_m12_run_features",
    with_models(
        f"""SELECT * REPLACE ({_TEXT_TIMES}), CAST(hour(started_at) AS INTEGER) AS hour_of_day,
        CASE WHEN precipitation_intensity > 5e-2 THEN 'rainy' WHEN cloud_cover_fraction > 65e-2 THEN 'overcast' ELSE 'clear' END
        AS weather_category, -gap_min_per_km AS gap_speed FROM ({_RUN_FIT})""",
        "fct_run",
    ),
)
def run_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(features.engineer(_runs(spark, sf_dir)))


_NULLABLE = (*features.RAW_COMPONENTS, "temperature_c", "humidity")


@query(
    "a10_null_counts",
    with_models("SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _NULLABLE) + f" FROM ({_RIDE_FIT})", "fct_ride"),
)
def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_counts(_rides(spark, sf_dir), _NULLABLE)


@query(
    "a11_sample_span",
    with_models(
        f"""SELECT CAST(min(activity_date) AS VARCHAR) AS first_day, CAST(max(activity_date) AS VARCHAR) AS last_day,
        count(*) AS points FROM ({_RUN_FIT})""",
        "fct_run",
    ),
)
def sample_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(day_span(_runs(spark, sf_dir), "activity_date"))


_MODEL_B = features.MODELS["B — readiness + context"]


@query(
    "f13_e18_complete_case_design",
    with_models(
        f"""SELECT activity_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in (*_MODEL_B, 'average_watts'))},
        {', '.join(f"CAST(weather_category = '{w}' AS INTEGER)::DOUBLE AS w_{w}" for w in features.WEATHER_LEVELS)}
        FROM (SELECT *, {_FEATURES} FROM ({_RIDE_FIT}))
        WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*_MODEL_B, 'average_watts'))}""",
        "fct_ride",
    ),
)
def complete_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.design(features.engineer(_rides(spark, sf_dir)), _MODEL_B, "average_watts", ["activity_id"])


@query("r2_r3_r4_r5_ride_study")
def ride_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nested models on rides: fit and cross-validated scores."""
    return report.fit_table(spark, "ride", report.fit_study(features.engineer(_rides(spark, sf_dir)), "average_watts"))


@query("r6_r7_run_study_standardised")
def run_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nested models on runs: standardised coefficients with intervals and inflation."""
    fits = report.fit_study(features.engineer(_runs(spark, sf_dir)), "gap_speed")
    vif = report.vif_table(spark, "run", fits).withColumnRenamed("feature", "term")
    return report.standardised_table(spark, "run", fits).join(vif.drop("sport"), ["model", "term"], "left").orderBy("model", "beta")


@query("r8_model_comparison")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = report.fit_study(features.engineer(_rides(spark, sf_dir)), "average_watts")
    runs = report.fit_study(features.engineer(_runs(spark, sf_dir)), "gap_speed")
    return report.comparison_table(spark, rides, runs)


@query("r8_readiness_coefficients")
def readiness_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readiness coefficient of every model of both sports."""
    rides = report.fit_study(features.engineer(_rides(spark, sf_dir)), "average_watts")
    runs = report.fit_study(features.engineer(_runs(spark, sf_dir)), "gap_speed")
    return report.readiness_table(spark, {"ride": rides, "run": runs})


@query("r2_r3_ride_coefficients")
def ride_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients, robust errors, z and p of the three ride models."""
    return report.coefficient_table(spark, "ride", report.fit_study(features.engineer(_rides(spark, sf_dir)), "average_watts"))
