"""Raw wearable and activity tables derived from the ``events`` table.

Each raw table is one SQL text that Spark and DuckDB both understand, over a
small base relation that is spelled per engine.  Every event row is used; the
derivation only relabels columns, with NULLs, fractions and enum values mixed
in so that the operators under test have something to decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trainlake.plans import contracts as C

ATHLETE = ("athlete_id",)

DUCK_EV = """
    SELECT event_id, user_id, event_type, value, ts, CAST(ts AS DATE) AS day, epoch_us(ts) // 1000 AS ms,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
    FROM events
"""
# One row per user and day.
PER_DAY = """
    SELECT user_id, day, min(event_id) AS event_id, max(event_type) AS event_type, max(value) AS value,
           max(ts) AS ts, max(ms) AS ms, max(k) AS k
    FROM ev GROUP BY user_id, day
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type", "value", "ts", "CAST(ts AS DATE) AS day",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS ms", "CAST(get_json_object(props, '$.k') AS INT) AS k",
    )


def _by_k(*steps: tuple[int, str | None], last: str) -> str:
    arms = " ".join(f"WHEN k < {n} THEN {'NULL' if v is None else repr(v)}" for n, v in steps)
    return f"CASE {arms} ELSE {last!r} END"


def _generic(i: int, kind: str) -> str:
    expr = {
        "int": f"value * {1 + i % 5} / 4",
        "bigint": f"event_id * 1000 + {i}",
        "double": f"value + {i}",
        "boolean": f"k > {10 + i % 50}",
        "timestamp": "CAST(ts AS STRING)",
        "date": "CAST(day AS STRING)",
        "asis": f"event_type || '_{i}'",
    }[kind]
    return expr if kind in ("timestamp", "date") else f"CASE WHEN k < {i * 7 % 23} THEN NULL ELSE {expr} END"


def _raw(fields: tuple[C.Field, ...], special: dict[str, str], source: str = "ev", where: str = "") -> str:
    columns = {f.raw: _generic(i, f.kind) for i, f in enumerate(fields)}
    columns.update(special)
    body = ",\n  ".join(f"{expr} AS {name}" for name, expr in columns.items())
    src = f"({PER_DAY}) d" if source == "per_day" else "ev"
    return f"SELECT user_id AS athlete_id,\n  {body}\nFROM {src} {where}"


_DAY_MS = "ms - ms % 86400000"

RAW_SQL: dict[str, str] = {
    "strava__activities": _raw(
        C.ACTIVITY_LOG,
        {
            "activity_id": "event_id",
            "activity_date": "day",
            "started_at": "ts",
            "activity_type": _by_k(
                (20, "Ride"), (25, "GravelRide"), (45, "Run"), (50, "TrailRun"), (60, "Hike"),
                (70, "Weight Training"), (75, "Rock Climb"), (80, None), (85, "Crossfit"), last="Yoga",
            ),
            "athlete_weight": "CASE WHEN k % 10 = 0 THEN 0.0 ELSE 60 + value / 10 END",
            "grade_adjusted_distance": "CASE WHEN k % 10 = 1 THEN 0.0 ELSE value * (600 + 5 * k) END",
            "distance": "CASE WHEN k % 10 = 2 THEN 0.0 ELSE value * 1000 END",
            "moving_time": "value * 300",
        },
        where="WHERE event_type IN ('click', 'purchase', 'error')",
    ),
    "garmin__activities": _raw(
        C.DEVICE_ACTIVITIES,
        {
            "activity_id": "event_id",
            "activity_type": _by_k(
                (25, "cycling"), (30, None), (50, "running"), (60, "hiking"), (75, "strength_training"),
                (90, "yoga"), last="golf",
            ),
            "begin_timestamp": "ms",
            "start_time_gmt": "CAST(ms + 3600000 * (k % 5) AS DOUBLE)",
            "start_time_local": "CAST(ms AS DOUBLE)",
            "duration": "value * 1000",
            "moving_duration": "value * 900",
            "elapsed_duration": "value * 1100",
            **{f"hr_time_in_zone_{z}": f"value * {z + 1}" for z in range(7)},
        },
        where="WHERE event_type IN ('view', 'signup')",
    ),
    "garmin__daily_summary": _raw(
        C.DAILY_SUMMARY,
        {"user_profile_pk": "CAST(user_id AS DOUBLE)", "resting_heart_rate_timestamp_ms": "CAST(ms AS DOUBLE)"},
        source="per_day",
    ),
    "garmin__sleep": _raw(
        C.SLEEP,
        {
            "sleep_window_confirmation_type": _by_k(
                (50, "OFF_WRIST"), (60, "UNCONFIRMED"), (70, None), last="ENHANCED_CONFIRMED_FINAL"
            )
        },
        source="per_day",
    ),
    "garmin__health_status": """
        SELECT user_id AS athlete_id, CAST(day AS STRING) AS calendar_date, CAST(ts AS STRING) AS create_timestamp_utc,
               CASE WHEN k < 50 THEN NULL ELSE value / 3 END AS outliers_count,
               CASE event_type WHEN 'click' THEN 'HRV' WHEN 'view' THEN 'HR' WHEN 'purchase' THEN 'SKIN_TEMP_C'
                               WHEN 'signup' THEN 'RESPIRATION' ELSE 'SPO2' END AS metric_type,
               value, value + 10 AS baseline_upper_limit, value - 10 AS baseline_lower_limit,
               CASE WHEN k < 5 THEN 'UNKNOWN' WHEN k < 10 THEN NULL WHEN k < 30 THEN 'ONBOARDING'
                    WHEN k < 60 THEN 'BALANCED' ELSE 'LOW' END AS status,
               value / 2 AS percentage
        FROM ev
    """,
    "garmin__training_readiness": _raw(
        C.TRAINING_READINESS,
        {
            "level": _by_k((5, None), (20, "NONE"), (40, "LOW"), (60, "MODERATE"), (80, "HIGH"), last="PRIME"),
            "score": "CAST(k AS DOUBLE)",
        },
    ),
    "garmin__training_load": _raw(
        C.TRAINING_LOAD,
        {
            "calendar_date": _DAY_MS,
            "timestamp": "ms",
            "acwr_status": _by_k((5, None), (20, "NONE"), (60, "OPTIMAL"), last="HIGH"),
        },
    ),
    "garmin__training_status": _raw(C.TRAINING_STATUS, {"training_status": _by_k((50, "NO_STATUS"), last="PRODUCTIVE")}),
    "garmin__vo2max": _raw(C.VO2MAX, {}),
    "garmin__endurance_score": _raw(C.ENDURANCE_SCORE, {"calendar_date_ms": _DAY_MS, "timestamp_ms": "ms"}),
    "garmin__hill_score": _raw(C.HILL_SCORE, {"calendar_date": _DAY_MS, "timestamp": "ms"}),
    "garmin__run_race_predictions": _raw(C.RACE_PREDICTIONS, {}),
}


def spark_raw(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named raw tables (all when none is named), lazily derived."""
    ev = spark_ev(spark, sf_dir)
    chosen = names or tuple(RAW_SQL)
    return {n: spark.sql("WITH ev AS (SELECT * FROM {base}) " + _braces(RAW_SQL[n]), base=ev) for n in chosen}


def _braces(text: str) -> str:
    return text.replace("{", "{{").replace("}", "}}")
