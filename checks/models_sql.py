"""DuckDB statements that state what the staged tables and marts must hold."""

from __future__ import annotations

from trainlake.plans import contracts as C

from .expected import columns
from .inputs import DUCK_EV, RAW_SQL

_SQL_TYPE = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE",
}


def _casts(fields) -> list[str]:
    return [
        f'"{f.raw}" AS {f.staged}' if f.kind == "asis" else f'CAST("{f.raw}" AS {_SQL_TYPE[f.kind]}) AS {f.staged}'
        for f in fields
    ]


def _select(table: str, fields, extra: list[str] = (), where: str = "") -> str:
    return f"SELECT athlete_id, {', '.join([*_casts(fields), *extra])} FROM {table} {where}"


def _latest(table: str, day: str, order: str) -> str:
    return f'(SELECT *, {day} AS day_, {order} AS at_ FROM {table} QUALIFY row_number() OVER (PARTITION BY athlete_id, {day} ORDER BY {order} DESC) = 1)'


_EPOCH = "to_timestamp(CAST({} AS DOUBLE) / 1000) AT TIME ZONE 'UTC'"
_MS_DAY = "CAST(make_timestamp(CAST({} AS BIGINT) * 1000) AS DATE)"
_MS_AT = "make_timestamp(CAST({} AS BIGINT) * 1000)"


def _epoch_model(raw: str, fields, day: str, at: str, where: str = "") -> str:
    src = _latest(raw, _MS_DAY.format(day), _MS_AT.format(at))
    return _select(src, fields, ["day_ AS calendar_date", "at_ AS assessed_at_utc"], where)


def _health() -> str:
    source = {
        "value": "CAST(value AS DOUBLE)", "hi": "CAST(baseline_upper_limit AS DOUBLE)",
        "lo": "CAST(baseline_lower_limit AS DOUBLE)", "status": "status", "percentage": "CAST(percentage AS DOUBLE)",
    }
    picks = [
        f"max({source[field]}) FILTER (WHERE metric_type = '{metric}') AS {alias}"
        for metric, text in C.HEALTH_METRICS.items()
        for field, alias in C.pairs(text).items()
    ]
    return f"""SELECT athlete_id, CAST(calendar_date AS DATE) AS calendar_date, bool_or(status = 'ONBOARDING') AS is_onboarding,
        max(CAST(outliers_count AS INTEGER)) AS outliers_count,
        max(CAST(create_timestamp_utc AS TIMESTAMP)) AS created_at_utc, {', '.join(picks)}
        FROM garmin__health_status WHERE status <> 'UNKNOWN' GROUP BY ALL"""


_ISO_DAY, _ISO_AT = "CAST(calendar_date AS DATE)", "CAST(timestamp AS TIMESTAMP)"

STAGED_SQL: dict[str, str] = {
    "stg_strava__activities": _select("strava__activities", C.ACTIVITY_LOG),
    "stg_garmin__activities": _select(
        "garmin__activities",
        C.DEVICE_ACTIVITIES,
        [
            f"{_MS_AT.format('begin_timestamp')} AS started_at_utc",
            f"{_MS_AT.format('start_time_gmt')} AS start_time_utc",
            f"{_MS_AT.format('start_time_local')} AS start_time_local",
            "(start_time_local - start_time_gmt) / 3600000 AS utc_offset_h",
            "duration / 1000 AS duration_s",
            "moving_duration / 1000 AS moving_duration_s",
            "elapsed_duration / 1000 AS elapsed_duration_s",
            *[f"CAST(hr_time_in_zone_{z} AS INTEGER) / 1000 AS hr_zone_{z}_s" for z in range(7)],
        ],
    ),
    "stg_garmin__daily_summary": _select(
        "garmin__daily_summary", C.DAILY_SUMMARY, [f"{_MS_AT.format('resting_heart_rate_timestamp_ms')} AS resting_hr_measured_at"]
    ),
    "stg_garmin__sleep": _select(
        "garmin__sleep",
        C.SLEEP,
        [
            "CAST(deep_sleep_seconds AS INTEGER) + CAST(light_sleep_seconds AS INTEGER)"
            " + ifnull(CAST(rem_sleep_seconds AS INTEGER), 0) AS total_sleep_s"
        ],
        "WHERE sleep_window_confirmation_type IS NULL OR sleep_window_confirmation_type NOT IN ('OFF_WRIST', 'UNCONFIRMED')",
    ),
    "stg_garmin__health_status": _health(),
    "stg_garmin__training_readiness": _select(
        _latest("garmin__training_readiness", _ISO_DAY, _ISO_AT), C.TRAINING_READINESS, where="WHERE level <> 'NONE'"
    ),
    "stg_garmin__training_load": _epoch_model(
        "garmin__training_load", C.TRAINING_LOAD, "calendar_date", "timestamp", "WHERE acwr_status <> 'NONE'"
    ),
    "stg_garmin__training_status": _select(_latest("garmin__training_status", _ISO_DAY, _ISO_AT), C.TRAINING_STATUS),
    "stg_garmin__vo2max": _select("garmin__vo2max", C.VO2MAX),
    "stg_garmin__endurance_score": _epoch_model("garmin__endurance_score", C.ENDURANCE_SCORE, "calendar_date_ms", "timestamp_ms"),
    "stg_garmin__hill_score": _epoch_model("garmin__hill_score", C.HILL_SCORE, "calendar_date", "timestamp"),
    "stg_garmin__run_race_predictions": _select(
        _latest("garmin__run_race_predictions", _ISO_DAY, _ISO_AT),
        C.RACE_PREDICTIONS,
        [
            f"round(CAST({col} AS DOUBLE) / 60 / {km}, 2) AS predicted_{race}_pace_min_per_km"
            for race, col, km in (
                ("5k", "race_time5_k", "5"), ("10k", "race_time10_k", "10"),
                ("half", "race_time_half", "CAST(21.0975 AS DOUBLE)"), ("marathon", "race_time_marathon", "CAST(42.195 AS DOUBLE)"),
            )
        ],
    ),
}


def _take(alias: str, text: str) -> list[str]:
    return [f"{alias}.{c} AS {n}" for c, n in C.pairs(text).items()]


def _daily() -> str:
    columns, joins = _take("d", C.DAY_SPINE["daily_summary"]), ""
    for source in ("sleep", "training_load", "training_status", "training_readiness", "health_status"):
        columns += _take(source, C.DAY_SPINE[source])
        joins += f" LEFT JOIN stg_garmin__{source} {source} ON {source}.athlete_id = d.athlete_id AND {source}.calendar_date = d.calendar_date"
    return f"SELECT d.athlete_id, d.calendar_date, {', '.join(columns)} FROM stg_garmin__daily_summary d{joins}"


def _compatible() -> str:
    arms = " OR ".join(
        f"(a.activity_type IN {_in(left)} AND g.activity_type IN {_in(right)})" for left, right in C.TYPE_FAMILIES.values()
    )
    return f"CASE WHEN {arms} THEN 0 ELSE 1 END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_MATCH = f"""
    SELECT a.athlete_id, a.activity_id, g.activity_id AS garmin_activity_id,
           abs(date_diff('day', CAST(g.start_time_local AS DATE), a.activity_date)) AS day_gap,
           {_compatible()} AS mismatch,
           abs(epoch_us(a.started_at) - epoch_us(g.start_time_local)) / 1e6 AS gap_s
    FROM stg_strava__activities a JOIN stg_garmin__activities g
      ON g.athlete_id = a.athlete_id AND abs(date_diff('day', CAST(g.start_time_local AS DATE), a.activity_date)) <= 1
    QUALIFY row_number() OVER (PARTITION BY a.athlete_id, a.activity_id ORDER BY day_gap, mismatch, gap_s, garmin_activity_id) = 1
"""


def _activity() -> str:
    columns = [
        *_take("a", C.ACTIVITY_COLUMNS),
        "m.garmin_activity_id",
        "hour(a.started_at) >= 22 AS late_start_utc_risk",
        "m.activity_id IS NOT NULL AS garmin_activity_matched",
        "ifnull(m.mismatch = 0, false) AS garmin_match_type_compatible",
        "m.gap_s AS garmin_match_start_diff_s",
        "a.distance_m / 1000 AS distance_km",
        "a.average_speed_ms * 3.6e0 AS average_speed_kph",
        *_take("g", C.MATCHED_COLUMNS),
        *_take("d", C.DAY_CONTEXT_COLUMNS),
    ]
    return f"""SELECT a.athlete_id, {', '.join(columns)}
        FROM stg_strava__activities a
        LEFT JOIN matched m ON m.athlete_id = a.athlete_id AND m.activity_id = a.activity_id
        LEFT JOIN stg_garmin__activities g ON g.athlete_id = m.athlete_id AND g.activity_id = m.garmin_activity_id
        LEFT JOIN int_garmin__daily d ON d.athlete_id = a.athlete_id AND d.calendar_date = a.activity_date"""


def _sport(types, drops: str, derived: list[str]) -> str:
    gated = [c for c in C.pairs(C.MATCHED_COLUMNS).values() if c not in drops.split()]
    replaced = ", ".join(f"CASE WHEN garmin_match_type_compatible THEN {c} END AS {c}" for c in gated)
    return f"""SELECT * EXCLUDE ({', '.join(drops.split())}) REPLACE ({replaced}), {', '.join(derived)}
        FROM fct_activity WHERE activity_type IN {_in(types)}"""


_MILE = "CAST(1.60934 AS DOUBLE)"
MART_SQL: dict[str, str] = {
    "int_garmin__daily": _daily(),
    "matched": _MATCH,
    "fct_activity": _activity(),
    "fct_ride": _sport(
        C.RIDE_TYPES,
        C.RIDE_DROPS,
        [
            f"average_speed_kph / {_MILE} AS average_speed_mph",
            "max_speed_ms * 3.6e0 AS max_speed_kph",
            "if(athlete_weight_kg > 0, average_watts / athlete_weight_kg, NULL) AS average_wkg",
            "if(athlete_weight_kg > 0, weighted_average_power_w / athlete_weight_kg, NULL) AS weighted_average_wkg",
            "if(average_heart_rate_bpm > 0 AND average_watts > 0, average_watts / average_heart_rate_bpm, NULL) AS watts_per_bpm",
        ],
    ),
    "fct_run": _sport(
        C.RUN_TYPES,
        C.RUN_DROPS,
        [
            "grade_adjusted_distance_m / 1000 AS grade_adjusted_distance_km",
            "if(distance_km > 0, moving_time_s / 6e1 / distance_km, NULL) AS pace_min_per_km",
            f"if(distance_km > 0, moving_time_s / 6e1 / (distance_km / {_MILE}), NULL) AS pace_min_per_mile",
            "if(grade_adjusted_distance_m > 0, moving_time_s / 6e1 / (grade_adjusted_distance_m / 1e3), NULL) AS gap_min_per_km",
            "max_speed_ms * 3.6e0 AS max_speed_kph",
            "if(average_heart_rate_bpm > 0 AND distance_km > 0, moving_time_s / 6e1 / distance_km / average_heart_rate_bpm, NULL)"
            " AS pace_per_bpm",
        ],
    ),
}

_NEEDS = {
    "matched": ("stg_strava__activities", "stg_garmin__activities"),
    "int_garmin__daily": tuple(
        f"stg_garmin__{s}" for s in ("daily_summary", "sleep", "training_load", "training_status", "training_readiness", "health_status")
    ),
    "fct_activity": ("stg_strava__activities", "stg_garmin__activities", "int_garmin__daily", "matched"),
    "fct_ride": ("fct_activity",),
    "fct_run": ("fct_activity",),
}


def _raw_of(staged: str) -> str:
    return staged.removeprefix("stg_")


def with_models(body: str, *models: str) -> str:
    """``body`` preceded by the CTEs it needs, from the events table up."""
    ordered: dict[str, str] = {"ev": DUCK_EV}

    def add(name: str) -> None:
        if name in ordered:
            return
        if name in STAGED_SQL:
            ordered[_raw_of(name)] = RAW_SQL[_raw_of(name)]
            ordered[name] = STAGED_SQL[name]
        elif name in RAW_SQL:
            ordered[name] = RAW_SQL[name]
        else:
            for need in _NEEDS[name]:
                add(need)
            ordered[name] = MART_SQL[name]

    for model in models:
        add(model)
    ctes = ",\n".join(f"{n} AS (\n{sql}\n)" for n, sql in ordered.items())
    return f"WITH {ctes}\n{body}"


def model_sql(name: str) -> str:
    """All rows of one model; days and times as text."""
    return with_models(as_text(name), name)


def as_text(model: str) -> str:
    """The columns a model must have, named one by one; days and times as text."""
    times = ("date", "timestamp_ntz", "timestamp")
    shown = [f"CAST({c} AS VARCHAR) AS {c}" if t in times else c for c, t in columns(model)]
    return f"SELECT {', '.join(shown)} FROM {model}"
