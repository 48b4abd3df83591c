from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.functions import casts, metrics, scalars
from trainlake.functions.names import snake_case


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{n} {t}" for n, t in _types(values)) or "x int")
    return df.select(expr.alias("r")).first()["r"]


def _types(values):
    names = {str: "string", int: "int", float: "double", bool: "boolean", date: "date", datetime: "timestamp_ntz", type(None): "double"}
    return [(n, names[type(v)]) for n, v in values.items()]


@pytest.mark.parametrize(
    "value, want",
    [(152.7, 153), (2.5, 2), (3.5, 4), (-2.5, -2), ("42.0", 42), ("2.5", 3), ("-2.5", -3), (" 7 ", 7), ("9007199254740993", 9007199254740993), (None, None)],
)
def test_integers_round(spark, value, want):
    source = T.StringType() if isinstance(value, str) else T.DoubleType()
    assert one(spark, casts.convert("v", source, "bigint"), v=value) == want


def test_garbage_integers_fail(spark):
    with pytest.raises(PySparkException):
        one(spark, casts.convert("v", T.StringType(), "int"), v="abc")


@pytest.mark.parametrize("value, want", [("true", True), ("False", False), ("1.0", True), ("0", False)])
def test_booleans_from_text(spark, value, want):
    assert one(spark, casts.convert("v", T.StringType(), "boolean"), v=value) is want


def test_epoch_and_iso_times(spark):
    at = datetime(2024, 3, 10, 2, 30, 0, 123000)  # an hour that US clocks skip
    ms = 1710037800123
    assert one(spark, casts.epoch_ms(F.lit(ms))) == at
    assert one(spark, casts.epoch_ms_frac(F.lit(ms + 0.25))) == at.replace(microsecond=123250)
    for text in ("2024-03-10T02:30:00.123", "2024-03-10 02:30:00.123", "2024-03-10T02:30:00.123Z", "2024-03-10T04:30:00.123+02:00"):
        assert one(spark, casts.convert("v", T.StringType(), "timestamp"), v=text) == at


@pytest.mark.parametrize(
    "text, want",
    [
        ("May 6, 2018, 5:38:31 PM", datetime(2018, 5, 6, 17, 38, 31)),
        ("Dec 31, 2024, 12:00:00 AM", datetime(2024, 12, 31)),
        ("May 6, 2018, 5:38:31 PM", datetime(2018, 5, 6, 17, 38, 31)),
        ("2018-05-06 17:38:31", datetime(2018, 5, 6, 17, 38, 31)),
        ("3/4/2018 7:05:00", datetime(2018, 3, 4, 7, 5)),
        ("", None),
        ("nan", None),
    ],
)
def test_human_times(spark, text, want):
    assert one(spark, casts.parse_human_time(F.col("v")), v=text) == want


def test_unreadable_time_fails(spark):
    with pytest.raises(PySparkException):
        one(spark, casts.parse_human_time(F.col("v")), v="sometime in May")
    assert one(spark, casts.parse_human_time(F.col("v"), strict=False), v="sometime in May") is None


def test_date_arguments(spark):
    assert casts.repair_date_argument("2026-03-04") == date(2026, 3, 4)
    assert casts.repair_date_argument("2026-25-03") == date(2026, 3, 25)
    assert casts.repair_date_argument(None) is None
    with pytest.raises(ValueError):
        casts.repair_date_argument("03/04/2026", "start_date")
    assert one(spark, casts.repair_date_column(F.col("v")), v="2026-25-03") == date(2026, 3, 25)
    assert one(spark, casts.repair_date_column(F.col("v")), v="03/04/2026") is None


def test_snake_case():
    names = {
        "raceTime5K": "race_time5_k", "vo2MaxValue": "vo2_max_value", "Max Heart Rate": "max_heart_rate",
        "userProfilePK": "user_profile_pk", "hrTimeInZone_0": "hr_time_in_zone_0", "Activity ID": "activity_id",
        "sleepStartTimestampGMT": "sleep_start_timestamp_gmt", "trainingStatus2FeedbackPhrase": "training_status2_feedback_phrase",
    }
    assert {n: snake_case(n) for n in names} == names


def test_rounding(spark):
    assert one(spark, scalars.round_dp(F.lit(1.005), 2)) == 1.0
    assert one(spark, scalars.round_dp(F.lit(-2.5), 0)) == -3.0
    assert one(spark, scalars.round_dp(F.lit(2.675), 2)) == 2.68
    assert one(spark, scalars.round_dp_even(F.lit(0.125), 2)) == 0.12


def test_weather(spark):
    cases = [(0.06, 0.9, "rainy"), (0.05, 0.7, "overcast"), (None, None, "clear"), (float("nan"), float("nan"), "clear"), (None, 0.65, "clear")]
    for rain, cloud, want in cases:
        df = spark.createDataFrame([(rain, cloud)], "r double, c double")
        assert df.select(scalars.weather_category(F.col("r"), F.col("c"))).first()[0] == want


def test_tiers(spark):
    for score, want in [(71, "PRIME"), (70, "MODERATE"), (56, "MODERATE"), (55, "LOW"), (None, "LOW")]:
        assert one(spark, scalars.tier_bucket(F.lit(score).cast("double"))) == want


def test_ratio_guards(spark):
    number = lambda v: F.lit(v).cast("double")
    assert one(spark, metrics.watts_per_kg(number(200), number(80))) == 2.5
    for weight in (0, None):
        assert one(spark, metrics.watts_per_kg(number(200), number(weight))) is None
    assert one(spark, metrics.watts_per_bpm(number(150), number(0))) is None
    assert one(spark, metrics.watts_per_bpm(number(0), number(100))) is None
    assert one(spark, metrics.pace_min_per_km(number(300), number(0))) is None
    assert one(spark, metrics.pace_min_per_km(number(300), number(1))) == 5.0
    assert one(spark, metrics.graded_pace_min_per_km(number(300), number(1000))) == 5.0
    assert one(spark, metrics.pace_per_bpm(number(300), number(1), number(None))) is None
    assert one(spark, scalars.safe_divide(number(1), number(0))) is None


def test_sleep_total(spark):
    s = lambda v: F.lit(v).cast("int")
    assert one(spark, metrics.total_sleep_s(s(10), s(20), s(None))) == 30
    assert one(spark, metrics.total_sleep_s(s(None), s(20), s(5))) is None
