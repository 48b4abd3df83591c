"""Hand-made rows for the staged tables, the marts and the plans behind them."""

import pytest
from pyspark.sql import functions as F

from checks import inputs
from trainlake.plans import contracts as C
from trainlake.plans import marts, staging
from trainlake.sources import schemas


def raw_frame(spark, fields, rows, extra=""):
    """Rows as dicts; columns not given are NULL of a plausible raw type."""
    types = {"int": "double", "double": "double", "bigint": "bigint", "boolean": "boolean"}
    ddl = ", ".join(f"`{f.raw}` {types.get(f.kind, 'string')}" for f in fields)
    ddl = f"{ddl}, {extra}" if extra else ddl
    names = [p.strip().split(" ")[0].strip("`") for p in ddl.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract_sizes():
    sizes = {
        "activity log": (C.ACTIVITY_LOG, 72), "device": (C.DEVICE_ACTIVITIES, 58 - 14), "daily": (C.DAILY_SUMMARY, 59 - 1),
        "sleep": (C.SLEEP, 31 - 1), "readiness": (C.TRAINING_READINESS, 26), "load": (C.TRAINING_LOAD, 10 - 2),
        "status": (C.TRAINING_STATUS, 7), "vo2max": (C.VO2MAX, 10), "endurance": (C.ENDURANCE_SCORE, 12 - 2),
        "hill": (C.HILL_SCORE, 10 - 2), "race": (C.RACE_PREDICTIONS, 12 - 4),
    }
    assert {n: len(f) for n, (f, _) in sizes.items()} == {n: s for n, (_, s) in sizes.items()}


def test_sleep_quality(spark):
    kinds = ["CONFIRMED", "OFF_WRIST", "UNCONFIRMED", None, "CONFIRMED"]
    rows = [
        {"calendar_date": f"2024-01-0{i}", "sleep_window_confirmation_type": k, "deep_sleep_seconds": None if i == 5 else 10.0,
         "light_sleep_seconds": 20.0, "rem_sleep_seconds": None if i == 1 else 5.0}
        for i, k in enumerate(kinds, 1)
    ]
    got = staging.sleep(raw_frame(spark, C.SLEEP, rows)).orderBy("calendar_date").collect()
    assert [(r["calendar_date"].day, r["total_sleep_s"]) for r in got] == [(1, 30), (4, 35), (5, None)]


def test_readiness_dedupes_before_the_level_filter(spark):
    day = lambda d, h, level, score=None: {"calendar_date": f"2024-01-0{d}", "timestamp": f"2024-01-0{d}T{h:02d}:00:00.0", "level": level, "score": score}
    rows = [day(1, 6, "HIGH", 70.0), day(1, 18, "LOW", 40.0), day(2, 6, "HIGH"), day(2, 18, "NONE"), day(3, 6, None)]
    df = staging.training_readiness(raw_frame(spark, C.TRAINING_READINESS, rows))
    assert [(r["readiness_level"], r["readiness_score"]) for r in df.collect()] == [("LOW", 40)]
    assert "WindowGroupLimit" in plan(df)


def test_load_keeps_the_later_row_of_a_utc_day(spark):
    noon = 1704110400000
    rows = [
        {"calendar_date": noon, "timestamp": noon, "acwr_status": "NONE"},
        {"calendar_date": noon + 3600000, "timestamp": noon + 1, "acwr_status": "HIGH", "acwr_percent": 12.5},
    ]
    got = staging.training_load(raw_frame(spark, C.TRAINING_LOAD, rows, "calendar_date bigint, timestamp bigint")).collect()
    assert len(got) == 1 and got[0]["acwr_pct"] == 12 and str(got[0]["calendar_date"]) == "2024-01-01"


def test_vo2max_keeps_every_row(spark):
    rows = [{"calendar_date": "2024-01-01", "vo2_max_value": 50.0}, {"calendar_date": "2024-01-01", "vo2_max_value": 51.0}]
    assert staging.vo2max(raw_frame(spark, C.VO2MAX, rows)).count() == 2


def test_health_pivot(spark):
    rows = [
        ("2024-01-01", "HRV", 50.0, "ONBOARDING"), ("2024-01-01", "HR", 45.0, "OK"), ("2024-01-01", "SPO2", 97.0, "OK"),
        ("2024-01-02", "HRV", 51.0, "UNKNOWN"), ("2024-01-03", "HRV", 52.0, None),
        ("2024-01-04", "SKIN_TEMP_C", 0.5, "OK"), ("2024-01-04", "RESPIRATION", 14.0, "OK"),
    ]
    df = spark.createDataFrame(rows, "calendar_date string, metric_type string, value double, status string")
    for c, t in (("baseline_upper_limit", "double"), ("baseline_lower_limit", "double"), ("percentage", "double"),
                 ("outliers_count", "double"), ("create_timestamp_utc", "string")):
        df = df.withColumn(c, F.lit(None).cast(t))
    got = {str(r["calendar_date"]): r for r in staging.health_status(df).collect()}
    assert set(got) == {"2024-01-01", "2024-01-04"}
    assert (got["2024-01-01"]["is_onboarding"], got["2024-01-01"]["hrv_ms"], got["2024-01-01"]["resting_hr_bpm"]) == (True, 50.0, 45.0)
    assert (got["2024-01-04"]["is_onboarding"], got["2024-01-04"]["skin_temp_delta_c"], got["2024-01-04"]["respiration_brpm"]) == (False, 0.5, 14.0)


def test_missing_raw_columns_are_named(spark):
    with pytest.raises(ValueError, match="raw table lacks"):
        staging.vo2max(spark.createDataFrame([(1,)], "device_id bigint"))


def test_every_model_row_count_and_uniqueness(spark, sf):
    staged = staging.stage_all(inputs.spark_raw(spark, sf), inputs.ATHLETE)
    days = marts.daily(staged, inputs.ATHLETE)
    assert days.count() == staged["stg_garmin__daily_summary"].count()
    log = staged["stg_strava__activities"]
    acts = marts.activity(log, staged["stg_garmin__activities"], days, inputs.ATHLETE)
    assert acts.count() == log.count() == acts.select("activity_id").distinct().count()
    for name in ("training_readiness", "training_load", "training_status", "endurance_score", "hill_score", "run_race_predictions"):
        table = staged[f"stg_garmin__{name}"]
        assert table.count() == table.select("athlete_id", "calendar_date").distinct().count()
    text = plan(acts)
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_gating_blanks_incompatible_recordings(spark, sf):
    staged = staging.stage_all(inputs.spark_raw(spark, sf), inputs.ATHLETE)
    days = marts.daily(staged, inputs.ATHLETE)
    acts = marts.activity(staged["stg_strava__activities"], staged["stg_garmin__activities"], days, inputs.ATHLETE)
    rides = marts.ride(acts)
    wrong = rides.filter("NOT garmin_match_type_compatible AND (garmin_avg_power_w IS NOT NULL OR hr_zone_0_s IS NOT NULL OR is_pr IS NOT NULL)")
    assert wrong.count() == 0
    assert acts.filter("garmin_match_type_compatible IS NULL").count() == 0
    assert acts.filter("NOT garmin_activity_matched AND garmin_match_type_compatible").count() == 0


def test_hot_day_gives_the_same_mart(spark, sf):
    """One key holding many rows takes the split path and changes nothing."""
    staged = staging.stage_all(inputs.spark_raw(spark, sf), ())
    days = staged["stg_garmin__daily_summary"].dropDuplicates(["calendar_date"])
    one_each = {n: (t.dropDuplicates(["calendar_date"]) if "calendar_date" in t.columns else t) for n, t in staged.items()}
    one_each["stg_garmin__daily_summary"] = days
    spine = marts.daily(one_each, hot_rows=None)
    spine = spine.select(*[F.col(c) for c in spine.columns])
    log, device = staged["stg_strava__activities"], staged["stg_garmin__activities"]
    plain = marts.activity(log, device, spine, hot_rows=None).select("activity_id", "garmin_activity_id", "garmin_match_start_diff_s")
    split = marts.activity(log, device, spine, hot_rows=5).select("activity_id", "garmin_activity_id", "garmin_match_start_diff_s")
    assert sorted(plain.collect()) == sorted(split.collect())


def test_day_spine_shuffles_each_source_once(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        staged = staging.stage_all(inputs.spark_raw(spark, sf, "garmin__training_readiness", "garmin__training_load"), inputs.ATHLETE)
        log = staging.daily_summary(inputs.spark_raw(spark, sf, "garmin__daily_summary")["garmin__daily_summary"], inputs.ATHLETE)
        joined = log.select("athlete_id", "calendar_date", "total_steps")
        for table in staged.values():
            joined = joined.join(table.drop("user_profile_pk", "device_id", "assessed_at_utc"), ["athlete_id", "calendar_date"], "left")
        text = plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One per side; the derived spine rows already come grouped by athlete and day text, so they move once more.
    assert text.count("Exchange hashpartitioning") <= 4


def test_wire_names_follow_the_rule():
    assert schemas.wire_name("hr_time_in_zone_0") == "hrTimeInZone_0"
    assert schemas.wire_name("race_time5_k") == "raceTime5K"
    assert schemas.wire_name("vo2_max_value") == "vo2MaxValue"
    assert schemas.wire_name("sleep_start_timestamp_gmt") == "sleepStartTimestampGMT"


def test_days_reach_the_files(spark, sf):
    """A date range on the spine is pushed to all six raw tables, and one readiness value reads few columns."""
    import re

    from checks.model_queries import _lake

    lake = _lake(spark, sf)
    days = lake.daily.filter("calendar_date >= DATE '2024-01-04' AND calendar_date <= DATE '2024-01-05'")
    plan = days._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PushedFilters: \[(.*)", plan)
    assert len(scans) == 6 and all("_day" in s for s in scans)
    one = lake.table("stg_garmin__training_readiness").select("athlete_id", "calendar_date", "readiness_score")
    plan = one._jdf.queryExecution().executedPlan().toString()
    [schema] = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert len(schema.split(",")) < 8


SPINE = ("daily_summary", "sleep", "training_load", "training_status", "training_readiness", "health_status")


def exchanges(df):
    """Exchanges of the plan, with joins that don't broadcast."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(df.select("*")).count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def jobs_while(spark, work):
    """What ``work`` returns and how many jobs ran meanwhile."""
    sc = spark.sparkContext
    group = f"planning-{id(work)}"
    sc.setJobGroup(group, "plan only")
    try:
        return work(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_fused_days_equal_the_joined_ones(spark, sf):
    raw = inputs.spark_raw(spark, sf, *[f"garmin__{s}" for s in SPINE])
    joined = marts.daily(staging.stage_all(raw, inputs.ATHLETE), inputs.ATHLETE)
    fused = marts.days(raw.__getitem__, inputs.ATHLETE)
    assert fused.dtypes == joined.dtypes
    assert fused.exceptAll(joined).count() == joined.exceptAll(fused).count() == 0


def test_fused_days_cases(spark):
    """Days repeated, missing or without any summary, equal times, a status that leaves the day out, all keys NULL."""
    day = lambda d: None if d is None else f"2024-01-0{d}"
    summary = raw_frame(spark, C.DAILY_SUMMARY, [{"calendar_date": day(d), "total_steps": float(n)} for n, d in enumerate((1, 1, 2, 3, None, None))], "resting_heart_rate_timestamp_ms double")
    sleep = raw_frame(spark, C.SLEEP, [{"calendar_date": day(d), "deep_sleep_seconds": 5.0 * k} for k, d in enumerate((1, 3, 3, 4, None))])
    load = raw_frame(
        spark, C.TRAINING_LOAD,
        [{"calendar_date": 1704067200000 + 86400000 * (d - 1), "timestamp": t, "acwr_status": s, "acwr_percent": p}
         for d, t, s, p in ((1, 5, "LOW", 1.0), (1, 9, "HIGH", 2.0), (2, 9, "NONE", 3.0), (2, 5, "LOW", 4.0), (3, None, "LOW", 5.0), (3, 1, None, 6.0))],
        "calendar_date bigint, timestamp bigint",
    )
    status = raw_frame(spark, C.TRAINING_STATUS, [{"calendar_date": day(3), "timestamp": "2024-01-03T06:00:00.0", "training_status": s} for s in ("A", "B")])
    ready = raw_frame(spark, C.TRAINING_READINESS, [{"calendar_date": day(2), "timestamp": t, "level": "LOW", "score": p} for t, p in ((None, 1.0), ("2024-01-02T06:00:00.0", 2.0))])
    health = spark.createDataFrame(
        [(day(1), "HRV", 50.0, "OK"), (day(2), "HRV", 51.0, "UNKNOWN"), (None, "HR", 40.0, "ONBOARDING")],
        "calendar_date string, metric_type string, value double, status string",
    )
    for c, t in (("baseline_upper_limit", "double"), ("baseline_lower_limit", "double"), ("percentage", "double"), ("outliers_count", "double"), ("create_timestamp_utc", "string")):
        health = health.withColumn(c, F.lit(None).cast(t))
    raw = dict(zip((f"garmin__{s}" for s in SPINE), (summary, sleep, load, status, ready, health)))
    joined = marts.daily(staging.stage_all(raw))
    fused = marts.days(raw.__getitem__)
    assert sorted(map(str, fused.collect())) == sorted(map(str, joined.collect()))
    rows = {(str(r["calendar_date"]), r["total_steps"]): r for r in fused.collect()}
    assert len(fused.collect()) == 7 and rows["2024-01-01", 0]["acwr_pct"] == 2 and rows["2024-01-02", 2]["acwr_pct"] is None
    assert rows["2024-01-02", 2]["readiness_score"] == 2 and rows["2024-01-02", 2]["health_status_is_onboarding"] is None
    assert rows["2024-01-01", 1]["health_status_is_onboarding"] is False and rows["None", 4]["hrv_ms"] is None


def test_marts_plan_without_jobs_and_few_exchanges(spark, sf):
    from checks.model_queries import _lake_path
    from trainlake.sources import tables

    path = _lake_path(spark, sf)
    raw = {n: tables.read_table(spark, path, "raw", n) for n in ("strava__activities", "garmin__activities", *[f"garmin__{s}" for s in SPINE])}
    (days, acts), jobs = jobs_while(spark, lambda: _planned(raw))
    assert jobs == 0
    # Summaries, nights, and the four other sources in one.
    assert exchanges(days) == 3
    # The log once for its day context, whose other side lies right already; the best match takes five.
    assert exchanges(acts) == 3 + 1 + 5


def _planned(raw):
    days = marts.days(raw.__getitem__, inputs.ATHLETE)
    log, device = staging.activity_log(raw["strava__activities"], inputs.ATHLETE), staging.device_activities(raw["garmin__activities"], inputs.ATHLETE)
    return days, marts.activity(log, device, days, inputs.ATHLETE)


def test_sport_and_tier_reach_the_files(spark, sf):
    import re

    from checks.model_queries import _lake
    from trainlake.plans import queries

    lake = _lake(spark, sf)
    answer = queries.query_activities(lake.activity, "riDe", "2024-01-02", None, "low")
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        [pushed] = re.findall(r"PushedFilters: \[(.*)", plan(answer.summary))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert "EqualTo(_sport,ride)" in pushed and "EqualTo(_tier,LOW)" in pushed and "GreaterThanOrEqual(activity_date" in pushed
    plain = lake.activity.drop("_sport", "_tier")
    assert queries.query_activities(plain, "riDe", "2024-01-02", None, "low").summary.first() == answer.summary.first()
    assert not {"_sport", "_tier"} & {*lake.ride.columns, *lake.run.columns}


def test_steps_of_a_build_free_their_files(spark, sf, tmp_path):
    import os
    import time

    from trainlake.plans import build

    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}

    before = shuffled()
    raw = inputs.spark_raw(spark, sf)
    lake = build.build(spark, raw, str(tmp_path), inputs.ATHLETE)
    # Removed by other threads.
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert os.listdir(tmp_path / "intermediate") == []
    lazy = build.lazy_lake(raw, inputs.ATHLETE).activity
    written = lake.activity.drop("_sport", "_tier")
    assert written.columns == lazy.columns and written.count() == lazy.count() > 0
    assert written.exceptAll(lazy).isEmpty() and lazy.exceptAll(written).isEmpty()


def test_raw_rows_are_made_once(spark, tmp_path):
    from trainlake.plans import build

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(0, 400, 1, 4).selectExpr("id AS device_id", "CAST(DATE'2024-01-01' + CAST(id % 9 AS INT) AS STRING) AS calendar_date")
    made = df.mapInPandas(counted, df.schema)
    stored = build.write_raw(spark, {"garmin__training_readiness": made}, str(tmp_path))["garmin__training_readiness"]
    # Not once more for the bounds of the ranges.
    assert seen.value == 400
    assert stored.count() == 400 and stored.select(*df.columns).exceptAll(df).isEmpty()
