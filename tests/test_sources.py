import json
import os
import random
import tempfile
import warnings

import pytest
from pyspark.sql import functions as F

from trainlake.plans import build, queries, series, staging
from trainlake.session import case_sensitive
from trainlake.sources import discover, documents, flatten, readers, schemas, tables


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def put(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(data if isinstance(data, str) else json.dumps(data, indent=1))
    return path


def dicts(df):
    return [r.asDict() for r in df.collect()]


def test_json_files_of_arrays_and_lone_objects(spark, folder):
    put(folder, "a.json", [{"x": 1}, {"x": 2, "extra": True}])
    put(folder, "b.json", {"x": 3})
    got = readers.read_json(spark, f"{folder}/*.json", "x INT")
    assert sorted(r["x"] for r in got.collect()) == [1, 2, 3]


def test_no_files_warn_and_give_an_empty_frame(spark, folder):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        got = readers.read_json(spark, f"{folder}/*_none.json", "x INT, y STRING")
    assert seen and got.columns == ["x", "y"] and got.count() == 0


def test_malformed_json_fails(spark, folder):
    put(folder, "bad.json", '[{"x": 1}, {"x": ')
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_json(spark, f"{folder}/bad.json", "x INT").collect()


def test_health_explode(spark, folder):
    put(folder, "h.json", [
        {"calendarDate": "2024-01-01", "outliersCount": 2, "metrics": [{"type": "HRV", "value": 50, "status": "OK"}, {"type": "HR"}]},
        {"calendarDate": "2024-01-02"},
        {"calendarDate": "2024-01-03", "metrics": []},
    ])
    got = dicts(flatten.health_status(readers.read_json(spark, f"{folder}/h.json", schemas.HEALTH_DDL)))
    assert [(r["calendar_date"], r["metric_type"], r["value"], r["outliers_count"]) for r in got] == [
        ("2024-01-01", "HRV", 50.0, 2.0), ("2024-01-01", "HR", None, 2.0)
    ]


def test_daily_summary_lookups(spark, folder):
    stress = lambda *items: {"aggregatorList": [dict(zip(("type", "averageStressLevel"), i)) for i in items]}
    put(folder, "UDSFile_1.json", [
        {"calendarDate": "d1", "userProfilePK": 7, "allDayStress": stress(("TOTAL", 1), ("AWAKE", 5), ("TOTAL", 35.0)),
         "bodyBattery": {"chargedValue": 9, "bodyBatteryStatList": [
             {"statsValue": 1}, {"bodyBatteryStatType": "HIGHEST", "statsValue": 80}, {"bodyBatteryStatType": "HIGHEST", "statsValue": 90}]},
         "respiration": {"latestRespirationTimeGMT": "2024-01-01T00:00:00.0"}, "hydration": None},
        {"calendarDate": "d2", "userProfilePk": 8, "allDayStress": stress(("SLEEP", 1))},
        {"calendarDate": "d3"},
    ])
    with case_sensitive(spark):
        got = dicts(flatten.daily_summary(readers.read_json(spark, f"{folder}/UDSFile_*.json", schemas.DAILY_DDL)))
    assert [r["user_profile_pk"] for r in got] == [7, 8, None]
    assert [r["stress_avg_total"] for r in got] == [35.0, None, None]
    assert [r["stress_avg_awake"] for r in got] == [5.0, None, None]
    assert [r["body_battery_highest"] for r in got] == [90.0, None, None]
    assert got[0]["body_battery_charged"] == 9.0 and got[0]["hydration_goal_ml"] is None
    assert got[0]["latest_respiration_time_gmt"].startswith("2024")


def test_endurance_groups(spark, folder):
    put(folder, "e.json", [
        {"userProfilePk": 1, "calendarDate": 1704067200000, "timestamp": 1704067200500, "overallScore": 5000,
         "enduranceScoreContributor": [{"group": 0, "contribution": 1.5}, {"sport": "X", "contribution": 9.0}, {"group": 0, "contribution": 2.5},
                                       {"group": 8, "contribution": 3.0}]},
        {"userProfilePK": 2, "calendarDate": 1704067200000.0, "timestamp": 1.7040672E12},
    ])
    with case_sensitive(spark):
        got = dicts(flatten.endurance_score(readers.read_json(spark, f"{folder}/e.json", schemas.ENDURANCE_DDL)))
    assert [(r["user_profile_pk"], r["cycling_contribution"], r["running_contribution"], r["other_aerobic_contribution"]) for r in got] == [
        (1, 2.5, None, 3.0), (2, None, None, None)
    ]
    assert [r["calendar_date_ms"] for r in got] == [1704067200000] * 2


def test_envelope_and_nested_columns(spark, folder):
    put(folder, "1_summarizedActivities.json", [{"summarizedActivitiesExport": [
        {"activityId": 12345678901, "startTimeLocal": 1.5E12, "splits": [{"a": 1}], "avgHr": 140, "hrTimeInZone_3": 60000}]}, {"other": 1}])
    wrapped = readers.read_json(spark, f"{folder}/*.json", schemas.ACTIVITIES_DDL)
    got = dicts(flatten.device_activities(wrapped))
    assert len(got) == 1 and got[0]["activity_id"] == 12345678901 and got[0]["hr_time_in_zone_3"] == 60000.0
    inferred = readers.read_json(spark, f"{folder}/*.json", None)
    flat = flatten.flat_records(flatten.unwrap(inferred, "summarizedActivitiesExport"))
    assert sorted(flat.columns) == ["activity_id", "avg_hr", "hr_time_in_zone_3", "start_time_local"]


def some_value(rng, depth=0):
    kind = rng.randrange(8)
    if kind == 0 and depth < 3:
        return {f"k{i}": some_value(rng, depth + 1) for i in range(rng.randrange(4))}
    if kind == 1 and depth < 3:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    odd = ['a"b', "}{][", "\\", '\\\\"', "é}", '\\"}', "\n\t", ",[,", "", None, 1.5, True, -7]
    return rng.choice(odd) if kind < 5 else "s" * rng.randrange(40)


@pytest.mark.parametrize("range_bytes", ["250", "2000", "128m"])
def test_documents_split_into_elements(spark, folder, range_bytes):
    rng = random.Random(7)
    written = []
    for i, n in enumerate((0, 200, 1, 150, None, 90, 3)):
        data = {"id": "lone", "v": some_value(rng), "t": [{}]} if n is None else [{"id": f"{i}-{j}", "v": some_value(rng), "t": [some_value(rng)]} for j in range(n)]
        text = json.dumps(data, indent=i % 3 or None, ensure_ascii=i % 2 == 0)
        put(folder, f"day={i}/x.json", "\ufeff \r\n" + text + "\n " if i in (3, 4) else text)
        written += [(i, r) for r in ([data] if n is None else data)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = documents.elements(spark, f"{folder}/day=*", base_path=folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted((r["day"], json.dumps(json.loads(r["value"]), sort_keys=True)) for r in got) == sorted((d, json.dumps(r, sort_keys=True)) for d, r in written)


def test_large_documents_are_read_like_small_ones(spark, folder):
    rows = [{"x": i, "t": '}],[{"' * (i % 3), "n": {"a": [i, {"b": "]"}]}} for i in range(300)]
    # An object read as text keeps its white space only where the file is read whole.
    put(folder, "a.json", json.dumps(rows, separators=(",", ":")))
    put(folder, "b.json", {"x": -1, "t": None})
    put(folder, "c.json", [])
    ddl = "x INT, t STRING, n STRUCT<a: ARRAY<STRING>>"
    whole = readers.read_json(spark, f"{folder}/*.json", ddl)
    for limit in (0, 50, 10**9):
        split = readers.read_json(spark, f"{folder}/*.json", ddl, split_over=limit)
        assert split.columns == whole.columns and split.exceptAll(whole).isEmpty() and whole.exceptAll(split).isEmpty()


@pytest.mark.parametrize("text", ['[{"x": 1}, {"x": ', '[{"x": 1}', '[{"x": 1}, {"x": "a}]', '[{"x": 1}] {"x": 2}', '[{"x": 1}, nonsense]', '{"x": 1', '[{"x": 1}]}', '{"x": 1}}'])
def test_broken_documents_fail_when_split(spark, folder, text):
    put(folder, "bad.json", text)
    with pytest.raises(Exception, match="MALFORMED|ends too"):
        readers.read_json(spark, f"{folder}/bad.json", "x INT", split_over=0).collect()


def test_one_large_array_is_read_by_several_tasks(spark, folder):
    put(folder, "large.json", json.dumps([{"x": i, "t": "}" * 50} for i in range(20_000)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = documents.elements(spark, f"{folder}/large.json")
        tasks = got.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == 20_000 and len(tasks) > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_discovered_fields(spark, folder):
    put(folder, "a.json", [
        {"x": 1, "aB": 2.5, "c": "x", "n": {"z": 1}, "l": [1], "mixed": 1, "late": 1, "void": None, "flag": True},
        {"x": 35.0, "aB": 1, "c": None, "mixed": "t", "late": [1], "big": 2**62},
    ])
    put(folder, "b.json", {"x": 7, "ab": 3})
    want = {"aB": "double", "ab": "bigint", "big": "bigint", "c": "string", "flag": "boolean", "l": "nested", "late": "nested", "mixed": "string", "n": "nested",
            "void": "string", "x": "double"}
    assert discover.fields(spark, f"{folder}/*.json") == want
    assert discover.fields(spark, f"{folder}/*.json", split_over=0) == want
    put(folder, "lines/a.json", '{"e": [{"p": 1}, {"q": {}}]}\n{"e": []}\n{"other": 1}\n')
    assert discover.fields(spark, f"{folder}/lines", multi_line=False, envelope="e") == {"p": "bigint", "q": "nested"}
    assert discover.fields(spark, f"{folder}/lines", multi_line=False) == {"e": "nested", "other": "bigint"}


def test_extra_columns_get_free_names():
    found = {"score": "double", "Score": "bigint", "newField": "string", "new_field": "double", "list": "nested"}
    assert discover.extra_fields(found, ["score"], ["score"]) == [("Score", "score_2", "bigint"), ("newField", "new_field", "string"), ("new_field", "new_field_2", "double")]


HEADER = "Activity ID,Activity Date,Activity Name,Activity Type,Activity Description,Elapsed Time,Distance,Max Heart Rate,Relative Effort,Commute,Elapsed Time,Moving Time,Distance,Max Heart Rate,Relative Effort,Commute,Average Heart Rate"


def test_activity_csv(spark, folder):
    body = (
        '1,"May 6, 2018, 5:38:31 PM","Ride, ""long"" one",Ride,"two\nlines",100,10,,,false,101.0,90,10123.5,171.0,33.0,0.0,152.7\n'
        '2,"Jun 1, 2018, 6:00:00 AM",Run,Run,,50,5,150,10,true,51,50,5001,150,10,1.0,\n'
    )
    path = put(folder, "activities.csv", HEADER + "\n" + body)
    got = dicts(readers.read_activity_csv(spark, path))
    first = got[0]
    assert len(got) == 2
    assert first["activity_name"] == 'Ride, "long" one' and first["activity_description"] == "two\nlines"
    assert (first["distance_summary"], first["distance"]) == (10.0, 10123.5)
    assert (first["commute_summary"], first["commute"]) == (False, False) and got[1]["commute"] is True
    assert str(first["started_at"]) == "2018-05-06 17:38:31" and str(first["activity_date"]) == "2018-05-06"
    assert got[1]["average_heart_rate"] is None


@pytest.mark.parametrize("range_bytes", ["50", "300", "128m"])
def test_large_csv_is_read_in_ranges(spark, folder, range_bytes):
    import csv
    import io

    rng = random.Random(3)
    odd = ["", 'say "hi"', "two\nlines", "a,b", "\n\n", 'tail"\n', "plain", "\r\n inside", "é" * 20, '"']
    written = []
    for day, order in (("1", ["A", "B", "C"]), ("2", ["C", "A", "B"]), ("3", ["A", "B"])):
        text = io.StringIO()
        out = csv.writer(text, quoting=csv.QUOTE_ALL, lineterminator="\r\n" if day == "2" else "\n")
        out.writerow(order)
        for k in range(60):
            row = {"A": f"{day}-{k}", "B": rng.choice(odd), "C": rng.choice(odd)}
            out.writerow([row[c] for c in order])
            # Spark's CSV parser takes empty text for NULL.
            written.append((int(day), row["A"], row["B"] or None, (row["C"] or None) if "C" in order else None))
        path = f"{folder}/day={day}/a.csv"
        os.makedirs(os.path.dirname(path))
        with open(path, "w", newline="") as f:
            f.write(("\ufeff" if day == "3" else "") + text.getvalue() + ("\n" if day == "1" else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = readers._read_csv(spark, f"{folder}/day=*", folder)
        found = [(r["day"], r["a"], r["b"], r["c"]) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(found, key=repr) == sorted(written, key=repr)


def test_broken_csv_fails(spark, folder):
    path = put(folder, "a.csv", 'A,B\n1,"open\n2,x\n')
    with pytest.raises(Exception, match="ends inside quotes"):
        readers._read_csv(spark, path, None).collect()


def test_header_names():
    spark_names = ["A", "Distance1", "B2", "Distance3", "Col4"]
    assert readers.original_headers(spark_names) == ["A", "Distance", "B2", "Distance", "Col4"]
    assert readers.csv_names(["Distance", "Max Grade", "Distance"]) == ["distance_summary", "max_grade", "distance"]


def test_dataset_switch(monkeypatch):
    monkeypatch.setenv("USE_SYNTHETIC_DATA", "TRUE")
    assert tables.dataset_path("/x").endswith("demo")
    assert tables.dataset_path("/x", demo=False).endswith("personal")


def full_csv(rows):
    from trainlake.plans import contracts as C

    names = [f.raw for f in C.ACTIVITY_LOG if f.raw not in ("activity_date", "started_at")]
    head = ["Activity Date", *[n.replace("_", " ").title() for n in names]]
    lines = [",".join(head)]
    for r in rows:
        lines.append(",".join([f'"{r["date"]}"', *[str(r.get(n, "")) for n in names]]))
    return "\n".join(lines) + "\n"


def test_from_export_files_to_answers(spark, folder):
    """Files of two athletes in one folder each -> written lake -> queries."""
    base = os.path.join(folder, "exports")
    ms = lambda d, h=0: 1704067200000 + ((d - 1) * 24 + h) * 3600000
    for athlete, hr in ((1, 150), (2, 130)):
        home = f"{base}/athlete_id={athlete}"
        days = [f"2024-01-{d:02d}" for d in range(1, 11)]
        put(home, "DI-Connect-Aggregator/UDSFile_1.json", [{"calendarDate": d, "userProfilePK": athlete, "totalSteps": 1000 + athlete} for d in days])
        put(home, "DI-Connect-Wellness/1_sleepData.json", [
            {"calendarDate": days[0], "deepSleepSeconds": 3600, "lightSleepSeconds": 7200, "sleepScores": {"overallScore": 80}},
            {"calendarDate": days[1], "deepSleepSeconds": 1, "lightSleepSeconds": 1, "sleepWindowConfirmationType": "OFF_WRIST"}])
        put(home, "DI-Connect-Wellness/1_healthStatusData.json", [
            {"calendarDate": days[0], "metrics": [{"type": "HRV", "value": 55.5, "status": "BALANCED"}]}])
        put(home, "DI-Connect-Metrics/TrainingReadinessDTO_1.json", [
            {"calendarDate": days[0], "userProfilePK": athlete, "timestamp": f"{days[0]}T06:00:00.0", "level": "HIGH", "score": 70},
            {"calendarDate": days[0], "userProfilePK": athlete, "timestamp": f"{days[0]}T18:00:00.0", "level": "LOW", "score": 40},
            {"calendarDate": days[1], "userProfilePK": athlete, "timestamp": f"{days[1]}T06:00:00.0", "level": "HIGH", "score": 70},
            {"calendarDate": days[1], "userProfilePK": athlete, "timestamp": f"{days[1]}T18:00:00.0", "level": "NONE"},
            {"calendarDate": days[2], "userProfilePK": athlete, "timestamp": f"{days[2]}T18:00:00.0"}])
        put(home, "DI-Connect-Metrics/MetricsAcuteTrainingLoad_1.json", [
            {"calendarDate": ms(1), "timestamp": ms(1, 5), "acwrStatus": "NONE"},
            {"calendarDate": ms(1), "timestamp": ms(1, 9), "acwrStatus": "OPTIMAL", "dailyTrainingLoadAcute": 310.5}])
        put(home, "DI-Connect-Fitness/1_summarizedActivities.json", [{"summarizedActivitiesExport": [
            {"activityId": 500 + athlete, "activityType": "cycling", "startTimeLocal": ms(1, 10) + 60000, "startTimeGmt": ms(1, 8), "beginTimestamp": ms(1, 8),
             "avgPower": 201.5, "hrTimeInZone_2": 90000}]}])
        put(home, "activities.csv", full_csv([
            {"date": "Jan 1, 2024, 10:00:00 AM", "activity_id": 10 + athlete, "activity_type": "Ride", "activity_name": "Morning", "distance": 20000,
             "moving_time": 3600, "average_heart_rate": hr + 0.5, "average_watts": 180, "athlete_weight": 72, "commute": "false"},
            {"date": "Jan 5, 2024, 11:30:00 PM", "activity_id": 20 + athlete, "activity_type": "Run", "activity_name": "Night", "distance": 5000,
             "moving_time": 1500, "grade_adjusted_distance": 5100}]))
    keys = ("athlete_id",)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        raw = build.ingest(spark, f"{base}/athlete_id=*", f"{base}/athlete_id=*/activities.csv", keys, base_path=base)
    assert set(raw) == set(staging.STAGED)
    build.build(spark, raw, f"{folder}/lake", keys)
    lake = build.open_lake(spark, f"{folder}/lake", keys)

    assert lake.daily.count() == 20
    first = lake.daily.filter("athlete_id = 1 AND calendar_date = DATE '2024-01-01'").first()
    assert (first["readiness_score"], first["readiness_level"], first["total_sleep_s"], first["acute_load_7d"], first["hrv_ms"]) == (40, "LOW", 10800, 310, 55.5)
    later = lake.daily.filter("athlete_id = 2 AND calendar_date >= DATE '2024-01-02'").collect()
    assert all(r["readiness_level"] is None and r["total_sleep_s"] is None for r in later)

    ride = lake.ride.filter("athlete_id = 2").first()
    assert ride["garmin_activity_id"] == 502 and ride["garmin_match_type_compatible"] and ride["garmin_match_start_diff_s"] == 60.0
    assert ride["average_wkg"] == 2.5 and ride["garmin_avg_power_w"] == 201.5 and ride["hr_zone_2_s"] == 90.0
    assert ride["average_heart_rate_bpm"] == 130 and ride["readiness_level"] == "LOW"
    run = lake.run.filter("athlete_id = 1").first()
    assert run["late_start_utc_risk"] and not run["garmin_activity_matched"] and run["garmin_match_type_compatible"] is False
    assert run["pace_min_per_km"] == 5.0 and run["readiness_score"] is None

    answer = queries.query_activities(lake.activity, "ride", readiness_tier="low", limit=1).as_dict()
    assert answer["count"] == 2 and len(answer["activities"]) == 1 and answer["aggregates"]["avg_distance_km"] == 20.0
    assert "avg_garmin_training_load" not in answer["aggregates"]
    health = queries.query_daily_health(lake.daily, "2024-01-01", "2024-01-02", limit=5).as_dict()
    assert health["count"] == 4 and health["aggregates"]["avg_steps"] == 1002.0
    assert [d["calendar_date"] for d in health["days"]] == ["2024-01-02", "2024-01-02", "2024-01-01", "2024-01-01"]
    assert str(queries.newest_activity_day(lake.activity).first()[0]) == "2024-01-05"
    assert str(queries.newest_activity_day(lake.activity.limit(0)).first()[0]) == queries.FALLBACK_DAY

    found = series.metric_series(lake, "ride_power", "average_wkg", start_date="2024-01-01")
    assert found.summary() == {"summary": "Avg W/kg (2024-01-01 to 2024-01-01): 2 points, 2024-01-01 to 2024-01-01", "data_points": 2}
    with pytest.raises(series.SeriesError, match="No data"):
        series.metric_series(lake, "activity", "distance_km", "Yoga").summary()
    with pytest.raises(series.SeriesError, match="Unknown metric"):
        series.metric_series(lake, "health", "nope")
    with pytest.raises(series.SeriesError, match="Unknown chart_type"):
        series.metric_series(lake, "nope", "hrv_ms")


def test_a_failed_build_leaves_the_table(spark, folder):
    lake = f"{folder}/lake"
    tables.write_table(spark.range(5), lake, "raw", "t")
    running = tables.read_table(spark, lake, "raw", "t")
    broken = spark.range(0, 100, 1, 4).withColumn("id", F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("half-way")).cast("long")))
    with pytest.raises(Exception, match="half-way"):
        tables.write_table(broken, lake, "raw", "t")
    assert tables.read_table(spark, lake, "raw", "t").count() == 5
    assert sum(d.startswith("v-") for d in os.listdir(f"{lake}/raw/t")) == 1
    # A reader that has begun keeps its files over one replacement.
    assert tables.write_table(spark.range(7), lake, "raw", "t").count() == 7
    assert running.count() == 5 and tables.read_table(spark, lake, "raw", "t").count() == 7
    tables.write_table(tables.read_table(spark, lake, "raw", "t").filter("id < 3"), lake, "raw", "t")
    assert tables.read_table(spark, lake, "raw", "t").count() == 3
    assert sum(d.startswith("v-") for d in os.listdir(f"{lake}/raw/t")) == 2


def test_plain_folders_are_still_tables(spark, folder):
    spark.range(4).write.parquet(f"{folder}/lake/raw/t")
    assert tables.read_table(spark, f"{folder}/lake", "raw", "t").count() == 4
    tables.write_table(spark.range(9), f"{folder}/lake", "raw", "t")
    assert tables.read_tables(spark, f"{folder}/lake", "raw", ["t", "none"])["t"].count() == 9


def test_known_fields_are_not_looked_for(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x", "c": [1]}, {"b": 2}, [{"a": 3, "d": 4}], {}, 5]')
    for split_over in (64 << 20, 0):
        found = discover.fields(spark, str(tmp_path / "*.json"), split_over=split_over)
        assert found == {"a": "bigint", "b": "string", "c": "nested"}
        assert discover.fields(spark, str(tmp_path / "*.json"), split_over=split_over, known={"a", "z"}) == {"b": "string", "c": "nested"}
