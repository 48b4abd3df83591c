import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trainlake.operators.dedupe import latest_per_key
from trainlake.operators.filters import activity_conditions, all_of, complete_cases, not_in_or_null, present, where_all
from trainlake.operators.match import best_match
from trainlake.operators.ordered import RANGE_ROWS, ordered_counts, ranges, rolling_mean
from trainlake.operators.pivot import any_row, conditional_pivot
from trainlake.operators.spine import left_join_spine
from trainlake.operators.summary import day_span, latest_day, null_counts, present_metrics, row_counts, summarise
from trainlake.operators.topn import newest

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_per_key(spark):
    df = spark.createDataFrame(
        [("a", 1, 10), ("a", 3, 30), ("a", None, 99), ("b", None, 5), ("c", 2, 7), ("c", 2, 8)], "k string, t int, v int"
    )
    got = latest_per_key(df, ["k"], "t", [F.col("v").desc()])
    assert rows(got) == [("a", 3, 30), ("b", None, 5), ("c", 2, 8)]
    assert "WindowGroupLimit" in plan(got)


def test_pivot_and_flag(spark):
    df = spark.createDataFrame(
        [(1, "HRV", 5.0, "OK"), (1, "HRV", 7.0, None), (1, "HR", 3.0, "ONBOARDING"), (2, "SPO2", 9.0, "OK")],
        "d int, m string, v double, s string",
    )
    got = conditional_pivot(df, ["d"], "m", {"HRV": {"hrv": F.col("v")}, "HR": {"hr": F.col("v")}}, [any_row(F.col("s") == "ONBOARDING").alias("on")])
    assert rows(got) == [(1, True, 7.0, 3.0), (2, False, None, None)]


def test_filters(spark):
    df = spark.createDataFrame(
        [("Ride", "2024-01-02", "HIGH"), ("ride", "2024-01-05", None), ("Run", "2024-01-03", "high"), (None, "2024-01-03", "LOW")],
        "activity_type string, d string, readiness_level string",
    ).withColumn("activity_date", F.col("d").cast("date"))
    keep = lambda **a: where_all(df, activity_conditions(**a)).count()
    assert keep() == 4
    assert keep(sport_type="ALL") == 4
    assert keep(sport_type="RIDE") == 2
    assert keep(readiness_tier="High") == 2
    assert keep(start_date="2024-01-03", end_date="2024-01-05") == 3
    assert keep(sport_type="ride", readiness_tier="high", start_date="2024-01-02") == 1
    aliased = df.alias("fa").filter(all_of(activity_conditions("run", alias="fa")))
    assert aliased.count() == 1
    assert all_of([None, None]) is None
    assert df.filter(not_in_or_null(F.col("activity_type"), ["Ride", "Run"])).count() == 2


def test_present_and_complete(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 2), (float("nan"), 3)], "v double, i int")
    assert df.filter(present(F.col("v"))).count() == 1
    assert complete_cases(df, ["v"]).count() == 1


def spine_frames(spark):
    rng = random.Random(3)
    spine = [(rng.choice([1, 1, 1, 2, 3, None]), i) for i in range(300)] + [(4, 900)]
    left = spark.createDataFrame(spine, "k int, i int")
    unique = spark.createDataFrame([(1, "one"), (2, "two"), (9, "nine"), (None, "none")], "k int, a string")
    several = spark.createDataFrame([(1, 1.0), (1, 2.0), (3, 3.0)], "k int, b double")
    return left, unique, several


@pytest.mark.parametrize("hot_rows, broadcast_rows", [(None, 10), (20, 10), (20, 0), (5, 1)])
def test_spine_join_is_exact_under_hot_keys(spark, hot_rows, broadcast_rows):
    left, unique, several = spine_frames(spark)
    want = rows(left.join(unique, "k", "left").join(several, "k", "left"))
    got = left_join_spine(left, [unique, several], ["k"], hot_rows, broadcast_rows)
    assert rows(got) == want
    assert "NestedLoop" not in plan(got)
    one = left_join_spine(left, [unique], ["k"], hot_rows, broadcast_rows)
    assert one.count() == left.count()


def test_spine_join_measured_on_another_frame(spark):
    left, unique, _ = spine_frames(spark)
    got = left_join_spine(left, [unique], ["k"], 20, 10, measure=left.select("k"))
    assert rows(got) == rows(left.join(unique, "k", "left"))


def numbered(spark, n, groups=3):
    rng = random.Random(n)
    data = [(rng.randrange(groups), rng.randrange(n // 2 or 1), i, float(rng.randrange(1000))) for i in range(n)]
    return data, spark.createDataFrame(data, "g int, t int, i int, v double").repartition(5)


@pytest.mark.parametrize("series", [[], ["g"]])
@pytest.mark.parametrize("max_rows", [10**6, 40])
def test_ordered_counts(spark, series, max_rows):
    data, df = numbered(spark, 400)
    got = ordered_counts(df, [F.col("t").asc(), F.col("i").asc()], {"idx": F.lit(True), "even": F.col("v") % 2 == 0}, series, max_rows)
    want = []
    seen = {}
    for g, t, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        s = seen.setdefault(g if series else 0, [0, 0])
        want.append((g, t, i, v, s[0], s[1]))
        s[0] += 1
        s[1] += v % 2 == 0
    assert rows(got) == sorted(want, key=repr)


def test_ranges_do_not_grow_with_a_small_max_rows(spark):
    """Ranges, and so tasks, follow the rows per range, not ``max_rows``: 10**7 rows at max_rows=1000 made 20,000."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ranges(spark, 10**7) == max(shuffle, 2 * 10**7 // RANGE_ROWS)
    assert ranges(spark, 400) == shuffle
    data, df = numbered(spark, 400)
    got = ordered_counts(df, [F.col("t").asc(), F.col("i").asc()], {"idx": F.lit(True)}, [], 3)
    want = [(g, t, i, v, n) for n, (g, t, i, v) in enumerate(sorted(data, key=lambda r: (r[1], r[2])))]
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("points", [1, 2, 7, 28])
@pytest.mark.parametrize("max_rows", [10**6, 40, 3])
def test_rolling_mean(spark, points, max_rows):
    data, df = numbered(spark, 150, groups=2)
    got = rolling_mean(df, "v", points, [F.col("t").asc(), F.col("i").asc()], ["g"], max_rows=max_rows)
    want = []
    past = {}
    for g, t, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        p = past.setdefault(g, [])
        p.append(v)
        last = p[-points:]
        want.append((g, t, i, v, round(sum(last) / len(last) * 100) / 100 if len(last) >= max(1, points // 2) else None))
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("counted", [1, 150])
def test_rolling_mean_measured_on_another_frame(spark, counted):
    """A measure that says too little or enough changes the plan, not the result."""
    _, df = numbered(spark, 150, groups=2)
    order = [F.col("t").asc(), F.col("i").asc()]
    plain = rolling_mean(df, "v", 7, order, ["g"])
    for max_rows in (10**6, 40):
        got = rolling_mean(df, "v", 7, order, ["g"], max_rows=max_rows, measure=df.select("g").limit(counted))
        assert rows(got) == rows(plain)


def test_summaries(spark):
    df = spark.createDataFrame([("2024-01-03", 1.0, None), ("2024-01-01", float("nan"), None)], "d string, a double, b double")
    assert rows(null_counts(df, ["a", "b"])) == [(1, 2)]
    assert rows(day_span(df, "d")) == [("2024-01-01", "2024-01-03", 2)]
    assert str(latest_day(df.limit(0), "d", "2020-02-02").first()[0]) == "2020-02-02"
    one = summarise(df, "n", {"mean_b": F.avg("b"), "sum_a": F.sum(F.nanvl("a", F.lit(0.0)))})
    assert rows(present_metrics(one)) == [("n", 2.0), ("sum_a", 1.0)]
    assert rows(row_counts({"x": df, "y": df.limit(1)})) == [("x", 2), ("y", 1)]


def test_newest_is_a_top_k(spark):
    df = spark.range(1000).withColumn("day", (F.col("id") % 10).cast("int"))
    top = newest(df, "day", 3, ["id"])
    assert [r["id"] for r in top.collect()] == [999, 989, 979]
    assert "TakeOrderedAndProject" in plan(top)


# --- best match -----------------------------------------------------------------

FAMILIES = {"ride": (("Ride", "Gravel"), ("cycling", "road")), "run": (("Run",), ("running",))}
LEFT = "id long, athlete int, kind string, day date, at timestamp_ntz"
RIGHT = "rid long, athlete int, rkind string, rat timestamp_ntz, load double"


def match(spark, left, right, **args):
    names = dict(left_day="day", left_time="at", left_type="kind", right_id="rid", right_time="rat", right_type="rkind")
    got = best_match(
        spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), families=FAMILIES,
        payload={"load": "load"}, keys=["athlete"], **{**names, **args},
    )
    return {r["id"]: (r["match_id"], r["date_diff_days"], r["type_mismatch"], r["start_diff_s"], r["load"]) for r in got.collect()}


def brute(left, right, limit=None):
    family = lambda kind, side: next((n for n, m in FAMILIES.items() if kind in m[side]), None)
    out = {}
    for i, athlete, kind, day, at in left:
        best = None
        for rid, ra, rkind, rat, load in right:
            if ra != athlete or rat is None or day is None:
                continue
            gap = abs((rat.date() - day).days)
            secs = None if at is None else abs((rat - at).total_seconds())
            if gap > 1 or (limit is not None and (secs is None or secs > limit)):
                continue
            same = family(kind, 0) is not None and family(kind, 0) == family(rkind, 1)
            entry = (gap, 0 if same else 1, 0.0 if secs is None else secs, rid, load)
            best = entry if best is None or entry < best else best
        out[i] = (None,) * 5 if best is None else (best[3], best[0], best[1], best[2] if at else None, best[4])
    return out


def at(text):
    return datetime.fromisoformat(text)


def left_row(i, kind, when, athlete=1):
    t = at(when)
    return (i, athlete, kind, t.date(), t)


def test_match_rules(spark):
    left = [
        left_row(1, "Ride", "2024-01-01 23:50:00"),  # device row after midnight
        left_row(2, "Ride", "2024-01-10 10:00:00"),  # other type today beats same type tomorrow
        left_row(3, "Run", "2024-01-20 10:00:00"),  # same type 3 h away beats other type 1 min away
        left_row(4, "Run", "2024-02-20 10:00:00"),  # nothing near
        left_row(5, "Run", "2024-03-01 09:00:00"),  # two activities share one device row
        left_row(6, "Run", "2024-03-01 18:00:00"),
        left_row(7, "Chess", "2024-03-01 09:30:00"),  # type without family
        left_row(8, None, "2024-03-01 09:30:00", athlete=2),
        (9, 1, "Run", None, None),
    ]
    right = [
        (11, 1, "cycling", at("2024-01-02 00:05:00"), 1.0),
        (12, 1, "running", at("2024-01-10 20:00:00"), 2.0),
        (13, 1, "cycling", at("2024-01-11 00:10:00"), 3.0),
        (14, 1, "running", at("2024-01-20 13:00:00"), 4.0),
        (15, 1, "cycling", at("2024-01-20 10:01:00"), 5.0),
        (16, 1, "running", at("2024-03-01 09:00:00"), 6.0),
        (17, 1, "running", None, 7.0),
    ]
    got = match(spark, left, right)
    assert got == brute(left, right)
    assert got[1] == (11, 1, 0, 900.0, 1.0)
    assert got[2][0] == 12 and got[2][2] == 1
    assert got[3][0] == 14 and got[3][2] == 0
    assert got[4][0] is None and got[9][0] is None
    assert got[5][0] == got[6][0] == 16
    assert got[6][3] == 9 * 3600.0
    assert match(spark, left, right, max_diff_s=7200)[6][0] is None


@QUIET
@given(seed=st.integers(0, 10**6), slot=st.sampled_from([600, 3600, 86400]), limit=st.sampled_from([None, 4000]))
def test_match_equals_pairwise_ranking(spark, seed, slot, limit):
    rng = random.Random(seed)
    base = datetime(2024, 1, 1)

    def time():
        # Coarse steps make equal times and equal distances common.
        return base + timedelta(minutes=20 * rng.randrange(0, 3 * 72))

    left = []
    for i in range(40):
        t = time() if rng.random() > 0.1 else None
        # Some rows carry a day that is not the day of their start time.
        other = timedelta(days=rng.choice([-2, -1, 1]) if rng.random() < 0.2 else 0)
        day = (t or time()).date() + other if rng.random() > 0.05 else None
        left.append((i, rng.randrange(2), rng.choice(["Ride", "Gravel", "Run", "Chess", None]), day, t))
    right = [(100 + i, rng.randrange(2), rng.choice(["cycling", "road", "running", "golf", None]), time(), float(i)) for i in range(25)]
    got = match(spark, left, right, slot_s=slot, max_diff_s=limit)
    want = brute(left, right, limit)
    for i, row in enumerate(left):
        if row[4] is None and want[i][0] is not None:
            # Without a start time all rows of a day and type tie; any of them is right.
            assert got[i][1:4] == want[i][1:4]
        else:
            assert got[i] == want[i], row


def test_match_plan_has_no_pairwise_join(spark):
    left = spark.createDataFrame([left_row(1, "Ride", "2024-01-01 23:50:00")], LEFT)
    right = spark.createDataFrame([(11, 1, "cycling", at("2024-01-02 00:05:00"), 1.0)], RIGHT)
    got = best_match(
        left, right, left_day="day", left_time="at", left_type="kind", right_id="rid", right_time="rat", right_type="rkind",
        families=FAMILIES, payload={"load": "load"}, keys=["athlete"],
    )
    text = plan(got)
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(got.select("*")).count("Exchange hashpartitioning") <= 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_match_prefers_the_smallest_id_and_payload_of_equal_times(spark):
    left = [left_row(1, "Ride", "2024-01-01 10:00:00"), left_row(2, "Ride", "2024-01-01 10:00:00"), (3, None, "Run", None, None), (4, None, "Run", None, None)]
    when = at("2024-01-01 10:05:00")
    right = [(12, 1, "cycling", when, 9.0), (11, 1, "cycling", when, 8.0), (11, 1, "cycling", when, 7.0), (10, 1, "golf", when, 1.0), (11, 1, "cycling", when, None)]
    got = match(spark, left, right)
    # A missing payload is the smallest.
    assert got[1] == got[2] == (11, 0, 0, 300.0, None)
    assert got[3] == got[4] == (None,) * 5
    assert match(spark, left, right[:3])[1] == (11, 0, 0, 300.0, 7.0)
    assert match(spark, left, right[3:4])[1] == (10, 0, 1, 300.0, 1.0)
