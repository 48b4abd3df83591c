"""Queries that run single operators over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.functions import casts, metrics, names, scalars
from trainlake.operators import dedupe, filters, match, ordered, pivot, spine, summary, topn
from trainlake.plans import queries as plan_queries
from trainlake.session import scratch_path
from trainlake.sources import flatten, readers, tables
from trainlake.stats import gram, ols, report, ridge

from .inputs import DUCK_EV, spark_ev, table
from .export_files import write_json_lines
from .registry import query, times_as_text
from .ridge_sql import ridge_ctes

EV = f"WITH ev AS ({DUCK_EV})"
TYPES = ("click", "error", "purchase", "signup", "view")


# --- sources -----------------------------------------------------------------


@query("s1_json_array_scan", "SELECT o_orderkey, 'placed' AS step, o_totalprice AS amount, o_orderpriority FROM orders"
       " UNION ALL SELECT o_orderkey, 'paid', o_totalprice / 2, NULL FROM orders")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of records read back as rows; a field missing from a record is NULL."""
    orders = table(spark, sf_dir, "orders")

    def record(step: str, amount, priority) -> F.Column:
        return F.struct("o_orderkey", F.lit(step).alias("step"), amount.alias("amount"), priority.alias("o_orderpriority"))

    whole = record("placed", F.col("o_totalprice"), F.col("o_orderpriority"))
    half = record("paid", F.col("o_totalprice") / 2, F.lit(None).cast("string"))
    path = write_json_lines(orders, "orders-json", F.array(whole, half))
    return readers.read_json(spark, path, "o_orderkey BIGINT, step STRING, amount DOUBLE, o_orderpriority STRING", multi_line=False)


@query("s3_snake_case_names", "SELECT c_custkey AS cust_key, c_mktsegment AS mkt_segment5_k, c_acctbal AS acct_bal FROM customer")
def snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "customer").selectExpr("c_custkey AS custKey", "c_mktsegment AS `Mkt Segment5K`", "c_acctbal AS AcctBal")
    return names.snake_columns(wide)


@query("s7_drop_nested_columns", "SELECT vec_id, label FROM embeddings")
def drop_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.drop_nested(table(spark, sf_dir, "embeddings"))


@query(
    "s8_explode_long",
    """SELECT l_orderkey, l_linenumber, 'discount' AS kind, l_discount AS value FROM lineitem WHERE l_quantity >= 10
       UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem WHERE l_quantity >= 10""",
)
def explode_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per array element; rows without an array give none."""
    item = lambda k, c: F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"))
    nested = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") >= 10, F.array(item("discount", "l_discount"), item("tax", "l_tax"))).alias("parts")
    )
    return flatten.unwrap(nested, "parts", ["l_orderkey", "l_linenumber"])


@query(
    "s10_nan_to_null",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN l_discount END AS l_discount FROM lineitem",
)
def nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") >= 25, F.col("l_discount")).otherwise(F.lit(float("nan"))).alias("l_discount")
    )
    return casts.nan_to_null(raw)


@query(
    "s11_last_match_lookup",
    """SELECT o_orderkey, o_totalprice * 3 AS total, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS awake,
       CAST(NULL AS DOUBLE) AS absent FROM orders""",
)
def last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda k, v: F.struct(k.alias("type"), v.alias("level"))
    price = F.col("o_totalprice")
    awake = F.when(F.col("o_orderstatus") == "F", F.lit("AWAKE"))
    nested = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array(item(F.lit("TOTAL"), price), item(awake, price), item(F.lit("TOTAL"), price * 3)).alias("stats")
    )
    pick = lambda k: flatten.last_where("stats", "level", "type", k)
    return nested.select("o_orderkey", pick("TOTAL").alias("total"), pick("AWAKE").alias("awake"), pick("OTHER").alias("absent"))


@query(
    "s4_human_time",
    """SELECT event_id, CAST(date_trunc('second', ts) AS VARCHAR) AS started_at, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events""",
)
def human_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written times in two spellings, read back."""
    shown = F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format("ts", "MMM d, yyyy, h:mm:ss a")
    )
    parsed = table(spark, sf_dir, "events").select("event_id", casts.parse_human_time(shown).alias("started_at"))
    return times_as_text(parsed.withColumn("day", F.col("started_at").cast("date")))


GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("k3_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in GIVEN))
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.count_tables({t: table(spark, sf_dir, t) for t in GIVEN})


@query("k1_k2_s16_written_table", "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_totalprice FROM orders")
def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice (the second replaces the first), clustered by date, opened by path."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    lake = tables.dataset_path(scratch_path(spark, "lake"), demo=False)
    tables.write_table(orders.withColumn("o_totalprice", F.lit(0.0)), lake, "raw", "orders")
    tables.write_table(orders, lake, "raw", "orders", ["o_orderdate", "o_orderkey"])
    return times_as_text(tables.read_table(spark, lake, "raw", "orders"))


# --- dedupe, pivot, joins, match ----------------------------------------------


@query(
    "w1_latest_event_per_day",
    EV + """ SELECT user_id, CAST(day AS VARCHAR) AS day, event_id, event_type, value FROM ev
    QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id) = 1""",
)
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = dedupe.latest_per_key(spark_ev(spark, sf_dir), ["user_id", "day"], "ts", ["event_id"])
    return times_as_text(latest.select("user_id", "day", "event_id", "event_type", "value"))


_PIVOT = ", ".join(
    f"max(value) FILTER (WHERE event_type = '{t}') AS {t}_value, max(k) FILTER (WHERE event_type = '{t}') AS {t}_k" for t in TYPES
)


@query(
    "a1_a2_a3_event_pivot",
    EV + f" SELECT user_id, CAST(day AS VARCHAR) AS day, bool_or(event_type = 'error') AS any_error, {_PIVOT} FROM ev GROUP BY user_id, day",
)
def event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = {t: {f"{t}_value": F.col("value"), f"{t}_k": F.col("k")} for t in TYPES}
    extra = [pivot.any_row(F.col("event_type") == "error").alias("any_error")]
    return times_as_text(pivot.conditional_pivot(spark_ev(spark, sf_dir), ["user_id", "day"], "event_type", picks, extra))


def _event_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User days with click, purchase (not unique) and error figures beside them."""
    ev = spark_ev(spark, sf_dir)
    on = ["user_id", "day"]
    days = ev.groupBy(*on).agg(F.count("*").alias("events"))
    clicks = ev.filter("event_type = 'click'").groupBy(*on).agg(F.max("value").alias("click_max"))
    buys = ev.filter("event_type = 'purchase'").select(*on, F.col("value").alias("buy_value"))
    errors = ev.filter("event_type = 'error'").groupBy(*on).agg(F.min("k").alias("error_k"))
    return spine.left_join_spine(days, [clicks, buys, errors], on)


_SPINE = """spine AS (SELECT d.user_id, d.day, events, click_max, b.value AS buy_value, error_k
    FROM (SELECT user_id, day, count(*) AS events FROM ev GROUP BY ALL) d
    LEFT JOIN (SELECT user_id, day, max(value) AS click_max FROM ev WHERE event_type = 'click' GROUP BY ALL) c USING (user_id, day)
    LEFT JOIN (SELECT user_id, day, value FROM ev WHERE event_type = 'purchase') b USING (user_id, day)
    LEFT JOIN (SELECT user_id, day, min(k) AS error_k FROM ev WHERE event_type = 'error' GROUP BY ALL) e USING (user_id, day))"""


@query("j1_j6_event_day_spine", f"{EV}, {_SPINE} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM spine")
def event_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(_event_spine(spark, sf_dir))


@query(
    "f13_f10_spine_complete_cases",
    f"{EV}, {_SPINE} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM spine WHERE click_max IS NOT NULL AND error_k IS NOT NULL AND buy_value > 20",
)
def spine_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = filters.complete_cases(_event_spine(spark, sf_dir), ["click_max", "error_k"])
    return times_as_text(whole.filter(filters.present(F.col("buy_value")) & (F.col("buy_value") > 20)))


@query(
    "j2_day_context_join",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, d.orders, d.revenue
       FROM lineitem l LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
       FROM orders GROUP BY ALL) d ON d.day = CAST(l_shipdate AS DATE)""",
)
def day_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.count("*").alias("orders"), scalars.round_dp(F.sum("o_totalprice"), 2).alias("revenue"))
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
    return times_as_text(spine.left_join_spine(lines, [days], ["day"]))


_FAMILIES = {"look": (("click",), ("view",))}
_EVENT_MATCH = """
    SELECT c.event_id, c.value AS click_value, m.match_id, m.day_gap AS date_diff_days, m.mismatch AS type_mismatch,
           m.gap_s AS start_diff_s, m.match_value
    FROM ev c LEFT JOIN (
      SELECT c.event_id, o.event_id AS match_id, CAST(abs(date_diff('day', c.day, o.day)) AS INTEGER) AS day_gap,
             CASE WHEN o.event_type = 'view' THEN 0 ELSE 1 END AS mismatch,
             abs(epoch_us(c.ts) - epoch_us(o.ts)) / 1e6 AS gap_s, o.value AS match_value
      FROM ev c JOIN ev o ON o.user_id = c.user_id AND o.day BETWEEN c.day - 1 AND c.day + 1
      WHERE c.event_type = 'click' AND o.event_type IN ('view', 'purchase') {limit}
      QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY day_gap, mismatch, gap_s, match_id) = 1) m USING (event_id)
    WHERE c.event_type = 'click'"""


def _event_match(spark: SparkSession, sf_dir: str, **args) -> DataFrame:
    ev = spark_ev(spark, sf_dir)
    return match.best_match(
        ev.filter("event_type = 'click'").select("event_id", "user_id", "event_type", "ts", "day", F.col("value").alias("click_value")),
        ev.filter("event_type IN ('view', 'purchase')"),
        left_day="day", left_time="ts", left_type="event_type",
        right_id="event_id", right_time="ts", right_type="event_type",
        families=_FAMILIES, payload={"value": "match_value"}, keys=["user_id"], **args,
    ).select("event_id", "click_value", "match_id", "date_diff_days", "type_mismatch", "start_diff_s", "match_value")


@query("j3_j4_j5_w2_best_match", EV + _EVENT_MATCH.format(limit=""))
def event_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_match(spark, sf_dir)


@query("j4_best_match_within_two_hours", EV + _EVENT_MATCH.format(limit="AND gap_s <= 7200"))
def event_match_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_match(spark, sf_dir, max_diff_s=7200)


@query(
    "e8_type_compatibility",
    """SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'look' WHEN 'view' THEN 'look' WHEN 'purchase' THEN 'buy'
       WHEN 'signup' THEN 'buy' END AS family FROM events""",
)
def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = scalars.member_of(F.col("event_type"), {"look": ("click", "view"), "buy": ("purchase", "signup")})
    return table(spark, sf_dir, "events").select("event_id", "event_type", family.alias("family"))


# --- filters, summaries, ordered extracts --------------------------------------


@query(
    "f1_f2_f5_f16_status_filters",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice > 200000 AS large, hour(o_orderdate) >= 22 AS late
       FROM orders WHERE coalesce(nullif(o_orderstatus, 'O'), '') NOT IN ('P') AND o_orderpriority <> '5-LOW'
       AND o_orderpriority IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED')""",
)
def status_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NULL status passes the first test, a NULL priority fails the second."""
    status = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    kept = filters.where_all(
        table(spark, sf_dir, "orders"),
        [
            filters.not_in_or_null(status, ["P"]),
            F.col("o_orderpriority") != "5-LOW",
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "4-NOT SPECIFIED"),
        ],
    )
    return kept.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_totalprice") > 200000).alias("large"),
        metrics.starts_late(F.col("o_orderdate")).alias("late"),
    )


_SALES = "SELECT * FROM orders JOIN customer ON c_custkey = o_custkey WHERE lower(c_mktsegment) = 'building'" \
    " AND CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND upper(o_orderpriority) = '2-HIGH'"


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")
    ).withColumnsRenamed({"c_mktsegment": "activity_type", "o_orderpriority": "readiness_level"}).withColumn(
        "activity_date", F.col("o_orderdate").cast("date")
    )
    return filters.where_all(sold, filters.activity_conditions("BUILDING", "1997-01-01", "1999-12-31", "2-high"))


@query(
    "f6_f7_f8_f9_f15_a4_a5_order_summary",
    f"""SELECT count(*) AS n_orders, round(avg(o_totalprice), 2) AS avg_price, round(avg(c_acctbal) / 60, 1) AS avg_balance_60
        FROM ({_SALES})""",
)
def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summarise(
        _sales(spark, sf_dir), "n_orders",
        {"avg_price": scalars.round_dp(F.avg("o_totalprice"), 2), "avg_balance_60": scalars.round_dp(F.avg("c_acctbal") / F.lit(60.0), 1)},
    )


@query(
    "t1_newest_orders",
    f"""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, round(o_totalprice / 1000, 1) AS price_k
        FROM ({_SALES}) ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC LIMIT 100""",
)
def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = topn.newest(_sales(spark, sf_dir), "activity_date", 100, ["o_orderkey"])
    return top.select("o_orderkey", scalars.iso_day(F.col("activity_date")).alias("date"), scalars.round_dp(scalars.to_km(F.col("o_totalprice")), 1).alias("price_k"))


@query("t3_ascending_series", "SELECT event_id, CAST(ts AS VARCHAR) AS ts, value FROM events ORDER BY ts, event_id")
def ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(topn.ascending(table(spark, sf_dir, "events").select("event_id", "ts", "value"), "ts", "event_id"))


@query(
    "a7_present_metrics",
    """SELECT * FROM (SELECT CAST(count(*) AS DOUBLE) AS n_lines, round(avg(l_quantity), 4) AS avg_quantity,
       round(avg(CASE WHEN l_quantity > 1000 THEN l_tax END), 2) AS avg_never FROM lineitem)
       UNPIVOT (value FOR metric IN (n_lines, avg_quantity, avg_never))""",
)
def present_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = {
        "avg_quantity": scalars.round_dp(F.avg("l_quantity"), 4),
        "avg_never": scalars.round_dp(F.avg(F.when(F.col("l_quantity") > 1000, F.col("l_tax"))), 2),
    }
    return summary.present_metrics(summary.summarise(table(spark, sf_dir, "lineitem"), "n_lines", means))


@query("a8_latest_order_day", "SELECT CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS latest_day FROM orders")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(summary.latest_day(table(spark, sf_dir, "orders"), "o_orderdate", plan_queries.FALLBACK_DAY))


@query(
    "a9_a11_event_span",
    "SELECT CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_day, count(*) AS points FROM events",
)
def event_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(summary.day_span(spark_ev(spark, sf_dir), "day"))


@query(
    "a10_spine_null_counts",
    f"{EV}, {_SPINE} SELECT count(*) - count(click_max) AS click_max, count(*) - count(buy_value) AS buy_value, count(*) - count(error_k) AS error_k FROM spine",
)
def spine_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.null_counts(_event_spine(spark, sf_dir), ["click_max", "buy_value", "error_k"])


@query(
    "a12_mean_and_spread",
    "SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd_pop, round(stddev_samp(value), 6) AS sd_samp FROM events",
)
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = gram.moments(table(spark, sf_dir, "events"), ["value"])
    ss = float(stats.scatter[0, 0])
    row = (float(stats.mean[0]), float(np.sqrt(ss / stats.n)), float(np.sqrt(ss / (stats.n - 1))))
    return spark.createDataFrame([tuple(round(v, 6) for v in row)], "mean double, sd_pop double, sd_samp double")


_CENTS = "CAST(round(value * 100) AS DOUBLE)"


@query(
    "w3_rolling_mean_per_user",
    EV + f""" SELECT event_id, user_id, cents, CASE WHEN count(*) OVER w >= 3 THEN round_even(avg(cents) OVER w * 100, 0) / 100 END AS rolling
    FROM (SELECT event_id, user_id, ts, {_CENTS} AS cents FROM ev)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def rolling_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = spark_ev(spark, sf_dir).select("event_id", "user_id", "ts", F.round(F.col("value") * 100, 0).alias("cents"))
    order = [F.col("ts").asc(), F.col("event_id").asc()]
    return ordered.rolling_mean(cents, "cents", 7, order, ["user_id"]).drop("ts")


@query(
    "w3_rolling_mean_one_long_series",
    EV + f""" SELECT event_id, cents, CASE WHEN count(*) OVER w >= 14 THEN round_even(avg(cents) OVER w * 100, 0) / 100 END AS rolling
    FROM (SELECT event_id, ts, {_CENTS} AS cents FROM ev)
    WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)""",
)
def rolling_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series over all rows, cut into ranges so that no task holds all of it."""
    cents = spark_ev(spark, sf_dir).select("event_id", "ts", F.round(F.col("value") * 100, 0).alias("cents"))
    order = [F.col("ts").asc(), F.col("event_id").asc()]
    return ordered.rolling_mean(cents, "cents", 28, order, max_rows=1000).drop("ts")


# --- scalar expressions ----------------------------------------------------------


@query(
    "e1_rounding_casts",
    """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS INTEGER) AS price_int, CAST(l_quantity / 2 AS INTEGER) AS half_even,
       CAST(l_extendedprice * 1000 AS BIGINT) AS price_big, CAST(CAST(l_quantity / 2 AS VARCHAR) AS INTEGER) AS half_away,
       CAST(CAST(l_orderkey AS VARCHAR) AS BIGINT) AS key_text FROM lineitem""",
)
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, text = T.DoubleType(), T.StringType()
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        casts.convert("l_extendedprice", number, "int", "price_int"),
        casts.convert("l_quantity / 2", number, "int", "half_even"),
        casts.convert("l_extendedprice * 1000", number, "bigint", "price_big"),
        casts.convert("string(l_quantity / 2)", text, "int", "half_away"),
        casts.convert("string(l_orderkey)", text, "bigint", "key_text"),
    )


@query(
    "e2_e3_time_conversions",
    EV + """ SELECT event_id, CAST(make_timestamp(ms * 1000) AS VARCHAR) AS at, CAST(CAST(make_timestamp(ms * 1000) AS DATE) AS VARCHAR) AS day,
    CAST(ts AS VARCHAR) AS from_text, k >= 50 AS flag FROM ev""",
)
def time_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = casts.epoch_ms(F.col("ms"))
    text = T.StringType()
    written = spark_ev(spark, sf_dir).withColumns(
        {
            "written": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            "said": F.when(F.col("k") >= 50, "true").otherwise("0.0"),
        }
    )
    return times_as_text(
        written.select(
            "event_id", at.alias("at"), at.cast("date").alias("day"),
            casts.convert("written", text, "timestamp", "from_text"), casts.convert("said", text, "boolean", "flag"),
        )
    )


@query(
    "e4_e5_e6_e7_time_arithmetic",
    """SELECT l_orderkey, l_linenumber, abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 AS seconds,
       CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS INTEGER) AS days,
       CAST(CAST(o_orderdate AS DATE) - 1 AS VARCHAR) AS day_before, CAST(hour(l_shipdate) AS INTEGER) AS hour
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def time_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    ship, placed = F.col("l_shipdate"), F.col("o_orderdate")
    return both.select(
        "l_orderkey", "l_linenumber",
        scalars.seconds_between(ship, placed).alias("seconds"),
        scalars.day_gap(placed, ship).alias("days"),
        scalars.iso_day(F.date_sub(placed.cast("date"), 1)).alias("day_before"),
        F.hour(ship).alias("hour"),
    )


@query(
    "e9_e10_e11_e12_guards_and_tiers",
    f"{EV}, {_SPINE}" + """ SELECT user_id, CAST(day AS VARCHAR) AS day, buy_value, round(click_max / nullif(error_k, 0), 6) AS ratio,
    CASE WHEN buy_value > 10 THEN click_max END AS guarded,
    CASE WHEN ifnull(click_max, 50) > 70 THEN 'PRIME' WHEN ifnull(click_max, 50) > 55 THEN 'MODERATE' ELSE 'LOW' END AS tier FROM spine""",
)
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_as_text(
        _event_spine(spark, sf_dir).select(
            "user_id", "day", "buy_value",
            scalars.round_dp(scalars.safe_divide(F.col("click_max"), F.col("error_k")), 6).alias("ratio"),
            scalars.guarded(F.col("buy_value") > 10, F.col("click_max")).alias("guarded"),
            scalars.tier_bucket(F.col("click_max")).alias("tier"),
        )
    )


@query(
    "e13_e14_e16_rounding_and_units",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice / 1000, 2) AS km, round(l_quantity * 3.6e0, 1) AS kph,
       round(l_quantity / 60, 1) AS minutes, round(l_discount * 100, 0) AS percent, round(l_quantity / 3600, 2) AS hours,
       round_even(l_quantity * l_discount * 100, 0) / 100 AS even, lower(l_returnflag) AS flag, upper(l_linestatus) AS status FROM lineitem""",
)
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity, r = F.col("l_quantity"), scalars.round_dp
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        r(scalars.to_km(F.col("l_extendedprice")), 2).alias("km"),
        r(scalars.to_kph(quantity), 1).alias("kph"),
        r(scalars.to_minutes(quantity), 1).alias("minutes"),
        r(scalars.to_percent(F.col("l_discount")), 0).alias("percent"),
        r(scalars.to_hours(quantity), 2).alias("hours"),
        scalars.round_dp_even(quantity * F.col("l_discount"), 2).alias("even"),
        F.lower("l_returnflag").alias("flag"), F.upper("l_linestatus").alias("status"),
    )


@query(
    "e17_e18_weather_and_dummies",
    EV + """ SELECT event_id, CASE WHEN event_type <> 'view' AND value > 50 THEN 'rainy' WHEN k > 65 THEN 'overcast' ELSE 'clear' END AS weather,
    CASE WHEN NOT (event_type <> 'view' AND value > 50) AND k > 65 THEN 1e0 ELSE 0e0 END AS w_overcast FROM ev""",
)
def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rain is NaN for views, which must not count as rain."""
    rain = F.when(F.col("event_type") == "view", F.lit(float("nan"))).otherwise(F.col("value") / 1000)
    category = scalars.weather_category(rain, F.col("k") / 100)
    return spark_ev(spark, sf_dir).select("event_id", category.alias("weather")).withColumn("w_overcast", scalars.dummy(F.col("weather"), "overcast"))


@query(
    "e19_rows_as_json",
    """SELECT json_object('o_orderkey', o_orderkey, 'o_orderstatus', nullif(o_orderstatus, 'P'), 'day', CAST(CAST(o_orderdate AS DATE) AS VARCHAR))::VARCHAR AS row
       FROM orders""",
)
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"), scalars.iso_day(F.col("o_orderdate")).alias("day")
    )
    return plan_queries.Answer(rows, rows, "n", "rows").rows_as_json()


@query(
    "f14_repaired_dates",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN coalesce(try_strptime(strftime(o_orderdate, '%Y-%d-%m'), '%Y-%m-%d'),
       try_strptime(strftime(o_orderdate, '%Y-%d-%m'), '%Y-%d-%m')) WHEN o_orderstatus = 'O' THEN o_orderdate END AS DATE)::VARCHAR AS day FROM orders""",
)
def repaired_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-day-month where month-first fails; unreadable text is NULL."""
    shown = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-dd-MM"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    )
    return times_as_text(table(spark, sf_dir, "orders").select("o_orderkey", casts.repair_date_column(shown).alias("day")))


_MILE = "CAST(1.60934 AS DOUBLE)"


@query(
    "m1_m2_m3_m7_m12_part_metrics",
    f"""SELECT p_partkey, p_size + p_size + ifnull(nullif(p_size, 7), 0) AS total, round(p_retailprice / 1000, 6) AS km,
        round(p_retailprice * 3.6e0 / {_MILE}, 6) AS mph, -p_retailprice AS speed, round((p_retailprice - p_size) / 3600000, 9) AS offset_h FROM part""",
)
def part_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        metrics.total_sleep_s(size, size, F.when(size != 7, size)).alias("total"),
        scalars.round_dp(scalars.to_km(price), 6).alias("km"),
        scalars.round_dp(metrics.kph_to_mph(scalars.to_kph(price)), 6).alias("mph"),
        metrics.speed_from_pace(price).alias("speed"),
        scalars.round_dp(metrics.utc_offset_h(price, size), 9).alias("offset_h"),
    )


@query(
    "m4_m5_m6_m8_ratio_metrics",
    f"""SELECT l_orderkey, l_linenumber, round(if(l_discount > 0, l_extendedprice / l_discount, NULL), 4) AS per_kg,
        round(if(l_tax > 0 AND l_discount > 0, l_discount / l_tax, NULL), 6) AS per_bpm,
        round(if(l_discount > 0, l_quantity / 60 / l_discount, NULL), 6) AS pace_km,
        round(if(l_discount > 0, l_quantity / 60 / (l_discount / {_MILE}), NULL), 6) AS pace_mile,
        round(if(l_tax > 0, l_quantity / 60 / (l_tax / 1000), NULL), 6) AS graded,
        round(if(l_tax > 0 AND l_discount > 0, l_quantity / 60 / l_discount / l_tax, NULL), 4) AS pace_bpm,
        round(l_extendedprice / 60 / CAST(42.195 AS DOUBLE), 2) AS marathon FROM lineitem""",
)
def ratio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t, price = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))
    r = scalars.round_dp
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        r(metrics.watts_per_kg(price, d), 4).alias("per_kg"),
        r(metrics.watts_per_bpm(d, t), 6).alias("per_bpm"),
        r(metrics.pace_min_per_km(q, d), 6).alias("pace_km"),
        r(metrics.pace_min_per_mile(q, d), 6).alias("pace_mile"),
        r(metrics.graded_pace_min_per_km(q, t), 6).alias("graded"),
        r(metrics.pace_per_bpm(q, d, t), 4).alias("pace_bpm"),
        metrics.predicted_pace(price, "marathon").alias("marathon"),
    )


# --- regression --------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")


@query(
    "r2_ols_one_predictor",
    """SELECT count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem""",
)
def ols_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = ols.fit_ols(_lines(spark, sf_dir), ["l_quantity"], "l_extendedprice")
    row = (fit.n, round(float(fit.beta[0]), 4), round(float(fit.beta[1]), 6), round(fit.r2, 9))
    return spark.createDataFrame([row], "n long, intercept double, slope double, r2 double")


_TWO = """
    m AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my, CAST(count(*) AS DOUBLE) AS n FROM lineitem),
    c AS (SELECT l_quantity - ma AS a, l_discount - mb AS b, l_extendedprice - my AS y FROM lineitem, m),
    g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy, sum(y * y) AS yy FROM c),
    i AS (SELECT bb / (aa * bb - ab * ab) AS iaa, -ab / (aa * bb - ab * ab) AS iab, aa / (aa * bb - ab * ab) AS ibb FROM g),
    s AS (SELECT iaa * ay + iab * byy AS ba, iab * ay + ibb * byy AS bb_ FROM g, i),
    e AS (SELECT a, b, y - a * ba - b * bb_ AS r, 1 / n + a * a * iaa + 2 * a * b * iab + b * b * ibb AS h FROM c, m, i, s),
    w AS (SELECT a, b, (r / (1 - h)) * (r / (1 - h)) AS w FROM e),
    meat AS (SELECT sum(a * a * w) AS maa, sum(a * b * w) AS mab, sum(b * b * w) AS mbb FROM w),
    v AS (SELECT iaa * (iaa * maa + iab * mab) + iab * (iaa * mab + iab * mbb) AS va,
                 iab * (iab * maa + ibb * mab) + ibb * (iab * mab + ibb * mbb) AS vb FROM i, meat)
"""


def _two(spark: SparkSession, sf_dir: str) -> ols.OlsFit:
    return ols.fit_ols(_lines(spark, sf_dir), ["l_quantity", "l_discount"], "l_extendedprice")


@query(
    "r2_r3_ols_two_predictors_hc3",
    f"""WITH {_TWO} SELECT 'Intercept' AS term, round(my - ba * ma - bb_ * mb, 3) AS coef, CAST(NULL AS DOUBLE) AS std_err FROM m, s
        UNION ALL SELECT 'l_quantity', round(ba, 3), round(sqrt(va), 3) FROM s, v
        UNION ALL SELECT 'l_discount', round(bb_, 3), round(sqrt(vb), 3) FROM s, v""",
)
def ols_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = _two(spark, sf_dir)
    rows = [(t, round(float(b), 3), None if t == ols.INTERCEPT else round(float(se), 3)) for t, b, se in zip(fit.names, fit.beta, fit.std_err)]
    return spark.createDataFrame(rows, "term string, coef double, std_err double")


@query(
    "r2_ols_line_one_predictor",
    """WITH m AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice) AS my, CAST(count(*) AS DOUBLE) AS n FROM lineitem),
       c AS (SELECT l_quantity - ma AS a, l_extendedprice - my AS y FROM lineitem, m),
       g AS (SELECT sum(a * a) AS aa, sum(a * y) AS ay, sum(y * y) AS yy FROM c),
       e AS (SELECT a, y - a * ay / aa AS r, 1 / n + a * a / aa AS h FROM c, m, g),
       v AS (SELECT sum(a * a * power(r / (1 - h), 2)) AS meat FROM e)
       SELECT round(1 - (1 - ay * ay / aa / yy) * (n - 1) / (n - 2), 10) AS r2_adj, round((ay / aa) / (sqrt(meat) / aa), 6) AS z,
              round(power((ay / aa) / (sqrt(meat) / aa), 2), 6) AS f_value FROM m, g, v""",
)
def ols_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted R2, z of the slope, and the Wald F, which is its square."""
    fit = ols.fit_ols(_lines(spark, sf_dir), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(fit.r2_adj, 10), round(float(fit.z[1]), 6), round(fit.f_value, 6))], "r2_adj double, z double, f_value double")


@query(
    "r6_vif",
    """SELECT unnest(['l_quantity', 'l_discount']) AS term, round(1 / (1 - power(corr(l_quantity, l_discount), 2)), 9) AS vif FROM lineitem""",
)
def vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, round(float(v), 9)) for t, v in ols.variance_inflation(_two(spark, sf_dir)).items()]
    return spark.createDataFrame(rows, "term string, vif double")


@query(
    "r7_t4_standardised_coefficients",
    f"""WITH {_TWO} SELECT 'l_quantity' AS term, round(ba * sqrt(aa / yy), 8) AS beta, round((ba - 1.959963984540054e0 * sqrt(va)) * sqrt(aa / yy), 8) AS low,
        round((ba + 1.959963984540054e0 * sqrt(va)) * sqrt(aa / yy), 8) AS high FROM g, s, v
        UNION ALL SELECT 'l_discount', round(bb_ * sqrt(bb / yy), 8), round((bb_ - 1.959963984540054e0 * sqrt(vb)) * sqrt(bb / yy), 8),
        round((bb_ + 1.959963984540054e0 * sqrt(vb)) * sqrt(bb / yy), 8) FROM g, s, v""",
)
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, *(round(float(v), 8) for v in (b, lo, hi))) for t, _, b, lo, hi, _, _ in report.standardised(_two(spark, sf_dir))]
    return topn.ascending(spark.createDataFrame(rows, "term string, beta double, low double, high double"), "beta")


@query(
    "r2_gram_entries",
    """SELECT * FROM (SELECT unnest([
       {'row_name': 'intercept', 'col_name': 'intercept', 'value': CAST(count(*) AS DOUBLE)},
       {'row_name': 'intercept', 'col_name': 'l_quantity', 'value': round(sum(l_quantity), 2)},
       {'row_name': 'intercept', 'col_name': 'l_discount', 'value': round(sum(l_discount), 2)},
       {'row_name': 'l_quantity', 'col_name': 'l_quantity', 'value': round(sum(l_quantity * l_quantity), 2)},
       {'row_name': 'l_quantity', 'col_name': 'l_discount', 'value': round(sum(l_quantity * l_discount), 2)},
       {'row_name': 'l_discount', 'col_name': 'l_discount', 'value': round(sum(l_discount * l_discount), 2)}], recursive := true) FROM lineitem)""",
)
def gram_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram.gram_entries(_lines(spark, sf_dir), ["l_quantity", "l_discount"]).withColumn("value", scalars.round_dp(F.col("value"), 2))


# --- ridge with nested cross-validation ----------------------------------------------

# Day, id, two predictors and two targets; prices follow quantity, so that scores are not all noise.
_RIDGE_ROWS = """SELECT l_orderkey || ':' || l_linenumber AS id, l_shipdate AS day, {a} AS a, {b} AS b, {y} AS y FROM lineitem"""
_MODELS = {"A": ("l_quantity",), "B": ("l_quantity", "l_discount")}
_TARGETS = {"price": "l_extendedprice + 500 * l_quantity", "cost": "l_extendedprice * l_discount"}


def _ridge_rows(model: str, target: str) -> str:
    names = _MODELS[model]
    return _RIDGE_ROWS.format(a=names[0], b=names[1] if len(names) > 1 else "0e0", y=_TARGETS[target])


def _ridge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [F.expr(sql).alias(n) for n, sql in _TARGETS.items()]
    return table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", *targets)


_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber")


@query(
    "r4_ridge_nested_cv",
    f"""WITH {ridge_ctes(_ridge_rows("B", "price"))}
        SELECT k::INTEGER AS fold, round(r2, 7) AS r2, round(alpha, 6) AS alpha FROM scored""",
)
def ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and chosen penalty per outer fold over all lines; fold 5 is the final fit on all of them."""
    fit = ridge.fit_ridge(_ridge_lines(spark, sf_dir), _MODELS["B"], "price", _ORDER)
    rows = [(k, round(float(s), 7), round(float(a), 6)) for k, (s, a) in enumerate(zip(fit.scores, fit.fold_alphas))]
    return spark.createDataFrame([*rows, (5, None, round(fit.best_alpha, 6))], "fold int, r2 double, alpha double")


_OLS_R2 = """(SELECT (saa * sby * sby - 2 * sab * say * sby + sbb * say * say) / nullif(saa * sbb - sab * sab, 0) / syy FROM
    (SELECT var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, var_pop(y) AS syy FROM given{t}))"""


def _model_line(model: str, target: str, tag: str) -> str:
    r2 = f"(SELECT regr_r2(y, a) FROM given{tag})" if len(_MODELS[model]) == 1 else _OLS_R2.format(t=tag)
    return f"""SELECT '{model}' AS model, '{target}' AS target, (SELECT count(*) FROM given{tag}) AS n, round({r2}, 6) AS ols_r2,
        round(avg(r2), 6) AS cv_r2, round(stddev_pop(r2), 6) AS cv_r2_sd, round(max(alpha) FILTER (WHERE k = 5), 4) AS best_alpha FROM scored{tag}"""


def _fits(spark: SparkSession, sf_dir: str, target: str) -> dict[str, report.ModelFit]:
    lines = _ridge_lines(spark, sf_dir)
    return {m: report.fit_model(lines, names, target, m, order=_ORDER) for m, names in _MODELS.items()}


@query(
    "r5_nested_feature_sets",
    "WITH " + ", ".join(ridge_ctes(_ridge_rows(m, "price"), f"_{m}") for m in _MODELS)
    + " SELECT * EXCLUDE (target) FROM (" + " UNION ALL ".join(_model_line(m, "price", f"_{m}") for m in _MODELS) + ")",
)
def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nested predictor sets: least squares and cross-validated scores."""
    rows = [
        (m, f.n, round(f.ols.r2, 6), round(f.ridge.cv_r2, 6), round(f.ridge.cv_r2_sd, 6), round(f.ridge.best_alpha, 4))
        for m, f in _fits(spark, sf_dir, "price").items()
    ]
    return spark.createDataFrame(rows, "model string, n long, ols_r2 double, cv_r2 double, cv_r2_sd double, best_alpha double")


_COMPARED = {(m, t): f"_{m}_{t}" for m in _MODELS for t in _TARGETS}


@query(
    "r8_comparison_of_two_targets",
    "WITH " + ", ".join(ridge_ctes(_ridge_rows(m, t), tag) for (m, t), tag in _COMPARED.items())
    + ", lines AS (" + " UNION ALL ".join(_model_line(m, t, tag) for (m, t), tag in _COMPARED.items()) + """)
      SELECT p.model, p.n AS ride_n, round(p.ols_r2, 3) AS ride_ols_r2, round(p.cv_r2, 3) AS ride_cv_r2,
             c.n AS run_n, round(c.ols_r2, 3) AS run_ols_r2, round(c.cv_r2, 3) AS run_cv_r2
      FROM lines p JOIN lines c ON p.model = c.model AND p.target = 'price' AND c.target = 'cost'""",
)
def two_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison table, with the two targets in place of the two sports."""
    return report.comparison_table(spark, _fits(spark, sf_dir, "price"), _fits(spark, sf_dir, "cost"))


@query(
    "r6_vif_collinear",
    """SELECT 'l_quantity' AS term, CAST('Infinity' AS DOUBLE) AS vif UNION ALL SELECT 'l_discount', CAST('Infinity' AS DOUBLE)
       UNION ALL SELECT 'both', CAST('Infinity' AS DOUBLE)
       UNION ALL SELECT 'l_tax', round(1 / (1 - (saa * sbt * sbt - 2 * sab * sat * sbt + sbb * sat * sat) / (saa * sbb - sab * sab) / stt), 9) FROM
       (SELECT var_pop(l_quantity) AS saa, var_pop(l_discount) AS sbb, covar_pop(l_quantity, l_discount) AS sab, covar_pop(l_quantity, l_tax) AS sat,
               covar_pop(l_discount, l_tax) AS sbt, var_pop(l_tax) AS stt FROM lineitem)""",
)
def vif_collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor that is the sum of two others makes those three infinite and leaves the fourth alone."""
    lines = table(spark, sf_dir, "lineitem").withColumn("both", F.col("l_quantity") + 500 * F.col("l_discount"))
    fit = ols.fit_ols(lines, ["l_quantity", "l_discount", "both", "l_tax"], "l_extendedprice")
    rows = [(t, round(float(v), 9)) for t, v in ols.variance_inflation(fit).items()]
    return spark.createDataFrame(rows, "term string, vif double")
