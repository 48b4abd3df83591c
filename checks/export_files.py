"""Writes derived raw tables as export files (JSON lines, CSV) for the readers to read back.

Nested records are built per row with array and struct expressions, so no group
is ever gathered.  Files go to the shared folder of the session.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.plans import contracts as C
from trainlake.session import scratch_path
from trainlake.sources import schemas as S


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _number(value: float | None) -> Column:
    return F.lit(value).cast("double")


def _wire(df: DataFrame, fields: list[tuple[str, str]]) -> list[Column]:
    have = set(df.columns)
    return [
        (F.col(n) if n in have else F.lit(None).cast("string")).alias(S.wire_name(n)) for n, _ in fields
    ]


def write_json_lines(df: DataFrame, label: str, per_line: Column | None = None) -> str:
    """One JSON document per line: each row as an object, or an array built from the row."""
    path = scratch_path(df.sparkSession, label)
    document = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])) if per_line is None else F.to_json(per_line)
    df.select(document.alias("value")).write.text(path)
    return path


def _profile(df: DataFrame) -> list[Column]:
    """The profile key under one spelling for some rows and the other for the rest."""
    first = F.col("athlete_id") % 2 == 0
    key = F.col("user_profile_pk").cast("bigint")
    return [F.when(first, key).alias(S.PROFILE_KEYS[0]), F.when(~first, key).alias(S.PROFILE_KEYS[1])]


def flat(raw: DataFrame, table: str) -> str:
    # The profile key must be whole in a file.
    whole = raw.withColumn("user_profile_pk", F.rint("user_profile_pk"))
    return _case_sensitive_write(whole, ["athlete_id", *_profile(whole), *_wire(whole, S.FLAT_SOURCES[table])], table)


def _case_sensitive_write(raw: DataFrame, columns, label: str) -> str:
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    path = scratch_path(raw.sparkSession, label)
    raw.select(F.to_json(F.struct(*named)).alias("value")).write.text(path)
    return path


def health(raw: DataFrame) -> str:
    """Two metrics per record; the second one has the status that staging drops."""

    def metric(status: Column) -> Column:
        return F.struct(
            F.col("metric_type").alias("type"), F.col("value"), F.col("baseline_upper_limit").alias("baselineUpperLimit"),
            F.col("baseline_lower_limit").alias("baselineLowerLimit"), status.alias("status"), F.col("percentage"),
        )

    columns = [
        "athlete_id", F.col("calendar_date").alias("calendarDate"), F.col("create_timestamp_utc").alias("createTimestampUTC"),
        F.col("outliers_count").alias("outliersCount"), F.array(metric(F.col("status")), metric(_text("UNKNOWN"))).alias("metrics"),
    ]
    return _case_sensitive_write(raw, columns, "health")


def sleep(raw: DataFrame) -> str:
    scores = F.struct(*[F.col(n).alias(f) for n, f in S.SLEEP_SCORES.items()])
    return _case_sensitive_write(raw, ["athlete_id", *_wire(raw, S.SLEEP_SCALARS), scores.alias("sleepScores")], "sleep")


def daily(raw: DataFrame) -> str:
    """Every discriminated list starts with a decoy that a later element replaces."""

    def stress(kind: str, real: bool) -> Column:
        fields = S.STRESS_FIELDS["TOTAL"]
        taken = {f: n for n, f in S.STRESS_FIELDS[kind].items()}
        values = [(F.col(taken[f]) if real and f in taken else _number(-1.0)).alias(f) for f in fields.values()]
        return F.struct(_text(kind).alias("type"), *values)

    def stat(kind: str | None, value: Column) -> Column:
        return F.struct(_text(kind).alias("bodyBatteryStatType"), value.cast("double").alias("statsValue"))

    stats = [stat("HIGHEST", _number(-1.0)), stat(None, _number(-2.0))]
    stats += [stat(kind, F.col(n)) for n, kind in S.BATTERY_STATS.items()]
    battery = F.struct(
        *[F.col(n).alias(f) for n, f in S.BATTERY_FIELDS.items()], F.array(*stats).alias("bodyBatteryStatList")
    )
    lists = F.array(stress("TOTAL", False), stress("AWAKE", True), stress("TOTAL", True))
    columns = [
        "athlete_id", *_profile(raw), *_wire(raw, S.DAILY_SCALARS),
        F.struct(lists.alias("aggregatorList")).alias("allDayStress"),
        battery.alias("bodyBattery"),
        F.struct(*[F.col(n).alias(f) for n, f in S.RESPIRATION_FIELDS.items()]).alias("respiration"),
        F.struct(*[F.col(n).alias(f) for n, f in S.HYDRATION_FIELDS.items()]).alias("hydration"),
    ]
    return _case_sensitive_write(raw, columns, "daily")


def activities(raw: DataFrame) -> str:
    """Each record wraps its activities in an envelope; a nested field is to be dropped."""
    item = F.struct(*_wire(raw, S.DEVICE_ACTIVITY_FIELDS), F.array(F.col("activity_id")).alias("splits"))
    columns = ["athlete_id", F.array(item).alias("summarizedActivitiesExport")]
    return _case_sensitive_write(raw, columns, "activities")


def endurance(raw: DataFrame) -> str:
    """Contributors keyed by group, with a decoy first and one keyed by sport only."""

    def part(group: int | None, value: Column, sport: str | None = None) -> Column:
        return F.struct(F.lit(group).cast("int").alias("group"), value.cast("double").alias("contribution"), _text(sport).alias("sport"))

    parts = [part(0, _number(-1.0)), part(None, _number(-2.0), "HIKING")]
    parts += [part(g, F.col(n)) for n, g in S.ENDURANCE_GROUPS.items()]
    whole = raw.withColumn("user_profile_pk", F.rint("user_profile_pk"))
    columns = [
        "athlete_id", *_profile(whole), F.col("calendar_date_ms").alias("calendarDate"), F.col("timestamp_ms").alias("timestamp"),
        F.col("device_id").alias("deviceId"), F.col("overall_score").alias("overallScore"), F.col("classification"),
        F.col("feedback_phrase").alias("feedbackPhrase"), F.col("primary_training_device").alias("primaryTrainingDevice"),
        F.array(*parts).alias("enduranceScoreContributor"),
    ]
    return _case_sensitive_write(whole, columns, "endurance")


# Headers that occur twice in the activity CSV.
TWICE = ("elapsed_time", "distance", "max_heart_rate", "relative_effort", "commute")


def activity_csv(spark: SparkSession, raw: DataFrame) -> str:
    """CSV files whose header repeats five names: a coarse copy first, the detailed one later."""
    fields = [f.raw for f in C.ACTIVITY_LOG if f.raw not in ("activity_date", "started_at")]
    names = [*TWICE, "activity_date", *fields, "athlete_id"]
    header = ",".join(n.replace("_", " ").title() for n in names)
    values = [F.lit(None).cast("string").alias(f"_first_{n}") for n in TWICE]
    values.append(F.date_format("started_at", "MMM d, yyyy, h:mm:ss a").alias("_when"))
    values += [F.col(n).cast("string").alias(n) for n in [*fields, "athlete_id"]]
    lines = raw.select(F.to_csv(F.struct(*values)).alias("value"))

    def with_header(batches):
        yield pd.DataFrame({"value": [header]})
        yield from batches

    path = scratch_path(spark, "activity-csv")
    lines.mapInPandas(with_header, "value string").write.text(path)
    return path


def _newer_fields(number: Column) -> list[Column]:
    """Fields of a newer export: whole, fractional, text full of JSON marks, of two kinds, always and sometimes nested."""
    even = number % 2 == 0
    return [
        (number % 1000).alias("extraWhole"), F.parse_json((number / 4).cast("string")).alias("extraShare"),
        F.concat(F.lit('}],[{"x": "\\'), number.cast("string")).alias("extraNote"), even.alias("extraFlag"),
        F.parse_json(F.when(even, (number % 7).cast("string")).otherwise(F.lit('"seven"'))).alias("extraMixed"),
        F.struct(number.alias("a"), F.array(F.lit("}")).alias("b")).alias("extraNested"),
        F.parse_json(F.when(even, F.lit("[1, {}]")).otherwise(F.lit("3"))).alias("extraSometimes"),
    ]


def newer_documents(raw: DataFrame, table: str, files: int) -> str:
    """The flat source as whole documents of a newer export."""
    return whole_documents(raw, table, files, _newer_fields(F.floor(F.col("device_id") / 1000)))


def newer_activities(raw: DataFrame) -> str:
    """Device recordings of a newer export, in envelopes, one document per line."""
    item = F.struct(*_wire(raw, S.DEVICE_ACTIVITY_FIELDS), *_newer_fields(F.col("activity_id")))
    return _case_sensitive_write(raw, ["athlete_id", F.array(item).alias(S.ACTIVITY_ENVELOPE)], "newer")


def document_lines():
    """A partition's records as the lines of one document that is an array.

    One line per record, each ended by its comma once the next is seen: the
    bytes of ``"[" + ",\\n ".join(records) + "\\n]"``, never held at once.
    """

    def document(batches):
        held, lead = None, "["
        for batch in batches:
            lines = []
            for r in batch["value"]:
                if held is not None:
                    lines.append(lead + held + ",")
                    lead = " "
                held = r
            if lines:
                yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["[", "]"] if held is None else [lead + held, "]"]})

    return document


def whole_documents(raw: DataFrame, table: str, files: int, extra: Sequence[Column] = ()) -> str:
    """The flat source as the export has it: many files, each one document that is an array over several lines."""
    whole = raw.withColumn("user_profile_pk", F.rint("user_profile_pk"))
    columns = ["athlete_id", *_profile(whole), *_wire(whole, S.FLAT_SOURCES[table])]
    # Extra fields of a newer export: one flat, one nested.
    record = F.to_json(F.struct(*[F.col(c) if isinstance(c, str) else c for c in columns], *(extra or [F.struct(F.lit(1).alias("a")).alias("extraNested")])))

    path = scratch_path(raw.sparkSession, "documents")
    # A file's records come from one partition; there are as many as asked for.
    spread = whole.select(record.alias("value")).repartition(files)
    spread.mapInPandas(document_lines(), "value string").write.text(path)
    return path


def activity_csv_orders(spark: SparkSession, raw: DataFrame) -> str:
    """The activity log in three kinds of files: two orders of the columns, and one without a column."""
    fields = [f.raw for f in C.ACTIVITY_LOG if f.raw not in ("activity_date", "started_at")]
    orders = [["_when", *fields, "athlete_id"], ["athlete_id", *reversed(fields), "_when"], ["_when", "athlete_id", *[f for f in fields if f != "uv_index"]]]
    path = scratch_path(spark, "activity-orders")
    shown = raw.select(
        F.date_format("started_at", "MMM d, yyyy, h:mm:ss a").alias("_when"), *[F.col(n).cast("string").alias(n) for n in [*fields, "athlete_id"]]
    ).withColumn("_kind", F.pmod(F.xxhash64("activity_id"), F.lit(3)))
    for kind, names in enumerate(orders):
        headers = ["activity_date" if n == "_when" else n for n in names]
        part = shown.filter(F.col("_kind") == kind).select([F.col(n).alias(h.replace("_", " ").title()) for n, h in zip(names, headers)])
        part.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{path}/kind-{kind}")
    return f"{path}/*"
