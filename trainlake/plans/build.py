"""From export folders to written marts."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import filters
from ..session import case_sensitive, prepare
from ..sources import discover, flatten, readers, schemas, tables
from . import marts, staging


def ingest(
    spark: SparkSession,
    wearable_dir: str,
    activity_csv: str | None,
    keys: Sequence[str] = (),
    base_path: str | None = None,
    multi_line: bool = True,
    all_fields: bool = True,
    split_over: int = readers.SPLIT_OVER,
) -> dict[str, DataFrame]:
    """Raw tables as lazy scans of the export files; ``write_raw`` stores them.

    For many athletes keep one folder per athlete (``athlete_id=.../``), pass a
    wildcard folder, the common ``base_path`` and ``keys=("athlete_id",)``.
    With ``all_fields`` the flat sources and the device recordings also get
    every flat field that the files have beyond the declared ones, which a
    first pass over the files finds; nested ones are dropped.  Documents of
    more than ``split_over`` bytes are read by several tasks.
    """
    prepare(spark)
    raw: dict[str, DataFrame] = {}
    if activity_csv:
        raw["strava__activities"] = readers.read_activity_csv(spark, activity_csv, base_path)
    for name, pattern in schemas.FILE_PATTERNS.items():
        raw[name] = read_source(spark, name, os.path.join(wearable_dir, pattern), keys, base_path, multi_line, all_fields, split_over)
    return raw


def read_source(
    spark: SparkSession,
    name: str,
    path: str,
    keys: Sequence[str] = (),
    base_path: str | None = None,
    multi_line: bool = True,
    all_fields: bool = True,
    split_over: int = readers.SPLIT_OVER,
    key_types: str = "",
) -> DataFrame:
    """One raw table from its export files; ``key_types`` declares keys that are fields of the records."""
    nested = flatten.NESTED_SOURCES.get(name)
    ddl = nested[0] if nested else schemas.flat_ddl(name)
    envelope = schemas.ACTIVITY_ENVELOPE if name == "garmin__activities" else None
    schema: str | T.StructType = f"{ddl}, {key_types}" if key_types else ddl
    extra: list[tuple[str, str, str]] = []
    files = readers.read_json(spark, path, schema, multi_line, base_path, split_over)
    if all_fields and (envelope or not nested) and files.inputFiles():
        fields = schemas.DEVICE_ACTIVITY_FIELDS if envelope else schemas.FLAT_SOURCES[name]
        declared = {schemas.wire_name(n) for n, _ in fields} | set(schemas.PROFILE_KEYS) | set(keys)
        found = discover.fields(spark, path, multi_line, base_path, split_over, envelope, declared)
        extra = discover.extra_fields(found, declared, [*keys, "user_profile_pk", staging.TYPED_DAY, staging.ROW_HASH, *[n for n, _ in fields]])
        if extra:
            files = readers.read_json(spark, path, discover.widened(schema, extra, envelope), multi_line, base_path, split_over)
    missing = [k for k in keys if k not in files.columns]
    if missing and files.inputFiles():
        raise ValueError(f"{path} has no key {missing}; is base_path the folder above {missing[0]}=...?")
    # Only the empty frame of a source without files is filled up.
    files = files.selectExpr("*", *[f"CAST(NULL AS STRING) AS {k}" for k in missing])
    if envelope:
        return flatten.device_activities(files, keys, extra)
    return nested[1](files, keys) if nested else flatten.flat_table(files, name, keys, extra)


def write_raw(spark: SparkSession, raw: dict[str, DataFrame], lake: str) -> dict[str, DataFrame]:
    """Create or replace the raw tables; returns them as read back.

    Tables of day grain keep their day as a date and are laid out by it, so
    that a question about some days reads only their files.  Laying out reads
    the rows twice, once for the bounds of the ranges, so they are written
    before instead of having their export files parsed again.
    """
    stored = {}
    with case_sensitive(spark):
        for name, df in raw.items():
            kept = staging.keep_day(df, name)
            if staging.TYPED_DAY in kept.columns:
                with tables.steps(spark, lake) as step:
                    stored[name] = tables.write_table(step(kept, name), lake, "raw", name, (staging.TYPED_DAY, staging.ROW_HASH))
            else:
                stored[name] = tables.write_table(kept, lake, "raw", name)
    return stored


class Lake:
    """The tables the queries read; each is planned when first asked for.

    ``raw`` finds a raw table by name, ``stored`` holds marts already written.
    """

    def __init__(self, raw: Callable[[str], DataFrame], keys: Sequence[str] = (), stored: Mapping[str, DataFrame] | None = None):
        self._raw, self._keys = raw, tuple(keys)
        self._tables: dict[str, DataFrame] = dict(stored or {})

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._plan(name)
        return self._tables[name]

    def _plan(self, name: str) -> DataFrame:
        if name == "int_garmin__daily":
            return marts.days(self._raw, self._keys)
        if name == "fct_activity":
            log, device = self.table("stg_strava__activities"), self.table("stg_garmin__activities")
            return marts.activity(log, device, self.daily, self._keys)
        if name == "fct_ride":
            return marts.ride(self.activity)
        if name == "fct_run":
            return marts.run(self.activity)
        for source, (staged, fn) in staging.STAGED.items():
            if staged == name:
                return fn(self._raw(source), self._keys)
        raise KeyError(name)

    @property
    def daily(self) -> DataFrame:
        return self.table("int_garmin__daily")

    @property
    def activity(self) -> DataFrame:
        return self.table("fct_activity")

    @property
    def ride(self) -> DataFrame:
        return self.table("fct_ride")

    @property
    def run(self) -> DataFrame:
        return self.table("fct_run")


def lazy_lake(raw: Mapping[str, DataFrame], keys: Sequence[str] = ()) -> Lake:
    """Every model as a lazy plan over the raw tables."""
    return Lake(raw.__getitem__, keys)


def build(spark: SparkSession, raw: dict[str, DataFrame], lake: str, keys: Sequence[str] = ()) -> Lake:
    """Write raw tables and the three marts; staging and the day spine stay lazy views.

    The marts are laid out by date, so that date filters on them skip files,
    and hold sport and tier folded, with Bloom filters.  The activity mart is
    written in steps, each of which frees its shuffle files.
    """
    views = lazy_lake(write_raw(spark, raw, lake), keys)
    order = ["activity_date", "activity_id"]
    folded = (filters.FOLDED_SPORT, filters.FOLDED_TIER)
    with tables.steps(spark, lake) as step:
        log, device = views.table("stg_strava__activities"), views.table("stg_garmin__activities")
        activity = marts.activity(log, device, views.daily, keys, step=step)
        stored = {"fct_activity": tables.write_table(filters.with_folded(activity), lake, "marts", "fct_activity", order, filtered=folded)}
    for name, mart in (("fct_ride", marts.ride), ("fct_run", marts.run)):
        stored[name] = tables.write_table(mart(stored["fct_activity"].drop(*folded)), lake, "marts", name, order)
    return open_lake(spark, lake, keys, stored)


def open_lake(spark: SparkSession, lake: str, keys: Sequence[str] = (), stored: Mapping[str, DataFrame] | None = None) -> Lake:
    """Open what ``build`` wrote."""
    prepare(spark)
    if stored is None:
        stored = {n: tables.read_table(spark, lake, "marts", n) for n in ("fct_activity", "fct_ride", "fct_run")}
    return Lake(lambda name: tables.read_table(spark, lake, "raw", name), keys, stored)
