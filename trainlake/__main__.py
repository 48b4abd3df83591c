"""Build a lake from export folders: ``python -m trainlake <export folder> <activities.csv> <lake>``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import build, staging
from .session import prepare
from .sources import tables


def main() -> None:
    parser = argparse.ArgumentParser(prog="trainlake")
    parser.add_argument("wearable_dir", help="export folder; may hold a wildcard such as exports/athlete_id=*")
    parser.add_argument("activity_csv", help="activity log CSV; may hold the same wildcard")
    parser.add_argument("lake", help="folder for the tables, shared by all executors")
    parser.add_argument("--key", action="append", default=[], help="identity column found in the paths, e.g. athlete_id")
    parser.add_argument("--base-path", help="common folder above the identity folders")
    parser.add_argument("--lines", action="store_true", help="JSON files hold one record per line")
    args = parser.parse_args()

    spark = prepare(SparkSession.builder.appName("trainlake").getOrCreate())
    raw = build.ingest(spark, args.wearable_dir, args.activity_csv, args.key, args.base_path, multi_line=not args.lines)
    build.build(spark, raw, args.lake, args.key)
    stored = tables.read_tables(spark, args.lake, "raw", list(staging.STAGED))
    tables.count_tables(stored).show(truncate=False)


if __name__ == "__main__":
    main()
