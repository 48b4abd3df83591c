"""Exact positions in a sorted series without sorting a series in one task.

A plain window does the work while every series is small.  Beyond that the
rows are laid out by range, so one long series spreads over many tasks, and
each range continues the counts of the ranges before it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Longest series that one window task may hold.
SERIES_ROWS = 1_000_000
# Rows of a range laid out for one task; half as many on average.
RANGE_ROWS = 1_000_000


def longest_series(df: DataFrame, series: Sequence[str]) -> int:
    """Rows in the longest series."""
    if not series:
        return df.count()
    sizes = df.groupBy(*series).agg(F.count("*").alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def ranges(spark, total: int) -> int:
    """Ranges for ``total`` rows: a task each, so as many as there are shuffle partitions, and one more per
    ``RANGE_ROWS`` rows.  ``max_rows`` does not set it; a range's window spills, and tasks cost the driver."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * total / RANGE_ROWS))


def ordered_counts(
    df: DataFrame,
    order: Sequence[Column],
    counts: Mapping[str, Column],
    series: Sequence[str] = (),
    max_rows: int = SERIES_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Add, per row, how many earlier rows of its series satisfy each condition.

    ``{"idx": lit(True)}`` gives the 0-based position.  ``order`` must be a
    total order within the series.  ``longest`` saves counting when the length
    of the longest series is known.
    """
    ones = {f"_one_{n}": c.cast("bigint") for n, c in counts.items()}
    tagged = df.withColumns(ones)
    if (longest_series(df, series) if longest is None else longest) <= max_rows:
        before = Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        added = {n: F.coalesce(F.sum(f"_one_{n}").over(before), F.lit(0)) for n in counts}
        return tagged.withColumns(added).drop(*ones)

    spark = df.sparkSession
    total = longest if longest is not None and not series else df.count()
    laid = tagged.repartitionByRange(ranges(spark, total), *[F.col(s).asc() for s in series], *order)
    # Range bounds are sampled anew on each evaluation; fix them once.
    laid = cut_lineage(laid.withColumn("_part", F.spark_partition_id()))

    per_part = laid.groupBy("_part", *series).agg(*[F.coalesce(F.sum(o), F.lit(0)).alias(o) for o in ones], F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*series).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_part.select(
        "_part",
        *series,
        *[F.sum(o).over(earlier).alias(f"_carry{o}") for o in ones],
        F.sum("_rows").over(earlier).alias("_before"),
    ).filter(F.col("_before") > 0)
    # At most one series runs on into each range: no more rows than ranges.
    carried = F.broadcast(carried.drop("_before").withColumnsRenamed({s: f"_c_{s}" for s in series}).withColumnRenamed("_part", "_c_part"))
    same = laid["_part"] == F.col("_c_part")
    for s in series:
        same = same & laid[s].eqNullSafe(F.col(f"_c_{s}"))
    within = Window.partitionBy("_part", *series).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = {
        n: F.coalesce(F.sum(f"_one_{n}").over(within), F.lit(0)) + F.coalesce(F.col(f"_carry_one_{n}"), F.lit(0))
        for n in counts
    }
    return laid.join(carried, same, "left").withColumns(added).select(*df.columns, *counts)


def rolling_mean(
    df: DataFrame,
    value: str,
    points: int,
    order: Sequence[Column],
    series: Sequence[str] = (),
    out: str = "rolling",
    min_points: int | None = None,
    max_rows: int = SERIES_ROWS,
    measure: DataFrame | None = None,
) -> DataFrame:
    """Mean of the last ``points`` rows (rows, not days), rounded half to even to 2 places.

    NULL until ``min_points`` values are present (default: half the window).
    Long series are cut into chunks that each carry the rows before them.
    ``measure`` is a cheaper frame whose series are about as long, counted in
    place of a costly input; it only decides how the work is spread.
    """
    least = max(1, points // 2) if min_points is None else min_points

    def mean_over(window) -> Column:
        mean = F.avg(value).over(window)
        rounded = F.rint(mean * F.lit(100.0)) / F.lit(100.0)
        return F.when(F.count(value).over(window) >= least, rounded)

    longest = longest_series(df if measure is None else measure, series)
    if longest <= max_rows:
        window = Window.partitionBy(*series).orderBy(*order).rowsBetween(1 - points, 0)
        return df.withColumn(out, mean_over(window))

    chunk = max(max_rows, points)
    # A measure that says too little must not take the row count's place in the layout.
    placed = ordered_counts(df, order, {"_idx": F.lit(True)}, series, max_rows, longest if measure is None else max(longest, longest_series(df, series)))
    home = F.floor(F.col("_idx") / F.lit(chunk)).cast("bigint")
    last_seen_in = F.floor((F.col("_idx") + F.lit(points - 1)) / F.lit(chunk)).cast("bigint")
    spread = placed.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(F.col("_home"), last_seen_in)))
    window = Window.partitionBy(*series, "_chunk").orderBy("_idx").rowsBetween(1 - points, 0)
    return spread.withColumn(out, mean_over(window)).filter("_chunk = _home").select(*df.columns, out)
