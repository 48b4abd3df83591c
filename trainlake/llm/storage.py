"""Intermediate tables in the shared folder, and ranks that no single task has to count."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# Rows that one rank cell holds on average when a single group has all rows.
CELL_ROWS = 20_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read back.

    Cuts the lineage: a lost executor makes Spark read the files again instead
    of running the steps before them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def forget(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ranked(df: DataFrame, group: str, order: Sequence[Column], salt: Column, total: int, rank: str = "rank") -> DataFrame:
    """Add the 0-based position of each row within its group, whatever a group's size.

    Rows of a group are dealt to cells by ``salt`` (any hash); a cell is
    numbered by a window, and starts where the cells before it end.  The order
    is by cell, then by ``order``; it only depends on the rows.
    """
    cells = max(1, -(-total // CELL_ROWS))
    dealt = df.withColumn("_cell", F.pmod(salt, F.lit(cells)).cast("int"))
    counts = dealt.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_cell").orderBy(*order)
    numbered = dealt.withColumn("_in", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(starts, [group, "_cell"]).withColumn(rank, F.col("_start") + F.col("_in")).drop("_cell", "_in", "_start")
