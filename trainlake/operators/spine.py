"""Left joins onto a spine that stay balanced when one key is hot.

Several sources sharing one key are joined on one shuffle of that key.  A key
holding a large part of the spine (missing keys included) is taken out first:
its side rows are few, so they are broadcast when a count proves it, and
otherwise the hot spine rows are salted against copies of the side rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot above this many spine rows, however large the table is.
HOT_ROWS = 5_000_000
# Keys are counted on a sample of about this many rows; exactly when there are fewer.
SAMPLE_ROWS = 5_000_000
# Side rows of hot keys are broadcast up to this count, salted beyond.
BROADCAST_ROWS = 200_000

_COPIES = "_hot_copies"


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys above the threshold with the number of salt copies each needs.

    There are at most as many as ``hot_rows`` goes into the rows: 200,000 of 10^12
    at the default.  Counting on a sample only decides how rows are spread;
    every row is joined either way.
    """
    total = df.select(*keys).count()
    if total <= hot_rows:
        return None
    share = min(1.0, SAMPLE_ROWS / total)
    counted = df.select(*keys) if share == 1.0 else df.select(*keys).sample(share, seed=7)
    found = counted.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows * share).collect()
    if not found:
        return None
    schema = df.select(*keys).schema.add(_COPIES, T.IntegerType())
    rows = [tuple(r[k] for k in keys) + (math.ceil(r["_n"] / share / hot_rows),) for r in found]
    return df.sparkSession.createDataFrame(rows, schema)


def _flag_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the copy count of hot keys (NULL on the others), NULL keys included."""
    h = F.broadcast(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], _COPIES))
    condition = None
    for k in keys:
        same = df[k].eqNullSafe(F.col(f"_h_{k}"))
        condition = same if condition is None else condition & same
    return df.join(h, condition, "left").drop(*[f"_h_{k}" for k in keys])


def _join_hot(hot_spine: DataFrame, side: DataFrame, hot: DataFrame, keys: Sequence[str], broadcast_rows: int) -> DataFrame:
    side_hot = side.join(F.broadcast(hot), list(keys))
    if side_hot.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return hot_spine.join(F.broadcast(side_hot.drop(_COPIES)), list(keys), "left")
    salt_source = [F.col(f"`{c}`") for c in hot_spine.columns]
    salted = hot_spine.withColumn("_salt", F.pmod(F.xxhash64(*salt_source), F.col(_COPIES)).cast("int"))
    copies = side_hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col(_COPIES) - 1))).drop(_COPIES)
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def left_join_spine(
    spine: DataFrame,
    sides: Sequence[DataFrame],
    keys: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
    measure: DataFrame | None = None,
) -> DataFrame:
    """Left-join every side onto the spine by ``keys``; all spine rows are kept.

    A side with several rows per key multiplies the spine row, as a plain left
    join does.  ``hot_rows=None`` skips the check for hot keys.  ``measure`` is
    a cheaper frame with the spine's keys to count instead of a costly spine.
    """
    keys = list(keys)
    hot = hot_keys(spine if measure is None else measure, keys, hot_rows) if hot_rows is not None else None
    if hot is None:
        out = spine
        for side in sides:
            out = out.join(side, keys, "left")
        return out

    flagged = _flag_hot(spine, hot, keys)
    cold = flagged.filter(F.col(_COPIES).isNull()).drop(_COPIES)
    burning = flagged.filter(F.col(_COPIES).isNotNull())
    for side in sides:
        cold = cold.join(side, keys, "left")
        burning = _join_hot(burning, side, hot, keys, broadcast_rows)
    return cold.unionByName(burning.drop(_COPIES))
