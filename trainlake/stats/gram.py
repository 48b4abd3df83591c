"""Sufficient statistics of a linear model, aggregated on Spark.

Sums are taken around a fixed centre (the column means), so that large offsets
do not cost precision.  Only (p+1)(p+2)/2 numbers per group leave the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """n, sums and cross products of (x..., y) minus ``centre``."""

    names: tuple[str, ...]
    centre: np.ndarray
    n: float
    total: np.ndarray
    cross: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.names, self.centre, self.n + other.n, self.total + other.total, self.cross + other.cross)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.names, self.centre, self.n - other.n, self.total - other.total, self.cross - other.cross)

    @property
    def mean(self) -> np.ndarray:
        return self.centre + self.total / self.n

    @property
    def scatter(self) -> np.ndarray:
        """Centred sums of squares and products."""
        return self.cross - np.outer(self.total, self.total) / self.n

    def pick(self, names: Sequence[str]) -> Moments:
        at = [self.names.index(n) for n in names]
        return Moments(tuple(names), self.centre[at], self.n, self.total[at], self.cross[np.ix_(at, at)])


def size_and_means(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """Row count and column means in one pass (a mean over no rows counts as zero)."""
    row = df.agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in columns]).first()
    return row["_n"], np.array([0.0 if row[c] is None else row[c] for c in columns])


def gram_frame(df: DataFrame, columns: Sequence[str], centre: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``n``, ``s_i`` and ``c_i_j`` for i <= j.  Partial sums before the shuffle."""
    moved = df.select(*groups, *[(F.col(c) - F.lit(float(m))).alias(f"_{i}") for i, (c, m) in enumerate(zip(columns, centre))])
    size = range(len(columns))
    sums = [F.sum(f"_{i}").alias(f"s_{i}") for i in size]
    products = [F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"c_{i}_{j}") for i in size for j in size if i <= j]
    return moved.groupBy(*groups).agg(F.count("*").alias("n"), *sums, *products)


def to_moments(row, columns: Sequence[str], centre: np.ndarray) -> Moments:
    p = len(columns)
    total = np.array([row[f"s_{i}"] or 0.0 for i in range(p)])
    cross = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cross[i, j] = cross[j, i] = row[f"c_{i}_{j}"] or 0.0
    return Moments(tuple(columns), np.asarray(centre), float(row["n"]), total, cross)


def moments(df: DataFrame, columns: Sequence[str], centre: np.ndarray | None = None) -> Moments:
    """Moments of all rows: one pass for the means, one for the products."""
    centre = size_and_means(df, columns)[1] if centre is None else centre
    return to_moments(gram_frame(df, columns, centre).first(), columns, centre)


def grouped_moments(df: DataFrame, columns: Sequence[str], groups: Sequence[str], centre: np.ndarray) -> dict[tuple, Moments]:
    """Moments per group; the number of groups must be small by construction."""
    rows = gram_frame(df, columns, centre, groups).collect()
    return {tuple(r[g] for g in groups): to_moments(r, columns, centre) for r in rows}


def gram_entries(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The uncentred Gram matrix (with intercept) as rows (row_name, col_name, value)."""
    wide = gram_frame(df, columns, [0.0] * len(columns))
    names = list(columns)
    entries = [("intercept", "intercept", F.col("n").cast("double"))]
    entries += [("intercept", c, F.col(f"s_{i}")) for i, c in enumerate(names)]
    entries += [(names[i], names[j], F.col(f"c_{i}_{j}")) for i in range(len(names)) for j in range(i, len(names))]
    array = F.array(*[F.struct(F.lit(a).alias("row_name"), F.lit(b).alias("col_name"), v.alias("value")) for a, b, v in entries])
    return wide.select(F.inline(array))
