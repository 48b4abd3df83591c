"""Triangular factor of a design, reduced in a tree on Spark.

Sums of products square the condition of a design; its triangular factor keeps
it.  Every partition reduces its rows, a batch at a time, to one small triangle;
triangles are stacked and reduced again in ``FAN_IN`` groups, and those on the
driver.  Only (p+2)^2 numbers per partition move.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import size_and_means

# Groups of the second step, and triangles that reach the driver at most.
FAN_IN = 64
# Directions this much shorter than the longest, columns scaled alike, count as none.
SHORTEST = 1e-11


@dataclass(frozen=True)
class Triangle:
    """R of [1, columns - centre], so that R'R are the sums of products."""

    names: tuple[str, ...]
    centre: np.ndarray
    n: float
    r: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        """Column means."""
        return self.centre + self.r[0, 1:] / self.r[0, 0]

    @property
    def scatter(self) -> np.ndarray:
        """Centred sums of squares and products."""
        below = self.r[1:, 1:]
        return below.T @ below

    def pick(self, names: Sequence[str]) -> Triangle:
        at = [self.names.index(n) for n in names]
        return Triangle(tuple(names), self.centre[at], self.n, reduced(self.r[:, [0, *[1 + i for i in at]]]))


def reduced(rows: np.ndarray) -> np.ndarray:
    """R of some rows, square, with a diagonal that isn't negative."""
    p = rows.shape[1]
    r = np.linalg.qr(np.vstack([rows, np.zeros((max(p - len(rows), 0), p))]), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def triangle(df: DataFrame, columns: Sequence[str], centre: np.ndarray | None = None) -> Triangle:
    """The triangle of all complete rows: one pass for the means, one for the factors."""
    centre = size_and_means(df, columns)[1] if centre is None else np.asarray(centre)
    p = len(columns) + 1

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, p)), 0
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.ones(batch.num_rows), *[batch[f"_{i}"].to_numpy(zero_copy_only=False) - c for i, c in enumerate(centre)]])
                r, n = reduced(np.vstack([r, x])), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["n", "r"])

    def merge(table: pa.Table) -> pa.Table:
        r = reduced(np.vstack([np.array(v).reshape(p, p) for v in table["r"].to_pylist()]))
        return pa.table({"n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).na.drop()
    parts = rows.mapInArrow(factor, "n long, r array<double>").withColumn("part", F.spark_partition_id() % FAN_IN)
    found = parts.groupBy("part").applyInArrow(merge, "n long, r array<double>").collect()
    stack = [np.array(row["r"]).reshape(p, p) for row in found]
    return Triangle(tuple(columns), centre, float(sum(row["n"] for row in found)), reduced(np.vstack([np.zeros((0, p)), *stack])))


def directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """W and U with (R'R)^+ = W W' and R^+ = W U', from the columns of R scaled to one length."""
    length = np.sqrt((r * r).sum(axis=0))
    length[length == 0] = 1.0
    u, s, vt = np.linalg.svd(r / length, full_matrices=False)
    kept = s > SHORTEST * s.max() if s.size else s > 0
    return (vt[kept].T / s[kept]) / length[:, None], u[:, kept]
