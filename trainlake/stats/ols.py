"""Least squares with robust (HC3) errors from two distributed passes.

Slopes, leverages and errors come from the design's triangular factor, never
from its sums of products, so nearly collinear predictors keep their digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distributions import Z_975, f_upper_tail, normal_two_sided
from .triangle import Triangle, directions, triangle

INTERCEPT = "Intercept"


@dataclass(frozen=True)
class OlsFit:
    names: tuple[str, ...]
    target: str
    n: int
    beta: np.ndarray
    covariance: np.ndarray
    r2: float
    r2_adj: float
    f_value: float
    f_p: float
    moments: Triangle

    @property
    def std_err(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    @property
    def z(self) -> np.ndarray:
        return self.beta / self.std_err

    @property
    def p(self) -> np.ndarray:
        return np.array([normal_two_sided(z) for z in self.z])

    def interval(self) -> tuple[np.ndarray, np.ndarray]:
        half = Z_975 * self.std_err
        return self.beta - half, self.beta + half


def _dot(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, w in zip(columns, weights):
        total = total + c * F.lit(float(w))
    return total


def _meat(df: DataFrame, x: Sequence[Column], y: Column, beta: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of u u' (e / (1 - h))^2 over all rows, u = W'x being the row in orthogonal directions and h = u'u its leverage."""
    k = w.shape[1]
    turned = df.select(*[_dot(x, w[:, i]).alias(f"_{i}") for i in range(k)], (y - _dot(x, beta)).alias("_e"))
    leverage = F.lit(0.0)
    for i in range(k):
        leverage = leverage + F.col(f"_{i}") * F.col(f"_{i}")
    # A row that alone decides a coefficient has no leave-one-out residual.
    room = F.lit(1.0) - F.col("_h")
    weight = F.when(room != 0.0, F.pow(F.col("_e") / room, 2)).otherwise(F.lit(float("nan")))
    weighted = turned.withColumn("_h", leverage).withColumn("_w", weight)
    sums = [
        F.sum(F.col(f"_{i}") * F.col(f"_{j}") * F.col("_w")).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)
    ]
    row = weighted.agg(*sums).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = row[f"m_{i}_{j}"]
    return meat


def fit_ols(df: DataFrame, predictors: Sequence[str], target: str, stats: Triangle | None = None) -> OlsFit:
    """Fit ``target ~ 1 + predictors`` on complete rows of doubles."""
    stats = (stats or triangle(df, [*predictors, target])).pick([*predictors, target])
    p, n = len(predictors), stats.n
    mean = stats.mean
    # Below the row of the intercept everything is centred at the means.
    x_part, y_part = stats.r[1:, 1:-1], stats.r[1:, -1]
    w, u = directions(x_part)
    rank = w.shape[1]
    slopes = w @ (u.T @ y_part)
    beta = np.concatenate([[mean[p] - mean[:p] @ slopes], slopes])
    syy, left = float(y_part @ y_part), y_part - x_part @ slopes
    r2 = float(1.0 - left @ left / syy) if syy > 0 else float("nan")
    dof = n - rank - 1
    r2_adj = 1.0 - (1.0 - r2) * (n - 1) / dof if dof > 0 else float("nan")

    # In centred coordinates the intercept and the slopes separate.
    turn = np.zeros((p + 1, 1 + rank))
    turn[0, 0] = 1.0 / np.sqrt(n)
    turn[1:, 1:] = w
    x = [F.lit(1.0), *[F.col(c) - F.lit(float(m)) for c, m in zip(predictors, mean[:p])]]
    centred = np.concatenate([[mean[p]], slopes])
    sandwich = turn @ _meat(df, x, F.col(target), centred, turn) @ turn.T
    back = np.eye(p + 1)
    back[0, 1:] = -mean[:p]
    covariance = back @ sandwich @ back.T

    slope_cov = covariance[1:, 1:]
    wald_rank = int(np.linalg.matrix_rank(slope_cov, hermitian=True))
    f_value = float(slopes @ np.linalg.pinv(slope_cov, hermitian=True) @ slopes / wald_rank) if wald_rank else float("nan")
    f_p = f_upper_tail(f_value, wald_rank, dof) if wald_rank and dof > 0 else float("nan")
    return OlsFit((INTERCEPT, *predictors), target, int(n), beta, covariance, r2, r2_adj, f_value, f_p, stats)


def variance_inflation(fit: OlsFit) -> dict[str, float]:
    """1 / (1 - R2) of each predictor on the others; infinite where the others determine it.

    A predictor without variance has none.
    """
    p = len(fit.names) - 1
    scatter = fit.moments.scatter[:p, :p]
    sd = np.sqrt(np.clip(np.diag(scatter), 0.0, None))
    out = dict.fromkeys(fit.names[1:], float("nan"))
    usable = np.flatnonzero(sd > 0)
    corr = scatter[np.ix_(usable, usable)] / np.outer(sd[usable], sd[usable])
    for k, at in enumerate(usable):
        others = np.delete(np.arange(len(usable)), k)
        shared = corr[others, k]
        explained = float(shared @ np.linalg.pinv(corr[np.ix_(others, others)], rcond=1e-10, hermitian=True) @ shared)
        out[fit.names[1 + at]] = float("inf") if explained >= 1.0 - 1e-10 else 1.0 / (1.0 - explained)
    return out
