"""Ridge regression with nested cross-validation from per-cell moments.

Outer folds come from a hash of the row's id.  The inner folds of each outer
training set are contiguous in time and made of whole days: a day belongs to
the fifth in which its first row falls.  Every fold is a union of (outer fold,
time interval) cells, so one grouped aggregate over at most
``folds * folds * (folds + 1)`` cells serves all outer fits, inner fits and
penalties; the rest is p-by-p algebra on the driver.  No row is ordered: the
cuts follow from the number of rows per day and outer fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gram import Moments, grouped_moments, size_and_means

# Penalties, folds and seed of the study.
ALPHAS = np.logspace(-2, 4, 50)
FOLDS = 5
SEED = 42


class FoldError(ValueError):
    """A fold without rows: the sample is too small for nested cross-validation."""


@dataclass(frozen=True)
class RidgeFit:
    names: tuple[str, ...]
    scores: np.ndarray
    fold_alphas: np.ndarray
    best_alpha: float
    coef: np.ndarray
    intercept: float
    n: int

    @property
    def cv_r2(self) -> float:
        return float(self.scores.mean())

    @property
    def cv_r2_sd(self) -> float:
        return float(self.scores.std())


def outer_fold(ids: Sequence[str], folds: int = FOLDS, seed: int = SEED) -> Column:
    """Outer fold of a row from the MD5 of seed and id, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def _day_counts(rows: DataFrame, time: str, folds: int) -> tuple[list, np.ndarray]:
    """Days in order, NULL last, and rows per day and outer fold."""
    per_fold = [F.count_if(F.col("_fold") == k).alias(f"_n{k}") for k in range(folds)]
    # One row per day.
    found = rows.groupBy(time).agg(*per_fold).orderBy(F.col(time).asc_nulls_last()).collect()
    return [r[time] for r in found], np.array([[r[f"_n{k}"] for k in range(folds)] for r in found]).reshape(-1, folds)


def day_cuts(counts: np.ndarray, folds: int) -> list[int]:
    """For training rows per day: index of the first day of each later fold (repeats where a fold is empty)."""
    before = np.cumsum(counts) - counts
    label = np.minimum(before * folds // max(int(counts.sum()), 1), folds - 1)
    label = np.maximum.accumulate(label)
    return [int(np.searchsorted(label, j)) for j in range(1, folds)]


def _interval(time: str, days: Sequence, bounds: Sequence[int]) -> Column:
    """How many of the bounding days are at or before the row's day; NULL comes last."""
    out = F.lit(0)
    for b in bounds:
        reached = F.col(time).isNull() if days[b] is None else F.coalesce(F.col(time) >= F.lit(days[b]), F.lit(True))
        out = out + reached.cast("int")
    return out


def _about(m: Moments, point: np.ndarray) -> np.ndarray:
    """Sums of squares and products about an arbitrary point."""
    d = m.mean - point
    return m.scatter + m.n * np.outer(d, d)


class _Scaled:
    """Ridge solutions for all penalties on one training set, predictors scaled by ``sd``."""

    def __init__(self, train: Moments, sd: np.ndarray):
        p = len(sd)
        s = train.scatter
        self.mean, self.sd, self.p = train.mean, sd, p
        values, self.vectors = np.linalg.eigh(s[:p, :p] / np.outer(sd, sd))
        self.values = np.clip(values, 0.0, None)
        self.rotated = self.vectors.T @ (s[:p, p] / sd)

    def coef(self, alpha: float) -> np.ndarray:
        return self.vectors @ (self.rotated / (self.values + alpha))

    def r2(self, alpha: float, held: Moments) -> float:
        about = _about(held, self.mean)
        scale = np.append(self.sd, 1.0)
        about = about / np.outer(scale, scale)
        beta = self.coef(alpha)
        p = self.p
        sse = about[p, p] - 2.0 * beta @ about[:p, p] + beta @ about[:p, :p] @ beta
        sst = held.scatter[p, p]
        if sst <= 0.0:
            return 1.0 if sse <= 0.0 else 0.0
        return float(1.0 - sse / sst)


def _scale(train: Moments, p: int) -> np.ndarray:
    sd = np.sqrt(np.clip(np.diag(train.scatter)[:p], 0.0, None) / train.n)
    return np.where(sd > 0.0, sd, 1.0)


def _best_alpha(parts: Sequence[Moments], whole: Moments, sd: np.ndarray, alphas: np.ndarray) -> float:
    scores = np.zeros(len(alphas))
    for part in parts:
        model = _Scaled(whole - part, sd)
        scores += [model.r2(a, part) for a in alphas]
    return float(alphas[int(np.argmax(scores))])


def fit_ridge(
    df: DataFrame,
    predictors: Sequence[str],
    target: str,
    order: Sequence[str],
    alphas: np.ndarray = ALPHAS,
    folds: int = FOLDS,
    seed: int = SEED,
    centre: np.ndarray | None = None,
) -> RidgeFit:
    """Nested-CV score and the final fit; ``order`` names the day column and the columns of a unique id.

    The rule is the same at every size; a fold without rows raises ``FoldError``.
    ``centre`` saves the pass for the column means when they are known.
    """
    time, ids = order[0], list(order[1:]) or list(order)
    columns = [*predictors, target]
    rows = df.select(*order, *[c for c in columns if c not in order]).withColumn("_fold", outer_fold(ids, folds, seed))
    if centre is None:
        centre = size_and_means(rows, columns)[1]
    days, per_day = _day_counts(rows, time, folds)
    n = int(per_day.sum())
    if n == 0 or (per_day.sum(axis=0) == 0).any():
        raise FoldError(f"{n} rows leave an outer fold of {folds} empty")
    inner = {k: day_cuts(per_day.sum(axis=1) - per_day[:, k], folds) for k in range(folds)}
    full = day_cuts(per_day.sum(axis=1), folds)
    bounds = sorted({b for cuts in [full, *inner.values()] for b in cuts if b < len(days)})
    cells = rows.withColumn("_cell", _interval(time, days, bounds))
    by_cell = grouped_moments(cells, columns, ["_fold", "_cell"], centre)
    starts = [0, *bounds]

    def gather(keep) -> Moments:
        parts = [m for (fold, cell), m in by_cell.items() if keep(fold, starts[cell])]
        if not parts:
            raise FoldError(f"{n} rows leave an inner fold of {folds} empty")
        return reduce(lambda a, b: a + b, parts)

    def contiguous(cuts: Sequence[int], outside: int | None) -> list[Moments]:
        edges = [0, *cuts, len(days)]
        return [
            gather(lambda fold, at, lo=lo, hi=hi: fold != outside and lo <= at < hi) for lo, hi in zip(edges, edges[1:])
        ]

    p = len(predictors)
    scores, fold_alphas = [], []
    for k in range(folds):
        train = gather(lambda fold, at, k=k: fold != k)
        held = gather(lambda fold, at, k=k: fold == k)
        sd = _scale(train, p)
        alpha = _best_alpha(contiguous(inner[k], k), train, sd, alphas)
        fold_alphas.append(alpha)
        scores.append(_Scaled(train, sd).r2(alpha, held))

    whole = gather(lambda fold, at: True)
    sd = _scale(whole, p)
    alpha = _best_alpha(contiguous(full, None), whole, sd, alphas)
    coef = _Scaled(whole, sd).coef(alpha)
    return RidgeFit(tuple(predictors), np.array(scores), np.array(fold_alphas), alpha, coef, float(whole.mean[p]), n)
