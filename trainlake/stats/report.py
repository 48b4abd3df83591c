"""The study: three nested models per sport, and its tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .features import MODELS, TARGETS, WEATHER_LEVELS, design, uses_weather, weather_columns
from .ols import INTERCEPT, OlsFit, fit_ols, variance_inflation
from .ridge import FoldError, RidgeFit, fit_ridge
from .triangle import triangle

# Display names of the predictors.
LABELS = {
    "readiness_score": "Readiness score",
    "hrv_weekly_avg_ms": "HRV 7-day avg (ms)",
    "sleep_score": "Sleep score",
    "recovery_time_h": "Recovery time (h)",
    "acwr": "ACWR",
    "stress_avg": "Avg daily stress",
    "temperature_c": "Temperature (°C)",
    "humidity": "Humidity",
    "wind_speed_ms": "Wind speed (m/s)",
    "hour_of_day": "Hour of day",
    "w_overcast": "Weather: overcast",
    "w_rainy": "Weather: rainy",
}


@dataclass(frozen=True)
class ModelFit:
    label: str
    ols: OlsFit
    ridge: RidgeFit | None  # None where the sample is too small for nested folds

    @property
    def n(self) -> int:
        return self.ols.n

    @property
    def cv_r2(self) -> float | None:
        return self.ridge and self.ridge.cv_r2


def fit_model(
    df: DataFrame, predictors: Sequence[str], target: str, label: str, order: Sequence[str] = ("activity_date", "activity_id"), **ridge_args
) -> ModelFit:
    """Least squares and cross-validated ridge on the complete cases of one predictor set."""
    # Read several times below; a lost block is recomputed from the mart.
    rows = design(df, predictors, target, order).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit_rows(rows, predictors, target, label, order, ridge_args)
    finally:
        rows.unpersist()


def _fit_rows(rows: DataFrame, predictors: Sequence[str], target: str, label: str, order: Sequence[str], ridge_args: dict) -> ModelFit:
    weather = weather_columns(WEATHER_LEVELS) if uses_weather(predictors) else ()
    stats = triangle(rows, [*predictors, *weather, target])
    ols_names = [*predictors, *weather[1:]]
    present = [w for w in weather if stats.mean[stats.names.index(w)] > 0.0]
    ridge_names = [*predictors, *present[1:]]
    ols = fit_ols(rows, ols_names, target, stats)
    try:
        ridge = fit_ridge(rows, ridge_names, target, order, centre=stats.pick([*ridge_names, target]).mean, **ridge_args)
    except FoldError:
        ridge = None
    return ModelFit(label, ols, ridge)


def fit_study(features: DataFrame, target: str, models: Mapping[str, Sequence[str]] = MODELS, **args) -> dict[str, ModelFit]:
    return {name: fit_model(features, predictors, target, name, **args) for name, predictors in models.items()}


def _r(value: float, places: int) -> float | None:
    return None if value is None or math.isnan(value) else round(float(value), places)


def stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


def vif_flag(v: float) -> str:
    return "⚠ >10" if v > 10 else "△ >5" if v > 5 else ""


def coefficient_table(spark: SparkSession, sport: str, fits: Mapping[str, ModelFit]) -> DataFrame:
    rows = [
        (sport, m, t, _r(b, 4), _r(se, 4), _r(z, 4), _r(p, 4))
        for m, fit in fits.items()
        for t, b, se, z, p in zip(fit.ols.names, fit.ols.beta, fit.ols.std_err, fit.ols.z, fit.ols.p)
    ]
    return spark.createDataFrame(rows, "sport string, model string, term string, coef double, std_err double, z double, p double")


def fit_table(spark: SparkSession, sport: str, fits: Mapping[str, ModelFit]) -> DataFrame:
    rows = [
        (sport, m, f.n, _r(f.ols.r2, 3), _r(f.ols.r2_adj, 3), _r(f.cv_r2, 3), _r(f.ridge and f.ridge.cv_r2_sd, 3), _r(f.ols.f_p, 4), _r(f.ridge and f.ridge.best_alpha, 4))
        for m, f in fits.items()
    ]
    return spark.createDataFrame(
        rows, "sport string, model string, n long, ols_r2 double, ols_r2_adj double, cv_r2 double, cv_r2_sd double, f_p double, best_alpha double"
    )


def comparison_table(spark: SparkSession, ride: Mapping[str, ModelFit], run: Mapping[str, ModelFit]) -> DataFrame:
    rows = [
        (m, ride[m].n, _r(ride[m].ols.r2, 3), _r(ride[m].cv_r2, 3), run[m].n, _r(run[m].ols.r2, 3), _r(run[m].cv_r2, 3))
        for m in ride
    ]
    return spark.createDataFrame(
        rows, "model string, ride_n long, ride_ols_r2 double, ride_cv_r2 double, run_n long, run_ols_r2 double, run_cv_r2 double"
    )


def vif_table(spark: SparkSession, sport: str, fits: Mapping[str, ModelFit]) -> DataFrame:
    """Inflation per predictor; single-predictor models are skipped."""
    rows = [
        (sport, m, feature, _r(v, 2), vif_flag(v))
        for m, fit in fits.items()
        if len(fit.ols.names) > 2
        for feature, v in variance_inflation(fit.ols).items()
    ]
    return spark.createDataFrame(rows, "sport string, model string, feature string, vif double, flag string")


def standardised(fit: OlsFit) -> list[tuple[str, str, float, float, float, float, str]]:
    """(term, label, beta, low, high, p, stars) in units of standard deviations, ascending."""
    sd = np.sqrt(np.diag(fit.moments.scatter) / (fit.n - 1))
    scale = sd[:-1] / sd[-1] if sd[-1] > 0 else np.ones(len(sd) - 1)
    low, high = fit.interval()
    rows = [
        (t, LABELS.get(t, t), b * s, lo * s, hi * s, p, stars(p))
        for t, b, lo, hi, p, s in zip(fit.names[1:], fit.beta[1:], low[1:], high[1:], fit.p[1:], scale)
    ]
    return sorted(rows, key=lambda r: r[2])


def standardised_table(spark: SparkSession, sport: str, fits: Mapping[str, ModelFit]) -> DataFrame:
    rows = [
        (sport, m, term, label, *map(float, (b, lo, hi, p)), mark)
        for m, fit in fits.items()
        for term, label, b, lo, hi, p, mark in standardised(fit.ols)
    ]
    return spark.createDataFrame(
        rows, "sport string, model string, term string, label string, beta double, low double, high double, p double, stars string"
    )


def readiness_table(spark: SparkSession, by_sport: Mapping[str, Mapping[str, ModelFit]]) -> DataFrame:
    """The readiness coefficient in every model that has it."""
    rows = []
    for sport, fits in by_sport.items():
        for m, fit in fits.items():
            if "readiness_score" in fit.ols.names:
                at = fit.ols.names.index("readiness_score")
                rows.append((sport, m, _r(fit.ols.beta[at], 3), _r(fit.ols.p[at], 4)))
    return spark.createDataFrame(rows, "sport string, model string, beta double, p double")


__all__ = ["INTERCEPT", "TARGETS", "ModelFit", "fit_model", "fit_study"]
