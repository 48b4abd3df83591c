import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trainlake.stats import distributions as D
from trainlake.stats.features import design, engineer
from trainlake.stats.gram import moments
from trainlake.stats.ols import fit_ols, variance_inflation
from trainlake.stats.report import fit_model, standardised
from trainlake.stats.ridge import ALPHAS, FoldError, fit_ridge, outer_fold
from trainlake.stats.triangle import triangle


def make(n=80, p=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1.0, 5.0, 0.2] + [100.0, -3.0, 7.0]
    y = 2.0 + x @ [0.5, -1.0, 3.0] + rng.normal(size=n) * (0.5 + np.abs(x[:, 0] - 100))
    return x, y


def frame(spark, x, y):
    rows = [(i, f"2024-01-{1 + i % 28:02d}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    names = ", ".join(f"x{j} double" for j in range(x.shape[1]))
    return spark.createDataFrame(rows, f"id long, day string, {names}, y double").repartition(4)


def test_ols_equals_direct_algebra(spark):
    x, y = make()
    fit = fit_ols(frame(spark, x, y), ["x0", "x1", "x2"], "y")
    X = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    inv = np.linalg.inv(X.T @ X)
    e = y - X @ beta
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    cov = inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv
    r2 = 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))
    assert np.allclose(fit.beta, beta, rtol=1e-9)
    assert np.allclose(fit.covariance, cov, rtol=1e-7)
    assert fit.r2 == pytest.approx(r2, abs=1e-12)
    wald = beta[1:] @ np.linalg.inv(cov[1:, 1:]) @ beta[1:] / 3
    assert fit.f_value == pytest.approx(wald, rel=1e-8)
    assert 0 <= fit.f_p < 1e-6


def test_nearly_collinear_slopes_keep_their_digits(spark):
    """Sums of products lose such slopes altogether."""
    rng = np.random.default_rng(8)
    x0 = rng.normal(size=400) + 50
    x = np.column_stack([x0, x0 + 1e-7 * rng.normal(size=400), 1000 * rng.normal(size=400)])
    y = x @ [2.0, -1.5, 0.01] + 1e-6 * rng.normal(size=400)
    fit = fit_ols(frame(spark, x, y), ["x0", "x1", "x2"], "y")
    centred = x - x.mean(axis=0)
    slopes, *_ = np.linalg.lstsq(centred / np.linalg.norm(centred, axis=0), y - y.mean(), rcond=None)
    slopes /= np.linalg.norm(centred, axis=0)
    assert np.allclose(fit.beta[1:], slopes, rtol=1e-8)
    gram = np.linalg.pinv(centred.T @ centred) @ centred.T @ (y - y.mean())
    assert not np.allclose(gram, slopes, rtol=1e-3)


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_triangle_of_any_layout(spark, partitions):
    x, y = make(n=300)
    df = frame(spark, x, y).repartition(partitions).union(frame(spark, x[:0], y[:0]))
    t = triangle(df, ["x0", "x1", "x2", "y"])
    rows = np.column_stack([np.ones(300), np.column_stack([x, y]) - t.centre])
    assert np.allclose(t.r.T @ t.r, rows.T @ rows) and t.n == 300 and (np.diag(t.r) >= 0).all()
    some = t.pick(["y", "x1"])
    assert np.allclose(some.mean, [y.mean(), x[:, 1].mean()]) and np.allclose(some.scatter, np.cov(y, x[:, 1]) * 299)


def test_vif_equals_auxiliary_regressions(spark):
    x, y = make()
    x[:, 2] = x[:, 0] * 0.3 + x[:, 2]
    fit = fit_ols(frame(spark, x, y), ["x0", "x1", "x2"], "y")
    for j, v in enumerate(variance_inflation(fit).values()):
        others = np.column_stack([np.ones(len(y)), np.delete(x, j, 1)])
        b, *_ = np.linalg.lstsq(others, x[:, j], rcond=None)
        e = x[:, j] - others @ b
        c = x[:, j] - x[:, j].mean()
        assert v == pytest.approx((c @ c) / (e @ e), rel=1e-9)


def direct_ridge(x, y, folds_of, day, folds=5):
    """Plain numpy version of the nested search, row by row."""

    def fit(z, t, a):
        zm, tm = z.mean(0), t.mean()
        b = np.linalg.solve((z - zm).T @ (z - zm) + a * np.eye(z.shape[1]), (z - zm).T @ (t - tm))
        return lambda q: tm + (q - zm) @ b

    def r2(f, z, t):
        e = t - f(z)
        return 1 - e @ e / ((t - t.mean()) @ (t - t.mean()))

    def search(z, t, when):
        # A day belongs to the fifth in which its first row falls.
        part = np.array([min((when < d).sum() * folds // len(when), folds - 1) for d in when])
        score = np.zeros(len(ALPHAS))
        for j in range(folds):
            score += [r2(fit(z[part != j], t[part != j], a), z[part == j], t[part == j]) for a in ALPHAS]
        return ALPHAS[np.argmax(score)]

    scores = []
    for k in range(folds):
        tr, te = folds_of != k, folds_of == k
        m, s = x[tr].mean(0), x[tr].std(0)
        z = (x[tr] - m) / s
        a = search(z, y[tr], day[tr])
        scores.append(r2(fit(z, y[tr], a), (x[te] - m) / s, y[te]))
    z = (x - x.mean(0)) / x.std(0)
    return np.array(scores), search(z, y, day)


def test_ridge_equals_row_level_search(spark):
    """Rows, several a day, against a search that fits every fold on the rows themselves."""
    for n, seed in ((83, 0), (400, 3)):
        x, y = make(n, seed=seed)
        df = frame(spark, x, y).withColumn("day", F.expr("date_add(DATE '2024-01-01', cast(id / 3 as int))"))
        got = fit_ridge(df, ["x0", "x1", "x2"], "y", ["day", "id"])
        held = {r["id"]: r["f"] for r in df.select("id", outer_fold(["id"]).alias("f")).collect()}
        folds_of = np.array([held[i] for i in range(n)])
        assert [hashed(i) for i in range(n)] == folds_of.tolist()
        scores, alpha = direct_ridge(x, y, folds_of, day=np.arange(n) // 3)
        assert np.allclose(got.scores, scores, atol=1e-9)
        assert got.best_alpha == pytest.approx(alpha)


def hashed(i):
    return int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16) % 5


def test_ridge_needs_a_row_per_fold(spark):
    x, y = make(4)
    with pytest.raises(FoldError):
        fit_ridge(frame(spark, x, y), ["x0"], "y", ["id"])
    # All rows on one day: no inner folds in time.
    x, y = make(60)
    with pytest.raises(FoldError):
        fit_ridge(frame(spark, x, y).withColumn("day", F.lit(1)), ["x0"], "y", ["day", "id"])


def test_vif_of_a_collinear_set(spark):
    rng = np.random.default_rng(8)
    a, b, c = rng.standard_normal((3, 200))
    x = np.stack([a, b, a + b, c], axis=1)
    fit = fit_ols(frame(spark, x, a + c), ["x0", "x1", "x2", "x3"], "y")
    vif = variance_inflation(fit)
    others = np.column_stack([np.ones(200), a, b])
    rest = c - others @ np.linalg.lstsq(others, c, rcond=None)[0]
    assert vif["x0"] == vif["x1"] == vif["x2"] == np.inf
    assert vif["x3"] == pytest.approx(((c - c.mean()) ** 2).sum() / (rest**2).sum())


def test_tails():
    assert D.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    # F(1, d2) is the square of t(d2); t(2) has a closed form.
    t = 3.0
    assert D.f_upper_tail(t * t, 1, 2) == pytest.approx(1 - t / np.sqrt(2 + t * t), abs=1e-12)
    # F(2, d2): (1 + 2f/d2) ** (-d2/2)
    assert D.f_upper_tail(1.7, 2, 30) == pytest.approx((1 + 2 * 1.7 / 30) ** -15, abs=1e-12)


def test_tails_of_many_degrees_of_freedom():
    # Two degrees of freedom above: an exponential, whatever lies below.
    assert D.chi2_upper_tail(7.0, 2) == pytest.approx(np.exp(-3.5), rel=1e-12)
    assert D.chi2_upper_tail(0.4, 2) == pytest.approx(np.exp(-0.2), rel=1e-12)
    # Four degrees of freedom: (1 + x/2) exp(-x/2).
    assert D.chi2_upper_tail(30.0, 4) == pytest.approx(16 * np.exp(-15), rel=1e-12)
    assert D.f_upper_tail(1.7, 2, 1e12) == pytest.approx(np.exp(-1.7), rel=1e-6)
    assert D.f_upper_tail(3.0, 5, 0.99e7) == pytest.approx(D.f_upper_tail(3.0, 5, 1.01e7), rel=1e-5)


def test_study_uses_weather_levels(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        rain = [None, float("nan"), 0.01, 0.3][i % 4]
        cloud = [0.9, 0.1, None][i % 3]
        rows.append((i, f"2024-01-{1 + i % 28:02d}", f"2024-01-01 {i % 24:02d}:10:00", 50.0 + rng.normal(), 15 + rng.normal(),
                     rng.random(), 3 + rng.random(), rain, cloud, None if i == 7 else 200 + rng.normal()))
    df = spark.createDataFrame(
        rows,
        "activity_id long, activity_date string, started string, readiness_score double, temperature_c double, humidity double,"
        " wind_speed_ms double, precipitation_intensity double, cloud_cover_fraction double, average_watts double",
    ).withColumn("started_at", F.col("started").cast("timestamp_ntz"))
    eng = engineer(df)
    levels = {r["weather_category"] for r in eng.collect()}
    assert levels == {"clear", "overcast", "rainy"}
    fit = fit_model(eng, ["readiness_score", "temperature_c", "humidity", "wind_speed_ms", "hour_of_day"], "average_watts", "B")
    assert fit.n == 119
    assert fit.ols.names[-2:] == ("w_overcast", "w_rainy")
    assert fit.ridge.names[-2:] == ("w_overcast", "w_rainy")
    betas = [r[2] for r in standardised(fit.ols)]
    assert betas == sorted(betas)


def test_moments_are_centred(spark):
    x, y = make()
    m = moments(frame(spark, x, y), ["x0", "y"])
    assert m.mean == pytest.approx([x[:, 0].mean(), y.mean()])
    assert m.scatter[0, 1] / 79 == pytest.approx(np.cov(x[:, 0], y)[0, 1])


def test_row_that_decides_a_coefficient_alone(spark):
    x, y = make(30)
    x[:, 2] = 0.0
    x[4, 2] = 1.0
    fit = fit_ols(frame(spark, x, y), ["x0", "x1", "x2"], "y")
    assert fit.n == 30 and np.isfinite(fit.beta).all()
    x[4, 2] = 0.0
    fit = fit_ols(frame(spark, x, y), ["x0", "x1", "x2"], "y")
    assert fit.beta[3] == pytest.approx(0.0, abs=1e-9)
    assert np.isnan(variance_inflation(fit)["x2"])
