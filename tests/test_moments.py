"""Moments in one pass, merged and taken away, against numpy."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxline.operators.moments import Triangle, daily_triangles, moving, triangle
from fluxline.plans import causal

T = datetime(2024, 1, 1)


def rows(n=500, k=3, seed=1, offset=1e6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) @ rng.normal(size=(k, k)) + offset * np.arange(k)
    x[rng.random((n, k)) < 0.1] = np.nan
    return x


def direct(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    return both.sum(), a.mean(), b.mean(), ((a - a.mean()) * (b - b.mean())).sum()


def check(t: Triangle, x: np.ndarray):
    k = x.shape[1]
    want = np.array([direct(x, i, j) for i, j in zip(*np.triu_indices(k))])
    for got, w in zip((t.n, t.a, t.b, t.c), want.T):
        np.testing.assert_allclose(got, w, rtol=1e-9, atol=1e-6)


def test_triangles_merge_and_subtract():
    x = rows()
    parts = [Triangle.of(x[i:j]) for i, j in ((0, 1), (1, 200), (200, 500))]
    whole = Triangle.empty(3).plus(parts[0]).plus(parts[1]).plus(parts[2])
    check(whole, x)
    check(whole.minus(parts[1]).minus(parts[0]), x[200:])
    gone = whole.minus(whole)
    assert not gone.n.any() and not gone.c.any()
    blank = Triangle.of(np.full((4, 3), np.nan))
    assert not blank.n.any() and not blank.a.any()
    n, mean, cov = whole.square(3)
    assert (n == n.T).all() and np.allclose(cov, cov.T)
    np.testing.assert_allclose(mean, np.nanmean(x, axis=0))


@pytest.mark.parametrize("missing", ["pairwise", "listwise"])
def test_one_pass_over_tasks(spark, missing):
    x = rows(2000)
    df = spark.createDataFrame([[None if i % 7 == 0 and v != v else float(v) for v in r] for i, r in enumerate(x)],
                               "a double, b double, c double").repartition(50)
    if missing == "listwise":
        x = x[~np.isnan(x).any(axis=1)]
    check(triangle(df, ["a", "b", "c"], missing), x)
    m = causal.moments(df, ["a", "b", "c"], missing)
    np.testing.assert_allclose(m.correlation()[0, 1], causal.moments(df, ["b", "a"], missing).correlation()[0, 1], rtol=0.2)
    assert causal.moments(df.where("false"), ["a"], missing).n[0, 0] == 0


def test_moving_windows(spark):
    x = rows(24 * 30, 2, offset=100.0)
    days = [d for d in range(30) if d not in (7, 8, 20)]
    data = [(T + timedelta(hours=i), *map(float, r)) for i, r in enumerate(x) if i // 24 in days]
    df = spark.createDataFrame(data, "ts timestamp, a double, b double").repartition(5)
    daily = daily_triangles(df, ["a", "b"], "ts", "pairwise")
    got = list(moving(daily, 2, 4))
    assert [(d - T.date()).days for d, _ in got] == days
    for d, t in got:
        d = (d - T.date()).days
        window = [i for i in range(len(x)) if d - 3 <= i // 24 <= d and i // 24 in days]
        check(t, x[window])


def test_moving_fits_follow_a_change(spark):
    rng = np.random.default_rng(2)
    u = rng.normal(size=600)
    y = [0.0]
    for i in range(1, 600):
        y.append((2.0 if i < 300 else -1.0) * u[i - 1] + 5.0)
    df = spark.createDataFrame([(T + timedelta(hours=i), float(a), float(b)) for i, (a, b) in enumerate(zip(u, y))],
                               "timestamp timestamp, u double, kp double")
    fits = {r.day: r for r in causal.moving_fits(df, [("u", 1)], 3).collect()}
    assert fits[(T + timedelta(days=8)).date()].coef == pytest.approx(2.0)
    late = fits[(T + timedelta(days=20)).date()]
    assert (late.coef, late.intercept, late.n) == (pytest.approx(-1.0), pytest.approx(5.0), 72)
    assert df.agg(F.count("*")).first()[0] == 600
