"""Regression on Fourier terms with ARMA errors, fitted from sums over rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import harmonic


def simulated(n, phi, theta, seed):
    random = np.random.default_rng(seed)
    shocks, e = random.normal(size=n + 200), np.zeros(n + 200)
    for t in range(2, n + 200):
        e[t] = phi[0] * e[t - 1] + phi[1] * e[t - 2] + shocks[t] + theta[0] * shocks[t - 1] + theta[1] * shocks[t - 2]
    return e[200:], shocks[200:]


def biased(e, most):
    return np.array([e[h:] @ e[: len(e) - h] / len(e) for h in range(most + 1)])


def terms(n, periods):
    t, out = np.arange(n), [np.ones(n)]
    for period, harmonics in periods.items():
        for h in range(1, harmonics + 1):
            out += [np.sin(2 * np.pi * h * t / period), np.cos(2 * np.pi * h * t / period)]
    return np.stack(out, axis=1)


@pytest.mark.parametrize(("phi", "theta"), [((0.6, -0.2), (0.5, 0.0)), ((0.9, -0.3), (0.4, 0.2)), ((0.3, 0.4), (-0.5, 0.1))])
def test_parameters_of_simulated_errors(phi, theta):
    e, _ = simulated(40_000, phi, theta, 5)
    found = harmonic.arma(biased(e, harmonic.LONG + 2))
    assert abs(found[0] - phi).max() < 0.1 and abs(found[1] - theta).max() < 0.1
    assert abs(found[2][:2] - [1.0, -(phi[0] + theta[0])]).max() < 0.05


def test_errors_that_are_nothing_and_roots_outside():
    phi, theta, white = harmonic.arma(np.zeros(harmonic.LONG + 3))
    assert not phi.any() and not theta.any() and white[0] == 1.0 and not white[1:].any()
    assert abs(np.roots(np.append(1.0, -harmonic.stable(np.array([2.5, -1.0]))))).max() <= harmonic.STABLE + 1e-9


def test_steps_ahead_follow_the_recursion():
    phi, e = np.array([0.7, 0.2]), [3.0, -2.0]
    for _ in range(40):
        e.append(0.7 * e[-1] + 0.2 * e[-2])
    assert np.allclose(harmonic.ahead(phi, np.array([-2.0, 3.0]), np.arange(1, 41)), e[2:])


def test_fit_equals_numpy_and_forecasts_follow_it(spark):
    n, first = 1_500, 1_400
    data, expected = [], {}
    for seed, k in enumerate(("a", "b")):
        e, _ = simulated(n, (0.6, -0.2), (0.5, 0.1), seed)
        x = terms(n, harmonic.PERIODS)
        y = x @ np.linspace(5, 1, x.shape[1]) + e
        beta = np.linalg.lstsq(x[:first], y[:first], rcond=None)[0]
        left = y[:first] - x[:first] @ beta
        phi, theta, white = harmonic.arma(biased(left, harmonic.LONG + 2), scale=100.0)
        u = [white @ left[first - 1 - i - np.arange(len(white))] for i in range(2)]
        ahead = [phi[0] * left[-1] + phi[1] * left[-2] + theta[0] * u[0] + theta[1] * u[1]]
        ahead.append(phi[0] * ahead[0] + phi[1] * left[-1] + theta[1] * u[0])
        while len(ahead) < n - first:
            ahead.append(phi[0] * ahead[-1] + phi[1] * ahead[-2])
        expected[k] = (beta, phi, theta, x[first:] @ beta + ahead)
        data += [(k, i, i * 10, float(v)) for i, v in enumerate(y)]
    data += [("short", i, i * 10, 1.0) for i in range(20)]
    series = spark.createDataFrame(data, "k string, pos long, slot long, y double").repartition(5)
    # Small pieces: a key's errors are spread over several.
    rows = harmonic.errors(series.filter(F.col("pos") < first), harmonic.coefficients(series.filter(F.col("pos") < first), harmonic.design(F.col("pos"))), harmonic.design(F.col("pos")))
    whole, pieces = ({r.k: r.gamma for r in harmonic.autocovariances(rows, 26, size=s).collect()} for s in (10_000, 64))
    assert np.allclose(whole["a"], pieces["a"])
    found = {r.k: r for r in harmonic.fitted(series.filter(F.col("pos") < first)).collect()}
    assert set(found) == {"a", "b"}
    for k, (beta, phi, theta, _) in expected.items():
        assert np.allclose(found[k].beta, beta) and np.allclose(found[k].phi, phi) and np.allclose(found[k].theta, theta)
    out = harmonic.forecasts(series, first).orderBy("k", "pos").collect()
    for k, (*_, p) in expected.items():
        assert np.allclose([r.p for r in out if r.k == k], p)
    assert len(out) == 2 * (n - first)


def test_no_rows_and_exact_series(spark):
    schema = "k string, pos long, slot long, y double"
    assert harmonic.forecasts(spark.createDataFrame([], schema), 10).count() == 0
    y = terms(500, harmonic.PERIODS) @ np.arange(1.0, 18.0)
    series = spark.createDataFrame([("a", i, i, float(v)) for i, v in enumerate(y)], schema)
    assert all(abs(r.y - r.p) < 1e-6 for r in harmonic.forecasts(series, 400).collect())
