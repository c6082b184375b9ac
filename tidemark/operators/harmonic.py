"""Regression on Fourier terms with ARMA errors, fitted by Spark from sums over rows.

Two passes over the series give all that a fit needs: sums of products of the terms (normal equations), then of the errors at
each lag. What is left for Python is one small system for a key. On sines and cosines plain least squares is in the limit as
good as weighting by the errors' covariance (Grenander), so that coefficients do not wait for the errors' model. The errors'
parameters come in two regressions (Hannan and Rissanen): a long autoregression stands for the shocks, then errors are
regressed on errors and shocks before them; both need no more than autocovariances.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import forecast, spread
from tidemark.sources.shared import written
from tidemark.sources.shipping import ship_package

#: Harmonics of each period, in rows, and orders of the errors' model.
PERIODS = {48: 4, 336: 4}
AR, MA = 2, 2
#: Order of the long autoregression.
LONG = 24
#: A root of the fitted errors' model is brought to this modulus if it is larger, so that forecasts die out.
STABLE = 0.999


def design(step: Column, periods: dict[int, int] = PERIODS) -> list[Column]:
    """One, and a sine and a cosine for each harmonic of each period."""
    return [F.lit(1.0), *forecast.fourier(step, periods)]


def normal_equations(rows: DataFrame, columns: Sequence[Column], y: str = "y", key: str = "k") -> DataFrame:
    """key, n, xx (the upper triangle of X'X, row by row) and xy (X'y): partial sums in the JVM, one row for each key."""
    named = rows.select(key, F.col(y).alias("_y"), *(c.alias(f"_x{i}") for i, c in enumerate(columns)))
    size = len(columns)
    xx = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(size) for j in range(i, size)]
    xy = [F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(size)]
    return named.groupBy(key).agg(F.count("*").alias("n"), F.array(*xx).alias("xx"), F.array(*xy).alias("xy"))


def solved(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Least squares from normal_equations; the shortest solution where columns depend on each other."""
    size = len(xy)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = xx
    return np.linalg.lstsq(full + np.triu(full, 1).T, xy, rcond=None)[0]


def coefficients(rows: DataFrame, columns: Sequence[Column], y: str = "y") -> DataFrame:
    """k, n, beta of y's least squares on columns."""
    ship_package(rows.sparkSession)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[["k", "n"]].assign(beta=[solved(a, b) for a, b in zip(part["xx"], part["xy"], strict=True)])

    return normal_equations(rows, columns, y).mapInPandas(solve, "k string, n long, beta array<double>")


def errors(rows: DataFrame, beta: DataFrame, columns: Sequence[Column], y: str = "y") -> DataFrame:
    """rows of the keys of beta with mean, the regression's value, and e, what y has beyond it."""
    mean = sum((F.col("_beta")[i] * c for i, c in enumerate(columns)), F.lit(0.0))
    found = rows.join(beta.select("k", F.col("beta").alias("_beta")), "k").withColumn("mean", mean)
    return found.withColumn("e", F.col(y) - F.col("mean")).drop("_beta")


def autocovariances(rows: DataFrame, most: int, value: str = "e", size: int = 4 * spread.PIECE) -> DataFrame:
    """k, gamma: for each lag up to most the mean product of value and itself that many places earlier (sums over the places
    there are, by the number of rows, so that the sequence is positive semidefinite). rows: k, pos without holes, value."""
    cut = spread.haloed(rows.select("k", "pos", F.col(value).alias("_v")), most, size)
    w = Window.partitionBy(*spread.by_piece()).orderBy("pos")
    lagged = spread.own(cut.withColumns({f"_v{n}": F.lag("_v", n).over(w) for n in range(1, most + 1)}))
    products = [F.sum(F.col("_v") * F.col("_v"))] + [F.sum(F.col("_v") * F.coalesce(F.col(f"_v{n}"), F.lit(0.0))) for n in range(1, most + 1)]
    return lagged.groupBy("k").agg(F.array(*(p / F.count("*") for p in products)).alias("gamma"))


def stable(phi: np.ndarray) -> np.ndarray:
    """phi with the recursion's roots brought within STABLE, by the same share each."""
    largest = float(np.abs(np.roots(np.append(1.0, -phi))).max()) if len(phi) else 0.0
    return phi if largest <= STABLE else phi * (STABLE / largest) ** np.arange(1, len(phi) + 1)


def arma(gamma: np.ndarray, ar: int = AR, ma: int = MA, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phi, theta, whitening weights of an error and those before it) from autocovariances up to a lag of at least ma more
    than the long autoregression's order. Errors that are nothing beside scale squared have no model: all zero."""
    gamma = np.asarray(gamma, float)
    order = len(gamma) - 1 - max(ar, ma)
    if not gamma[0] > 1e-18 * scale * scale:
        return np.zeros(ar), np.zeros(ma), np.append(1.0, np.zeros(order))
    at = lambda i: gamma[np.abs(i)]
    lags = np.arange(order)
    long = np.linalg.solve(at(lags[:, None] - lags[None, :]) + 1e-9 * gamma[0] * np.eye(order), gamma[1 : order + 1])
    white = np.append(1.0, -long)
    taps = np.arange(order + 1)
    # Mean products of an error i places back and a shock j places back, and of two shocks.
    mixed = lambda i, j: float(white @ at(j + taps - i))
    shocks = lambda i, j: float(white @ at((i + taps)[:, None] - (j + taps)[None, :]) @ white)
    kinds = [("e", i) for i in range(1, ar + 1)] + [("u", j) for j in range(1, ma + 1)]

    def moment(a: tuple[str, int], b: tuple[str, int]) -> float:
        if a[0] == b[0]:
            return float(at(a[1] - b[1])) if a[0] == "e" else shocks(a[1], b[1])
        return mixed(a[1], b[1]) if a[0] == "e" else mixed(b[1], a[1])

    left = np.array([[moment(a, b) for b in kinds] for a in kinds])
    found = np.linalg.lstsq(left, np.array([moment(("e", 0), a) for a in kinds]), rcond=1e-9)[0]
    return stable(found[:ar]), found[ar:], white


def ahead(phi: np.ndarray, late: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """What the recursion e = phi[0] e(-1) + phi[1] e(-2) ... comes to after each of steps, from late, its last values (latest
    first): by squaring the recursion's matrix, so that a far step costs no more than its digits."""
    size = len(phi)
    move = np.vstack([phi, np.eye(size)[:-1]])
    state = np.repeat(np.asarray(late, float)[:, None], len(steps), axis=1)
    left = np.asarray(steps, np.int64).copy()
    while left.any():
        odd = left % 2 == 1
        state[:, odd] = move @ state[:, odd]
        move, left = move @ move, left // 2
    return state[0]


def fitted(train: DataFrame, periods: dict[int, int] = PERIODS, ar: int = AR, ma: int = MA, long: int = LONG) -> DataFrame:
    """k, n, beta, phi, theta, late: a fit for each key of train (k, pos from 0 without holes, y without nulls). late has the
    errors of the last step and those before it, as far as forecasts need them, the moving average's share behind ma steps
    worked in: the forecast errors of steps ma, ma - 1 and so on. Keys with fewer rows than columns and lags have no fit.
    """
    if ar < ma:
        raise ValueError("forecasts are kept as ar values: ar may not be less than ma")
    columns = design(F.col("pos"), periods)
    # A row for each key, used three times below: written, so that the pass over train is made once.
    beta, _ = written(coefficients(train, columns).filter(F.col("n") > len(columns) + long + ar + ma), "beta")
    rows = errors(train, beta, columns)
    reach = long + max(ar, ma)
    last = rows.join(beta.select("k", "n"), "k").filter(F.col("pos") >= F.col("n") - reach)
    ends = last.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("ends"), F.max(F.abs("y")).alias("scale"))
    stats = beta.join(autocovariances(rows, reach), "k").join(ends.select("k", F.col("ends.e").alias("ends"), "scale"), "k")

    def model(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for gamma, end, scale in zip(part["gamma"], part["ends"], part["scale"], strict=True):
                phi, theta, white = arma(gamma, ar, ma, scale)
                e = list(np.asarray(end, float))
                u = [float(white @ np.asarray(e[len(e) - len(white) - i : len(e) - i])[::-1]) for i in range(ma - 1, -1, -1)]
                for step in range(ma):
                    known = sum(t * u[len(u) - 1 - j + step] for j, t in enumerate(theta) if j >= step)
                    e.append(sum(p * e[-1 - i] for i, p in enumerate(phi)) + known)
                out.append((phi, theta, e[: -ar - 1 : -1]))
            yield part[["k", "n", "beta"]].assign(phi=[x[0] for x in out], theta=[x[1] for x in out], late=[x[2] for x in out])

    return stats.mapInPandas(model, "k string, n long, beta array<double>, phi array<double>, theta array<double>, late array<double>")


def forecasts(series: DataFrame, first: int, periods: dict[int, int] = PERIODS, ar: int = AR, ma: int = MA) -> DataFrame:
    """k, pos, slot, y, p of the rows of series (k, pos, slot, y) from place first on: fitted once on those before it. What is
    observed later changes nothing, as the phase and the errors count from the fit. Keys without a fit have no rows."""
    model, _ = written(fitted(series.filter(F.col("pos") < first), periods, ar, ma), "harmonic")
    rows = errors(series.filter(F.col("pos") >= first), model, design(F.col("pos"), periods))
    rows = rows.join(model.select("k", "phi", "late"), "k").select("k", "pos", "slot", "y", "mean", "phi", "late")

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            error = np.zeros(len(part))
            for places in part.groupby("k", dropna=False).indices.values():
                one = part.iloc[places]
                # late stands at step ma; its own entries are the steps up to it.
                steps, late = one["pos"].to_numpy() - first + 1 - ma, np.asarray(one["late"].iloc[0], float)
                early = np.where(steps <= 0, late[np.clip(-steps, 0, len(late) - 1)], 0.0)
                error[places] = np.where(steps <= 0, early, ahead(np.asarray(one["phi"].iloc[0], float), late, np.maximum(steps, 0)))
            yield part[["k", "pos", "slot", "y"]].assign(p=part["mean"] + error)

    return rows.mapInPandas(put, "k string, pos long, slot long, y double, p double")
