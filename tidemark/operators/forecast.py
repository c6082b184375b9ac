"""Forecasters behind one contract: fit on history, predict, observe what came."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import over


def seasonal_naive(y: str = "y", season: int = 48, key: str | Sequence[str] = "k", order: str = "pos") -> Column:
    """The value one season of rows earlier, on a gap-free grid or by position."""
    return F.lag(y, season).over(over(key, order))


def fourier(step: Column, periods: dict[int, int]) -> list[Column]:
    """Sine and cosine columns for each period's harmonics."""
    out = []
    for period, harmonics in periods.items():
        for h in range(1, harmonics + 1):
            angle = 2 * F.pi() * h * step / period
            out += [F.sin(angle).alias(f"sin_{period}_{h}"), F.cos(angle).alias(f"cos_{period}_{h}")]
    return out


def lag_features(series: DataFrame, lags: Sequence[int], y: str = "y", key: str = "k", order: str = "pos") -> DataFrame:
    """series with y_lag_<n>; exact in time on a gap-free grid. All lags share one sort."""
    w = over(key, order)
    return series.withColumns({f"y_lag_{n}": F.lag(y, n).over(w) for n in lags})


class Forecaster(ABC):
    """One series at a time; values come in order."""

    @abstractmethod
    def fit(self, y: Sequence[float]) -> Forecaster: ...

    @abstractmethod
    def predict(self, n: int) -> list[float]: ...

    @abstractmethod
    def observe(self, y: Sequence[float]) -> None: ...


class SeasonalNaive(Forecaster):
    def __init__(self, season: int = 48):
        self.season, self.history = season, []

    def fit(self, y):
        self.history = list(y)
        return self

    def predict(self, n):
        if len(self.history) < self.season:
            raise ValueError("history is shorter than a season")
        return [self.history[len(self.history) - self.season + i % self.season] for i in range(n)]

    def observe(self, y):
        self.history += list(y)


class HistoryMean(Forecaster):
    """The mean of what it was fitted on; what comes later changes nothing until the next fit."""

    def fit(self, y):
        self.mean = float(np.mean(y))
        return self

    def predict(self, n):
        return [self.mean] * n

    def observe(self, y):
        pass


class LinearAr(Forecaster):
    """A linear autoregression by ridge regression; each one-step forecast feeds the lags of those behind it."""

    def __init__(self, lags: int = 48, penalty: float = 1.0):
        self.lags, self.penalty = lags, penalty

    def fit(self, y):
        y = np.asarray(y, float)
        if len(y) <= self.lags:
            raise ValueError("history is shorter than the lags")
        x = np.stack([y[self.lags - k : len(y) - k] for k in range(1, self.lags + 1)] + [np.ones(len(y) - self.lags)], axis=1)
        self.weights = np.linalg.solve(x.T @ x + self.penalty * np.eye(self.lags + 1), x.T @ y[self.lags :])
        self.past = y[-self.lags :].tolist()
        return self

    def predict(self, n):
        past, out = list(self.past), []
        for _ in range(n):
            out.append(float(np.dot(self.weights[:-1], past[: -self.lags - 1 : -1]) + self.weights[-1]))
            past.append(out[-1])
        return out

    def observe(self, y):
        self.past = (self.past + list(y))[-self.lags :]


class BlockRidge(Forecaster):
    """Horizon-sized blocks from a scaled input window by ridge regression: a linear stand-in for a neural block model."""

    def __init__(self, horizon: int = 48, window: int = 336, penalty: float = 1.0):
        self.horizon, self.window, self.penalty = horizon, window, penalty

    def fit(self, y):
        y = np.asarray(y, float)
        self.centre, self.scale = float(np.median(y)), float(np.subtract(*np.percentile(y, [75, 25]))) or 1.0
        z = (y - self.centre) / self.scale
        starts = range(0, len(z) - self.window - self.horizon + 1, max(1, self.horizon // 4))
        if not len(starts):
            raise ValueError("history is shorter than a window and a horizon")
        x = np.stack([np.append(z[s : s + self.window], 1.0) for s in starts])
        t = np.stack([z[s + self.window : s + self.window + self.horizon] for s in starts])
        self.weights = np.linalg.solve(x.T @ x + self.penalty * np.eye(x.shape[1]), x.T @ t)
        self.history = list(z[-self.window :])
        return self

    def predict(self, n):
        z, out = list(self.history), []
        while len(out) < n:
            block = np.append(z[-self.window :], 1.0) @ self.weights
            z += block.tolist()
            out += block.tolist()
        return [v * self.scale + self.centre for v in out[:n]]

    def observe(self, y):
        self.history = (self.history + [(v - self.centre) / self.scale for v in y])[-self.window :]


def replay(series: DataFrame, make, first: int, block: int = 48) -> DataFrame:
    """k, pos, slot, y, p: fit on each key's first rows, then forecast block by block, observing each block behind it."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")[["k", "pos", "slot", "y"]]
        y = rows["y"].tolist()
        if len(y) <= first:
            return rows.head(0).assign(p=pd.Series(dtype="float64"))
        model, p = make().fit(y[:first]), []
        for at in range(first, len(y), block):
            actual = y[at : at + block]
            p += model.predict(len(actual))
            model.observe(actual)
        return rows.iloc[first:].assign(p=p)

    return series.select("k", "pos", "slot", "y").groupBy("k").applyInPandas(run, "k string, pos long, slot long, y double, p double")


def ahead(history: DataFrame, make, n: int) -> DataFrame:
    """k, step, p: a model fitted on each key's rows, and its n forecasts behind them; a key too short for it has none."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            p = make().fit(rows.sort_values("pos")["y"].tolist()).predict(n)
        except ValueError:
            p = []
        return pd.DataFrame({"k": [rows["k"].iloc[0]] * len(p), "step": range(1, len(p) + 1), "p": p})

    return history.select("k", "pos", "y").groupBy("k").applyInPandas(run, "k string, step int, p double")
