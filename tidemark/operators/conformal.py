"""Prediction intervals: split-conformal radii, and adaptively aggregated conformal inference."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.folds import folded

#: Step sizes of the candidates, and the length of their common buffer.
GAMMAS = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.008, 0.01, 0.02, 0.04, 0.05)
BUFFER = 336


def rank(n: Column, alpha: float) -> Column:
    return F.ceil(F.round((n + 1) * F.lit(1 - alpha), 9)).cast("long")


def radii(residuals: DataFrame, alpha: float, key: str = "k", score: str = "score") -> DataFrame:
    """key, n, rank, radius: the rank-th least absolute residual; infinite for alpha <= 0 or too few, 0 for alpha >= 1."""
    w = Window.partitionBy(key)
    placed = residuals.select(key, F.abs(score).alias("s")).withColumns({"n": F.count("*").over(w), "at": F.row_number().over(w.orderBy("s"))})
    chosen = placed.withColumn("rank", rank(F.col("n"), alpha))
    infinite = F.lit(float("inf"))
    hit = F.max(F.when(F.col("at") == F.col("rank"), F.col("s")))
    radius = F.lit(0.0) if alpha >= 1 else infinite if alpha <= 0 else F.when(F.max("rank") > F.max("n"), infinite).otherwise(hit)
    return chosen.groupBy(key).agg(F.max("n").alias("n"), F.max("rank").alias("rank"), radius.alias("radius"))


def fixed_intervals(forecasts: DataFrame, radius: DataFrame, key: str = "k", p: str = "p") -> DataFrame:
    """forecasts with lower and upper: the forecast plus or minus its key's radius."""
    return forecasts.join(radius.select(key, "radius"), key).withColumns({"lower": F.col(p) - F.col("radius"), "upper": F.col(p) + F.col("radius")}).drop("radius")


def check_level(alpha: float) -> float:
    """alpha, if it lies strictly between 0 and 1."""
    if not 0 < alpha < 1:
        raise ValueError(f"level {alpha} is not between 0 and 1")
    return alpha


def valid_level(alpha: Column) -> Column:
    """Whether check_level would take a level."""
    return (alpha > 0) & (alpha < 1)


class UncertaintyQuantifier(ABC):
    """Intervals one by one: interval() for a forecast, then observe() with what came."""

    @abstractmethod
    def interval(self, forecast: float) -> tuple[float, float]: ...

    @abstractmethod
    def observe(self, forecast: float, y: float) -> None: ...


_INTERVALS = "k string, pos long, slot long, y double, p double, lower double, upper double"


def replay(forecasts: DataFrame, make: Callable[[], UncertaintyQuantifier]) -> DataFrame:
    """k, pos, slot, y, p, lower, upper: a quantifier from make() over each key's forecasts, in order."""

    def start():
        model = make()

        def step(pos, slot, y, p):
            bounds = model.interval(p)
            model.observe(p, y)
            return pos, slot, y, p, *bounds

        return step

    return folded(forecasts.select("k", "pos", "slot", "y", "p"), ["pos"], start, _INTERVALS)


def radius_of(scores, alpha: float) -> float:
    n = len(scores)
    if alpha <= 0:
        return math.inf
    if alpha >= 1:
        return 0.0
    k = math.ceil(round((n + 1) * (1 - alpha), 9))
    return math.inf if k > n else sorted(scores)[k - 1]


class Boa:
    """Bernstein online aggregation of experts for one quantile, with gradients of the pinball loss."""

    def __init__(self, experts: int, tau: float):
        self.tau, self.weights = tau, [1.0 / experts] * experts
        self.regret, self.variance = [0.0] * experts, [0.0] * experts

    def combine(self, values) -> float:
        return sum(w * v for w, v in zip(self.weights, values, strict=True))

    def update(self, values, y: float) -> None:
        mean = self.combine(values)
        slope = (1.0 if y < mean else 0.0) - self.tau
        gain = [slope * (mean - v) for v in values]
        for i, r in enumerate(gain):
            self.variance[i] += 2.2 * r * r
        etas = [1 / math.sqrt(v) if v else 0.0 for v in self.variance]
        for i, r in enumerate(gain):
            self.regret[i] += r - etas[i] * r * r
        logs = [eta * regret + (math.log(eta) if eta else -math.inf) for eta, regret in zip(etas, self.regret, strict=True)]
        top = max(logs)
        if top == -math.inf:
            return
        raw = [math.exp(x - top) for x in logs]
        total = sum(raw)
        self.weights = [x / total for x in raw]


class AgAci(UncertaintyQuantifier):
    """Adaptive conformal candidates with several step sizes over one buffer of errors, aggregated bound by bound."""

    def __init__(self, scores, alpha: float = 0.1, gammas=GAMMAS, window: int = BUFFER):
        self.alpha, self.gammas = check_level(alpha), tuple(gammas)
        self.levels = [alpha] * len(self.gammas)
        self.buffer: deque[float] = deque((abs(s) for s in scores), maxlen=window)
        self.low, self.high = Boa(len(self.gammas), alpha / 2), Boa(len(self.gammas), 1 - alpha / 2)

    def interval(self, forecast: float) -> tuple[float, float]:
        ordered = list(self.buffer)
        self._radii = [radius_of(ordered, a) for a in self.levels]
        # Only the aggregation needs a finite stand-in for an infinite radius.
        cap = 2 * max(ordered, default=0.0)
        finite = [cap if math.isinf(r) else r for r in self._radii]
        self._bounds = [forecast - r for r in finite], [forecast + r for r in finite]
        a, b = self.low.combine(self._bounds[0]), self.high.combine(self._bounds[1])
        return min(a, b), max(a, b)

    def observe(self, forecast: float, y: float) -> None:
        """To be called once for each interval, with what came."""
        for k, (g, r) in enumerate(zip(self.gammas, self._radii, strict=True)):
            missed = 0.0 if forecast - r <= y <= forecast + r else 1.0
            self.levels[k] += g * (self.alpha - missed)
        self.low.update(self._bounds[0], y)
        self.high.update(self._bounds[1], y)
        self.buffer.append(abs(y - forecast))


def agaci_intervals(forecasts: DataFrame, calibration: DataFrame, alpha: float = 0.1) -> DataFrame:
    """k, pos, slot, y, p, lower, upper: one replay over each key's forecasts, in order. calibration: k, pos, score; of a
    key's scores the last BUFFER count, which come before its forecasts."""

    def start():
        scores: deque[float] = deque(maxlen=BUFFER)
        model: AgAci | None = None

        def step(behind, pos, slot, y, p, score):
            nonlocal model
            if not behind:
                scores.append(score)
                return None
            model = model or AgAci(scores, alpha)
            bounds = model.interval(p)
            model.observe(p, y)
            return pos, slot, y, p, *bounds

        return step

    none = F.lit(None)
    past = calibration.select("k", F.lit(0).alias("behind"), "pos", none.cast("long").alias("slot"), none.cast("double").alias("y"), none.cast("double").alias("p"), "score")
    rows = past.unionByName(forecasts.select("k", F.lit(1).alias("behind"), "pos", "slot", "y", "p", none.cast("double").alias("score")))
    return folded(rows, ["behind", "pos"], start, _INTERVALS)
