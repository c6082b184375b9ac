"""Drift detectors. One class serves batch (a grouped map over each series) and streaming (a stateful processor)."""

from __future__ import annotations

import math
import random
from abc import ABC, abstractmethod
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from tidemark.operators.folds import folded

ALARM_SCHEMA = "k string, pos long, us long, statistic double"


class Detector(ABC):
    """update takes a value and says whether the stream has drifted; after an alarm the next value meets a fresh detector."""

    statistic: float | None = None

    def __init__(self) -> None:
        self._fired = False
        self.reset()

    @abstractmethod
    def reset(self) -> None: ...

    @abstractmethod
    def _step(self, x: float) -> bool: ...

    def update(self, x: float) -> bool:
        if self._fired:
            self.reset()
        self._fired = self._step(x)
        return self._fired

    def detect(self, values) -> list[int]:
        """Positions of the alarms in one pass over the values."""
        self._fired = False
        self.reset()
        return [i for i, x in enumerate(values) if self.update(float(x))]


class PageHinkley(Detector):
    """Page's cumulative test with forgetting, upward, downward or both."""

    def __init__(self, min_instances: int = 30, delta: float = 0.005, threshold: float = 50.0, alpha: float = 0.9999, mode: str = "both"):
        self.min_instances, self.delta, self.threshold, self.alpha, self.mode = min_instances, delta, threshold, alpha, mode
        super().__init__()

    def reset(self) -> None:
        self.n, self.mean, self.up, self.down, self.least, self.most = 0, 0.0, 0.0, 0.0, math.inf, -math.inf
        self.statistic = None

    def _step(self, x: float) -> bool:
        self.n += 1
        self.mean += (x - self.mean) / self.n
        gap = x - self.mean
        self.up = self.alpha * self.up + gap - self.delta
        self.down = self.alpha * self.down + gap + self.delta
        self.least, self.most = min(self.least, self.up), max(self.most, self.down)
        rise, fall = self.up - self.least, self.most - self.down
        if self.n < self.min_instances:
            self.statistic = None
            return False
        self.statistic = max(rise, fall)
        return self.mode in ("up", "both") and rise > self.threshold or self.mode in ("down", "both") and fall > self.threshold


class Adwin(Detector):
    """Adaptive windowing over an exponential histogram."""

    def __init__(self, delta: float = 0.002, clock: int = 32, min_window_length: int = 5, buckets: int = 5):
        self.delta, self.clock, self.shortest, self.buckets = delta, clock, min_window_length, buckets
        super().__init__()

    def reset(self) -> None:
        # rows[i]: buckets of 2**i values as (sum, sum of squared deviations), newest last.
        self.rows: list[deque[tuple[float, float]]] = [deque()]
        self.ticks = self.width = 0
        self.total = self.spread = 0.0

    def _insert(self, x: float) -> None:
        if self.width:
            self.spread += self.width * (x - self.total / self.width) ** 2 / (self.width + 1)
        self.width += 1
        self.total += x
        self.rows[0].append((x, 0.0))
        for i, row in enumerate(self.rows):
            if len(row) <= self.buckets:
                break
            size = 1 << i
            (a, va), (b, vb) = row.popleft(), row.popleft()
            if i + 1 == len(self.rows):
                self.rows.append(deque())
            self.rows[i + 1].append((a + b, va + vb + size / 2 * (a / size - b / size) ** 2))

    def _drop_oldest(self) -> None:
        size = 1 << (len(self.rows) - 1)
        total, spread = self.rows[-1].popleft()
        self.width -= size
        self.total -= total
        if self.width:
            self.spread -= spread + size * self.width / (size + self.width) * (total / size - self.total / self.width) ** 2
        while len(self.rows) > 1 and not self.rows[-1]:
            self.rows.pop()

    def _cut_exists(self) -> bool:
        n0, s0 = 0, 0.0
        variance = max(0.0, self.spread / self.width)
        d = math.log(2 * math.log(self.width) / self.delta)
        for i in range(len(self.rows) - 1, -1, -1):
            for total, _ in self.rows[i]:
                n0 += 1 << i
                s0 += total
                n1 = self.width - n0
                if n1 < self.shortest:
                    return False
                if n0 < self.shortest:
                    continue
                m = 1 / (n0 - self.shortest + 1) + 1 / (n1 - self.shortest + 1)
                if abs(s0 / n0 - (self.total - s0) / n1) > math.sqrt(2 * m * variance * d) + 2 / 3 * m * d:
                    return True
        return False

    def _step(self, x: float) -> bool:
        self.ticks += 1
        self._insert(x)
        if self.ticks % self.clock or self.width <= 10:
            return False
        fired = False
        while self.width > 10 and self._cut_exists():
            fired = True
            self._drop_oldest()
        self.statistic = self.total / self.width if self.width else None
        return fired


def ks_critical(n: int, alpha: float) -> int:
    """Least count h of n for which the exact two-sample p-value of D = h / n, with two samples of n, is at most alpha."""
    whole = math.comb(2 * n, n)
    for h in range(1, n + 1):
        p = 2 * sum((-1) ** (k - 1) * math.comb(2 * n, n - k * h) for k in range(1, n // h + 1))
        if p <= Fraction(alpha) * whole:
            return h
    return n + 1


class Kswin(Detector):
    """Kolmogorov-Smirnov test of the newest values against a sample of the older ones in a sliding window.

    The newest values are kept sorted, one going in and one out at each step; distances come from searches in sorted arrays.
    """

    def __init__(self, alpha: float = 0.005, window_size: int = 100, stat_size: int = 30, seed: int | None = 42):
        self.alpha, self.size, self.stat, self.seed = alpha, window_size, stat_size, seed
        self.critical = ks_critical(stat_size, alpha)
        super().__init__()

    def reset(self) -> None:
        # Twice as long as the window, so that its values are always a slice.
        self.values, self.end = np.empty(2 * self.size), 0
        self.newest: list[float] = []
        self.random = random.Random(self.seed)
        self.statistic = None

    def _step(self, x: float) -> bool:
        if self.end == len(self.values):
            self.values[: self.size - 1] = self.values[self.size + 1 :]
            self.end = self.size - 1
        self.values[self.end] = x
        self.end += 1
        if len(self.newest) == self.stat:
            del self.newest[bisect_left(self.newest, self.values[self.end - 1 - self.stat])]
        insort(self.newest, x)
        if self.end < self.size:
            return False
        first = self.end - self.size
        drawn = self.random.sample(range(self.size - self.stat), self.stat)
        most = ks_distance(self.values[first + np.array(drawn)], np.array(self.newest))
        self.statistic = most / self.stat
        return most >= self.critical and self.statistic > 0.1


def ks_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Greatest difference, over all values, between how many of a and of b are at most that value."""
    a, b = np.sort(a), np.sort(b)
    both = np.concatenate([a, b])
    return int(np.abs(np.searchsorted(a, both, "right") - np.searchsorted(b, both, "right")).max(initial=0))


class KswinBank:
    """Several levels of one window and sample size over the same values, fed block by block. Levels that were reset at the same
    place see the same statistics, which are worked out once for them."""

    #: Steps whose samples and newest values are sorted together.
    STEPS = 128

    def __init__(self, alphas: Sequence[float], window_size: int, stat_size: int, seed: int | None = 42):
        self.size, self.stat, self.seed = window_size, stat_size, seed
        self.critical = [ks_critical(stat_size, a) for a in alphas]
        first = _Run(seed)
        self.runs = [first] * len(alphas)
        self.at = 0

    def feed(self, values: np.ndarray) -> list[tuple[int, int]]:
        """(level, place of its alarm among all values so far) within this block."""
        out, end = [], self.at + len(values)
        fresh: dict[int, _Run] = {}
        waiting: dict[int, tuple[_Run, list[int]]] = {}
        for level, run in enumerate(self.runs):
            waiting.setdefault(id(run), (run, []))[1].append(level)
        todo = [(run, levels, self.at) for run, levels in waiting.values()]
        while todo:
            run, levels, start = todo.pop()
            counts = run.counts(values[start - self.at :], self.size, self.stat, self.STEPS)
            for level in levels:
                hits = np.flatnonzero((counts >= self.critical[level]) & (counts > 0.1 * self.stat))
                if not len(hits):
                    self.runs[level] = run
                    continue
                place = start + int(hits[0])
                out.append((level, place))
                if place + 1 not in fresh:
                    fresh[place + 1] = _Run(self.seed)
                    todo.append((fresh[place + 1], [level], place + 1))
                else:
                    again = next((t for t in todo if t[0] is fresh[place + 1]), None)
                    if again is not None:
                        again[1].append(level)
                    else:
                        # Its counts for this block have been taken already; a run of its own starts at the same place.
                        todo.append((_Run(self.seed), [level], place + 1))
        self.at = end
        return out


class _Run:
    """The values since a reset, as far as the window reaches back, and the generator of its samples."""

    def __init__(self, seed: int | None):
        self.values, self.random = np.empty(0), random.Random(seed)

    def counts(self, values: np.ndarray, size: int, stat: int, steps: int) -> np.ndarray:
        """The distance behind each of the new values; -1 until the window is full."""
        whole = np.concatenate([self.values, values])
        out = np.full(len(values), -1)
        first = max(size - 1, len(self.values))
        for a in range(first, len(whole), steps):
            ends = np.arange(a, min(a + steps, len(whole)))
            drawn = np.array([self.random.sample(range(size - stat), stat) for _ in ends])
            old = whole[(ends - size + 1)[:, None] + drawn]
            new = whole[(ends - stat + 1)[:, None] + np.arange(stat)]
            both = np.concatenate([old, new], axis=1)
            order = np.argsort(both, axis=1, kind="stable")
            ranked = np.take_along_axis(both, order, axis=1)
            gap = np.cumsum(np.where(order < stat, 1, -1), axis=1)
            last = np.concatenate([ranked[:, 1:] != ranked[:, :-1], np.ones((len(ends), 1), bool)], axis=1)
            out[ends - len(self.values)] = np.abs(np.where(last, gap, 0)).max(axis=1)
        self.values = whole[-(size - 1) :] if size > 1 else np.empty(0)
        return out


class PageHinkleyBank:
    """Several configurations of Page-Hinkley over the same values, a step of all of them at a time."""

    def __init__(self, configs: Sequence[dict]):
        of = lambda name, default: np.array([c.get(name, default) for c in configs])
        self.least_n, self.delta, self.threshold, self.alpha = of("min_instances", 30), of("delta", 0.005), of("threshold", 50.0), of("alpha", 0.9999)
        mode = of("mode", "both")
        self.rises, self.falls = np.isin(mode, ["up", "both"]), np.isin(mode, ["down", "both"])
        self.n, self.at = np.zeros(len(configs)), 0
        self.mean, self.up, self.down = (np.zeros(len(configs)) for _ in range(3))
        self.least, self.most = np.full(len(configs), np.inf), np.full(len(configs), -np.inf)

    def feed(self, values: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for x in values.tolist():
            self.n += 1
            self.mean += (x - self.mean) / self.n
            gap = x - self.mean
            self.up = self.alpha * self.up + gap - self.delta
            self.down = self.alpha * self.down + gap + self.delta
            self.least, self.most = np.minimum(self.least, self.up), np.maximum(self.most, self.down)
            fired = (self.n >= self.least_n) & (self.rises & (self.up - self.least > self.threshold) | self.falls & (self.most - self.down > self.threshold))
            if fired.any():
                out += [(int(i), self.at) for i in np.flatnonzero(fired)]
                self.n[fired] = self.mean[fired] = self.up[fired] = self.down[fired] = 0.0
                self.least[fired], self.most[fired] = np.inf, -np.inf
            self.at += 1
        return out


class Bank:
    """Any detectors side by side."""

    def __init__(self, made: Sequence[Detector]):
        self.made, self.at = made, 0

    def feed(self, values: np.ndarray) -> list[tuple[int, int]]:
        floats = values.tolist()
        out = [(i, self.at + j) for i, d in enumerate(self.made) for j, x in enumerate(floats) if d.update(x)]
        self.at += len(floats)
        return out


#: Parameters that were selected on the synthetic benchmark.
SELECTED: dict[str, Callable[[], Detector]] = {
    "page_hinkley": lambda: PageHinkley(min_instances=20, delta=1e-4, threshold=600.0, alpha=0.9995),
    "adwin": lambda: Adwin(delta=1e-8, clock=48, min_window_length=336),
    "kswin": lambda: Kswin(alpha=5e-5, window_size=1344, stat_size=96, seed=42),
}


def alarms(series: DataFrame, make: Callable[[], Detector]) -> DataFrame:
    """k, pos, us, statistic of every alarm; series has k, pos, slot, y without nulls. One detector runs over each key's rows in order."""

    def start():
        detector = make()
        return lambda pos, us, y: (pos, us, _number(detector.statistic)) if detector.update(float(y)) else None

    return folded(series.select("k", "pos", "slot", "y"), ["pos"], start, ALARM_SCHEMA)


def traces(series: DataFrame, make: Callable[[], Detector]) -> DataFrame:
    """k, pos, us, statistic of every row: the detector's statistic as the values come in."""

    def start():
        detector = make()

        def step(pos, us, y):
            detector.update(float(y))
            return pos, us, _number(detector.statistic)

        return step

    return folded(series.select("k", "pos", "slot", "y"), ["pos"], start, ALARM_SCHEMA)


def _number(statistic: float | None) -> float | None:
    return None if statistic is None else float(statistic)
