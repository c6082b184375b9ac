"""Retraining policies and what they cost."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.forecast import Forecaster
from tidemark.sources.series import DAY


class Adapter(ABC):
    """An arm: at the end of which days it retrains, and on which rows."""

    #: Days of history that it trains on; None: all.
    window_days: int | None = None

    @abstractmethod
    def boundaries(self, series: DataFrame, triggers: DataFrame) -> DataFrame:
        """k, day: microseconds of the day at whose end the arm retrains; never the last day of the series."""


def _last_day(series: DataFrame) -> DataFrame:
    return series.groupBy("k").agg(F.min("day").alias("first"), F.max("day").alias("last"))


class NeverRetrain(Adapter):
    def boundaries(self, series, triggers):
        return series.select("k", "day").limit(0)


class EveryDays(Adapter):
    def __init__(self, every: int = 30):
        self.every = self.window_days = every

    def boundaries(self, series, triggers):
        start = F.col("first") + (self.every - 1) * DAY
        days = F.when(start < F.col("last"), F.sequence(start, F.col("last") - DAY, F.lit(self.every * DAY)))
        return _last_day(series).select("k", F.explode(days).alias("day"))


class OnTrigger(Adapter):
    def __init__(self, window_days: int | None = None):
        self.window_days = window_days

    def boundaries(self, series, triggers):
        return triggers.select("k", "day").distinct().join(_last_day(series), "k").filter("day >= first AND day < last").select("k", "day")


def training_rows(history: DataFrame, boundaries: DataFrame, window_days: int | None) -> DataFrame:
    """k, day, train_rows: rows of history (k, day) up to each boundary, or in the window of days that ends with it.

    Rows are first counted by day; a running sum over days then serves every boundary, whatever its window.
    """
    from pyspark.sql import Window

    daily = history.groupBy("k", "day").agg(F.count("*").alias("n"))
    marks = daily.select("k", "day", "n", F.lit(0).alias("mark")).unionByName(boundaries.distinct().select("k", "day", F.lit(0).cast("long").alias("n"), F.lit(1).alias("mark")))
    w = Window.partitionBy("k").orderBy("day").rangeBetween(Window.unboundedPreceding if window_days is None else -(window_days - 1) * DAY, 0)
    return marks.withColumn("train_rows", F.sum("n").over(w)).filter("mark = 1").select("k", "day", "train_rows")


def arm_forecasts(series: DataFrame, boundaries: DataFrame, make: Callable[[], Forecaster], start: int, window_days: int | None = None, block: int = 48) -> DataFrame:
    """k, pos, slot, y, p, model, train_rows, fit_seconds: an arm's run over each series from start (microseconds) on.

    A model is fitted on what lies before start. It forecasts block by block, observing each block behind it, up to the
    end of the first boundary's day; there it is fitted anew, on all rows so far or those of the last window_days, and
    serves from the next day on, and so forth. model is the day at whose end the serving model was fitted (null: the
    first one), train_rows and fit_seconds are its cost. Boundaries before start are ignored. Series without rows before
    start have no model and no rows. series: k, pos, slot, day, y; boundaries: k, day.
    """
    import pandas as pd

    schema = "k string, pos long, slot long, y double, p double, model long, train_rows long, fit_seconds double"

    def run(rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}).astype({"k": object})
        if not len(rows):
            return none
        rows = rows.sort_values("pos")
        y, slots, days = rows["y"].tolist(), rows["slot"].to_numpy(), rows["day"].to_numpy()
        at = int(np.searchsorted(slots, start))
        if not at:
            return none
        out = []
        ends = sorted(d for d in set(marks["day"].tolist() if len(marks) else ()) if d >= start)
        for model, stop in zip([None, *ends], [*(int(np.searchsorted(slots, d + DAY)) for d in ends), len(y)], strict=True):
            first = 0 if model is None or window_days is None else int(np.searchsorted(days, model - (window_days - 1) * DAY))
            began = time.perf_counter()
            fitted = make().fit(y[first:at])
            took = time.perf_counter() - began
            p: list[float] = []
            for k in range(at, stop, block):
                actual = y[k : min(stop, k + block)]
                p += fitted.predict(len(actual))
                fitted.observe(actual)
            part = rows.iloc[at:stop][["k", "pos", "slot", "y"]]
            out.append(part.assign(p=p, model=pd.array([model] * len(part), "Int64"), train_rows=at - first, fit_seconds=took))
            at = stop
        return pd.concat(out)

    past = boundaries.select("k", "day").groupBy("k")
    return series.select("k", "pos", "slot", "day", "y").groupBy("k").cogroup(past).applyInPandas(run, schema)


def arm_costs(forecasts: DataFrame) -> DataFrame:
    """k, n_retrains, train_samples, fit_seconds, retrained (the days, ascending) of arm_forecasts; the first fit counts in
    fit_seconds alone. A model that serves no row leaves none."""
    fits = forecasts.groupBy("k", "model").agg(F.first("train_rows").alias("rows"), F.first("fit_seconds").alias("s"))
    days = F.array_sort(F.collect_list("model"))
    retrained = F.sum(F.when(F.col("model").isNotNull(), F.col("rows")).otherwise(0))
    return fits.groupBy("k").agg(F.count("model").alias("n_retrains"), retrained.alias("train_samples"), F.sum("s").alias("fit_seconds"), days.alias("retrained"))


def accounting(history: DataFrame, boundaries: DataFrame, window_days: int | None) -> DataFrame:
    """k, n_retrains, train_samples."""
    rows = training_rows(history, boundaries, window_days)
    return rows.groupBy("k").agg(F.count("*").alias("n_retrains"), F.sum("train_rows").alias("train_samples"))
