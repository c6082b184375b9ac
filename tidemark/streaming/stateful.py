"""Detectors on a live stream in the order of event time, as state with timers.

What arrives waits in a list until the watermark has passed it; a timer then feeds it to the key's detector in order. Alarms do
not depend on how rows are cut into triggers, and a stream that starts again from its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.shipping import ship_package

#: What Page-Hinkley keeps of a key: values seen, their mean, both sums with their extremes, and rows that came too late.
STATE = "n long, mean double, up double, down double, least double, most double, late long"
FRESH = (0, 0.0, 0.0, 0.0, float("inf"), float("-inf"))
OUT = "k string, us long, late long"
#: Where keyed state of this kind is kept.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(state: tuple, y: float, params: dict) -> tuple[tuple, bool]:
    """(state behind y, whether an alarm was raised): an alarm leaves a fresh state."""
    n, mean, up, down, least, most = state
    n += 1
    mean += (y - mean) / n
    up = params["alpha"] * up + (y - mean) - params["delta"]
    down = params["alpha"] * down + (y - mean) + params["delta"]
    least, most = min(least, up), max(most, down)
    if n >= params["min_instances"] and (up - least > params["threshold"] or most - down > params["threshold"]):
        return FRESH, True
    return (n, mean, up, down, least, most), False


@contextmanager
def keeping_state(spark: SparkSession) -> Iterator[None]:
    """The session keeps streams' state in PROVIDER inside, and where it did before behind."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class OrderedDetector(StatefulProcessor):
    """Page-Hinkley for each key: value state for the sums, list state for the rows that wait, timers at the waiting rows."""

    def __init__(self, params: dict):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", STATE)
        self.waiting = handle.getListState("waiting", "us long, id long, y double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        late, earliest = 0, None
        for part in rows:
            fresh = part[part["us"] > passed]
            late += len(part) - len(fresh)
            if len(fresh):
                self.waiting.appendList([(int(us), int(i), float(y)) for us, i, y in zip(fresh["us"], fresh["id"], fresh["y"], strict=True)])
                earliest = min(int(fresh["us"].min()), earliest if earliest is not None else int(fresh["us"].min()))
        if earliest is not None:
            self.handle.registerTimer(earliest // 1000 + 1)
        if late:
            state = self._state()
            self.sums.update((*state[:-1], state[-1] + late))
        yield pd.DataFrame({"k": pd.Series([], dtype="object"), "us": pd.Series([], dtype="int64"), "late": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        due, left = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        hits: list[int] = []
        *state, late = self._state()
        if due:
            for us, _, y in due:
                state, fired = step(tuple(state), y, self.params)
                if fired:
                    hits.append(us)
            self.sums.update((*state, late))
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        if left:
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        yield pd.DataFrame({"k": pd.Series([key[0]] * len(hits), dtype="object"), "us": pd.Series(hits, dtype="int64"), "late": pd.Series([late] * len(hits), dtype="int64")})

    def close(self) -> None:
        pass

    def _state(self) -> tuple:
        return tuple(self.sums.get()) if self.sums.exists() else (*FRESH, 0)


def detect_ordered(stream: DataFrame, params: dict, key: str, ts: str, ident: str, value: str, late: str = "1 hour") -> DataFrame:
    """k, us, late: the alarms, and how many of the key's rows had come behind the watermark by then; those rows are left out.
    Rows of equal time go by ident. Rows without a time, a value or a key are left out. A row is fed once the watermark, late
    behind the latest row of all keys, has passed it. The session must keep state in PROVIDER."""
    ship_package(stream.sparkSession)
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp"))
    # Before the watermark, so that rows which are left out do not move it.
    known = timed.filter(F.col(value).isNotNull() & F.col("_t").isNotNull() & F.col(key).isNotNull()).withWatermark("_t", late)
    rows = known.select(F.col(key).alias("k"), "_t", F.unix_micros("_t").alias("us"), F.col(ident).cast("long").alias("id"), F.col(value).cast("double").alias("y"))
    return rows.groupBy("k").transformWithStateInPandas(OrderedDetector(params), OUT, "Append", "EventTime")
