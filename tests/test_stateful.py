"""Detectors as state with timers: order of event time, late rows, restart from a checkpoint."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detectors
from tidemark.streaming import stateful

PARAMS = {"min_instances": 20, "delta": 0.05, "threshold": 40.0, "alpha": 0.99}
MINUTE = 60_000_000
SCHEMA = "k string, ts timestamp, id long, y double"


@pytest.fixture
def kept_state(spark):
    with stateful.keeping_state(spark):
        yield


def parts(spark, folder, rows, names):
    """rows of (k, us, id, y) as one file for each list."""
    for name, part in zip(names, rows, strict=True):
        df = spark.createDataFrame(part, "k string, us long, id long, y double").select("k", F.timestamp_micros("us").alias("ts"), "id", "y")
        df.coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, state, glob="*"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{glob}")
    found = stateful.detect_ordered(stream, PARAMS, "k", "ts", "id", "y")
    q = found.writeStream.format("parquet").option("path", f"{state}/out").option("checkpointLocation", f"{state}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.k, r.us) for r in spark.read.schema(stateful.OUT).parquet(f"{state}/out").collect())


def alarms_of(rows):
    out = []
    for k in sorted({r[0] for r in rows}):
        detector = detectors.PageHinkley(**PARAMS)
        out += [(k, us) for _, us, _, y in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]) if detector.update(y)]
    return out


def test_order_restart_and_late_rows(spark, kept_state, tmp_path):
    random, rows = np.random.default_rng(4), []
    for k in "ab":
        y = random.normal(0, 1, 300) + np.where(np.arange(300) % 120 > 60, 6.0, 0.0)
        rows += [(k, (i + 1) * MINUTE, i, float(v)) for i, v in enumerate(y)]
    # Out of order by up to half an hour, within the hour that is waited.
    rows.sort(key=lambda r: r[1] + int(random.integers(0, 30)) * MINUTE)
    cut = [rows[i : i + 150] for i in range(0, len(rows), 150)]
    parts(spark, tmp_path / "in", cut, ["1", "2", "3", "4"])
    end = max(r[1] for r in rows) - 60 * MINUTE
    due = [r for r in rows if r[1] <= end]
    want = alarms_of(due)
    whole = run(spark, tmp_path / "in", tmp_path / "whole")
    assert whole == want and len({k for k, _ in want}) == 2
    # Two files, then a restart with the rest.
    parts(spark, tmp_path / "later", cut[:2], ["1", "2"])
    run(spark, tmp_path / "later", tmp_path / "broken")
    parts(spark, tmp_path / "later", cut[2:], ["3", "4"])
    assert run(spark, tmp_path / "later", tmp_path / "broken") == whole
    # A row from long ago changes no alarm.
    parts(spark, tmp_path / "later", [[("a", MINUTE // 2, 999, 1e6)]], ["5"])
    assert run(spark, tmp_path / "later", tmp_path / "broken") == whole


def test_rows_without_time_value_or_key(spark, kept_state, tmp_path):
    parts(spark, tmp_path / "in", [[(None, MINUTE, 1, 1.0), ("a", None, 2, 1.0), ("a", MINUTE, 3, None)]], ["1"])
    assert run(spark, tmp_path / "in", tmp_path / "out") == []
