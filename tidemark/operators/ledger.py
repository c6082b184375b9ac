"""The run ledger: one scalar per row, append-only, and the report tables that read it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.windows import latest
from tidemark.sources.shared import locked

#: The ledger's columns.
SCHEMA = (
    "group string, method string, dataset string, region string, seed int, config_hash string, split_id string, metric_name string, "
    "metric_value double, regime string, n_retrains long, train_samples long, wall_clock_s double, timestamp timestamp_ntz"
)


def config_hash(config: Mapping) -> str:
    """First 12 hex digits of the SHA-1 of the configuration as JSON with sorted keys."""
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def config_of(thing) -> dict:
    """Public attributes of an object: what identifies its configuration."""
    return {k: v for k, v in vars(thing).items() if not k.startswith("_")}


def seed_token(seed: Column) -> Column:
    return F.coalesce(seed.cast("string"), F.lit("none"))


def run_path(kind: str, method: Column, region: Column, seed: Column) -> Column:
    return F.concat_ws("/", F.lit(kind), F.concat_ws("_", method, region, F.concat(F.lit("seed"), seed_token(seed))))


def append(rows: DataFrame, path: str) -> None:
    """Add rows under the ledger's lock. Reports filter on group and split_id: they prune folders."""
    with locked(rows.sparkSession, f"{path.rstrip('/')}.lock"):
        rows.write.mode("append").partitionBy("group", "split_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def to_rows(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric."""
    return wide.unpivot(ids, metrics, "metric_name", "metric_value")


def forecast_rows(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, regime (null), metric_name, metric_value: error metrics of each run."""
    wide = forecasts.groupBy(*keys).agg(metrics.mae().alias("mae"), metrics.pinball(0.5).alias("pinball"))
    return to_rows(wide, keys, ["mae", "pinball"]).select(*keys, F.lit(None).cast("string").alias("regime"), "metric_name", "metric_value")


def regime_rows(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """As forecast_rows, by regime, with coverage and width; a regime that a run does not touch has no rows."""
    wide = intervals.groupBy(*keys, "regime").agg(metrics.mae().alias("mae"), metrics.coverage().alias("coverage"), metrics.width().alias("width"))
    return to_rows(wide, [*keys, "regime"], ["mae", "coverage", "width"]).select(*keys, "regime", "metric_name", "metric_value")


def detection_rows(matches: DataFrame, keys: list[str]) -> DataFrame:
    """As forecast_rows, of labelled alarms: how many there are, are accepted, matched and unmatched, and each matched event's delay."""
    label = F.col("label")
    counts = {"raw": F.count("*"), "accepted": F.count_if(label != "Ignored"), "matched": F.count_if(label == "Match"), "unmatched": F.count_if(label == "Unmatch")}
    wide = matches.groupBy(*keys).agg(*(c.cast("double").alias(n) for n, c in counts.items()))
    delays = matches.filter(label == "Match").select(*keys, F.concat(F.lit("delay_"), "event_id").alias("metric_name"), F.col("delay_days").alias("metric_value"))
    rows = to_rows(wide, keys, list(counts)).unionByName(delays)
    return rows.select(*keys, F.lit(None).cast("string").alias("regime"), "metric_name", "metric_value")


def record(forecasts: DataFrame | None = None, matches: DataFrame | None = None, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """The rows of one run, which is either a forecast or a detection; ValueError for both or neither."""
    if (forecasts is None) == (matches is None):
        raise ValueError("a run is either a forecast or a detection")
    return forecast_rows(forecasts, list(keys)) if matches is None else detection_rows(matches, list(keys))


#: Ids that earlier runs were logged under, by the id that they have now.
FORMER_IDS = {"uq_adwin_v1": ("uq_v1",), "escalation_adwin_v1": ("escalation_v1",)}


def split_id(kind: str, detector: str, signal: str = "width") -> str:
    """The name under which a detector's runs of a kind are logged; the width signal has no name of its own."""
    return f"{kind}_{detector}_v1" if signal == "width" else f"{kind}_{detector}_{signal}_v1"


def readable_ids(name: str) -> tuple[str, ...]:
    return (name, *FORMER_IDS.get(name, ()))


def latest_runs(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each group's latest run: all that share its greatest timestamp."""
    return latest(ledger, keys, "timestamp")


def last_run(ledger: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row: the last by the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return ledger.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def pivoted(ledger: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return ledger.groupBy(*keys).pivot("metric_name", names).agg(F.avg("metric_value"))


def mean_sd(value: str) -> list[Column]:
    return [F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_sd")]


def fixed_text(value: Column | str, digits: int = 1) -> Column:
    """value with so many digits, as C's printf gives it: the nearest to the exact binary value, the even one from midway
    (26.95 is a little less than that and gives 26.9, 28.25 gives 28.2; format_string rounds the decimals up in both).
    Without digits there is no point either."""
    pattern = f"0.{'0' * digits}" if digits else "0"
    return F.call_function("format_number", F.col(value) if isinstance(value, str) else value, F.lit(pattern))


def mean_sd_text(mean: str, sd: str, n: str, digits: int = 1) -> Column:
    """mean and deviation as text; n/a where there is nothing to show."""
    m, s = fixed_text(mean, digits), fixed_text(sd, digits)
    return F.when(F.col(n) == 0, "n/a").when(F.col(n) == 1, F.concat(m, F.lit(" ± n/a"))).otherwise(F.concat(m, F.lit(" ± "), s))


def split_method(method: str = "method") -> list[Column]:
    """model, arm and uq from 'model/arm/uq'; null for missing parts."""
    parts = F.split(method, "/")
    return [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(("model", "arm", "uq"))]


def arm_order(arm: Column, order: list[str]) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), arm), F.lit(0)), F.lit(len(order) + 1))
