"""Cleaning and auditing of raw interval data; nothing is changed in place, every stage is an expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import spread
from tidemark.sources.series import micros


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return sorted(set(columns) - set(df.columns))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has the columns; ValueError naming what is missing otherwise."""
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def coerced(df: DataFrame, numbers: list[str], times: list[str]) -> DataFrame:
    """Numbers and times read from text; what cannot be read is null; rows without a time go."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in numbers} | {c: F.col(c).try_cast("timestamp_ntz") for c in times})
    return out.dropna(subset=times)


def out_of_order(df: DataFrame, key: str, ts: str, arrival: str) -> DataFrame:
    """key, out_of_order: rows whose time lies before that of the row that arrived before. A key's rows are spread over tasks."""
    before = spread.lagged(df.select(key, ts, arrival), {"_before": ts}, arrival, key)
    return before.withColumn("_late", F.col(ts) < F.col("_before")).groupBy(key).agg(F.count_if("_late").alias("out_of_order"))


def conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose keys occur more than once."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def keep_first(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The first row of each key by arrival."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(arrival))).filter("_r = 1").drop("_r")


def cadence(df: DataFrame, key: str, ts: str, expected: int) -> DataFrame:
    """key, us, step: distinct times whose step from the one before is not the expected one. A key's times are spread over
    tasks; a time that is not known has no step."""
    times = df.select(key, micros(ts).alias("us")).distinct()
    before = spread.lagged(times, {"_before": "us"}, "us", key)
    return before.select(key, "us", (F.col("us") - F.col("_before")).alias("step")).filter(F.col("step") != expected)


def clean(df: DataFrame, key: str, ts: str, value: str, arrival: str) -> DataFrame:
    """The whole chain: required columns, coercion, exact duplicates, first row per time and key."""
    rows = coerced(require(df, [key, ts, value, arrival]), [value], [ts])
    rows = rows.dropDuplicates()
    return keep_first(rows, [key, ts], arrival)


def audit(df: DataFrame, key: str, ts: str, value: str, arrival: str, expected: int) -> DataFrame:
    """key, check, n: one row per audit check and key."""
    late = out_of_order(df, key, ts, arrival)
    steps = cadence(df, key, ts, expected).groupBy(key).agg(F.count("*").alias("irregular_steps"))
    totals = df.groupBy(key).agg(
        F.count("*").alias("rows"),
        F.count_distinct(ts).alias("distinct_times"),
        F.count_if(F.col(value).isNull()).alias("null_values"),
        F.count_if(F.col(value) < 0).alias("negative_values"),
        F.count_if(F.col(ts).isNull()).alias("null_times"),
    )
    doubled = conflicts(df, [key, ts]).groupBy(key).agg(F.count("*").alias("conflicting_rows"))
    wide = totals.join(late, key, "left").join(steps, key, "left").join(doubled, key, "left").fillna(0)
    checks = [c for c in wide.columns if c != key]
    return wide.unpivot(key, checks, "check", "n")
