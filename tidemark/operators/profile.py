"""Seasonal profiles: base level, annual factor by day of year, weekly factor by weekday (and half-hour)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import cyclic_mean, interpolated


def season_day(ts: Column) -> Column:
    """Day of the year from 1 to 365, leap years' days from March on moved back by one; 29 February is 59.5."""
    leap = (F.year(ts) % 4 == 0) & ((F.year(ts) % 100 != 0) | (F.year(ts) % 400 == 0))
    doy = F.dayofyear(ts).cast("double")
    return F.when(leap & (doy == 60), 59.5).when(leap & (doy > 60), doy - 1).otherwise(doy)


def half_hour(ts: Column) -> Column:
    return F.hour(ts) * 2 + F.floor(F.minute(ts) / 30).cast("int")


@dataclass
class Profile:
    """base: one row (base); annual: d, factor for 1 to 365; weekly: weekday (Monday 0), [slot,] factor: at most 365, 7 or
    336 rows, which a fit works out at once and holds as constants."""

    base: DataFrame
    annual: DataFrame
    weekly: DataFrame
    by_slot: bool


def fit(train: DataFrame, ts: str = "ts", y: str = "y", by_slot: bool = False) -> Profile:
    """Fitted on training rows only. Days of the year without data lie on the line between their neighbours; the annual
    level is smoothed over 31 days of the ring of 365; 29 February shapes nothing."""
    spark = train.sparkSession
    rows = train.select(F.col(ts).alias("ts"), F.col(y).alias("y")).filter("y IS NOT NULL")
    days = rows.withColumn("d", season_day(F.col("ts"))).groupBy("d").agg(F.avg("y").alias("level")).filter("d <> 59.5")
    ring = spark.range(1, 366).select(F.col("id").cast("double").alias("d")).join(days, "d", "left")
    filled = ring.select("d", interpolated(ring, "d", "level").alias("level"))
    smooth = cyclic_mean(filled, "d", "level")
    base = smooth.agg(F.avg("smooth").alias("base"))
    annual = _constant(smooth.join(F.broadcast(base)).select("d", (F.col("smooth") / F.col("base")).alias("factor")))
    keys = ["weekday", "slot"] if by_slot else ["weekday"]
    flat = _with_annual(_keyed(rows, "ts", by_slot), annual)
    levels = _constant(flat.groupBy(*keys).agg(F.avg(F.col("y") / F.col("annual")).alias("level")))
    mean = _constant(levels.agg(F.avg("level").alias("mean")))
    weekly = levels.join(F.broadcast(mean)).select(*keys, (F.col("level") / F.col("mean")).alias("factor"))
    return Profile(mean.select(F.col("mean").alias("base")), annual, weekly, by_slot)


def _constant(few: DataFrame) -> DataFrame:
    return few.sparkSession.createDataFrame(few.collect(), few.schema)


def _keyed(rows: DataFrame, ts: str, by_slot: bool) -> DataFrame:
    out = rows.withColumns({"d": season_day(F.col(ts)), "weekday": F.weekday(ts)})
    return out.withColumn("slot", half_hour(F.col(ts))) if by_slot else out


def _with_annual(rows: DataFrame, annual: DataFrame) -> DataFrame:
    """annual factor by day; between two days (59.5) the mean of both."""
    a, b = annual.toDF("_f", "_x"), annual.toDF("_c", "_z")
    out = rows.withColumns({"_f": F.floor("d").cast("double"), "_c": F.ceil("d").cast("double")})
    return out.join(F.broadcast(a), "_f", "left").join(F.broadcast(b), "_c", "left").withColumn("annual", (F.col("_x") + F.col("_z")) / 2).drop("_f", "_c", "_x", "_z")


def apply(rows: DataFrame, profile: Profile, ts: str = "ts", y: str = "y") -> DataFrame:
    """rows with expected and residual; fails on a weekday or slot that the profile lacks."""
    keys = ["weekday", "slot"] if profile.by_slot else ["weekday"]
    out = _with_annual(_keyed(rows, ts, profile.by_slot), profile.annual)
    out = out.join(F.broadcast(profile.weekly.withColumnRenamed("factor", "_w")), keys, "left").join(F.broadcast(profile.base))
    factor = F.when(F.col("_w").isNull(), F.raise_error(F.lit("the profile lacks a weekday or slot")).cast("double")).otherwise(F.col("_w"))
    out = out.withColumn("expected", F.col("base") * F.col("annual") * factor)
    return out.withColumn("residual", F.col(y) - F.col("expected")).select(*rows.columns, "expected", "residual")


def standard_scores(rows: DataFrame, train: Column, value: str = "residual") -> DataFrame:
    """rows with z: value less the training rows' mean, by their population deviation."""
    stats = rows.filter(train).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return rows.join(F.broadcast(stats)).withColumn("z", (F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")
