"""Forecast and interval metrics as aggregate columns; wrap them in groupBy().agg() or over a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGIMES = ("pre_drift", "drift", "post_drift")


def error(y: str = "y", p: str = "p") -> Column:
    return F.abs(F.col(y) - F.col(p))


def mae(y: str = "y", p: str = "p") -> Column:
    """Mean absolute error; fails on a missing value rather than skipping it."""
    return F.avg(F.when(F.col(y).isNull() | F.col(p).isNull(), F.raise_error(F.lit("missing value in a metric")).cast("double")).otherwise(error(y, p)))


def pinball(q: float, y: str = "y", p: str = "p") -> Column:
    e = F.col(y) - F.col(p)
    return F.avg(F.when(e >= 0, q * e).otherwise((q - 1) * e))


def interval_pinball(alpha: float) -> Column:
    """Mean of the losses of the bounds as quantiles alpha/2 and 1 - alpha/2."""
    return (pinball(alpha / 2, "y", "lower") + pinball(1 - alpha / 2, "y", "upper")) / 2


def covered(y: str = "y", lower: str = "lower", upper: str = "upper") -> Column:
    return F.col(y).between(F.col(lower), F.col(upper))


def coverage() -> Column:
    return F.avg(covered().cast("double"))


def width() -> Column:
    return F.avg(F.col("upper") - F.col("lower"))


def gap_stats(df: DataFrame, key: str, order: str, low: float, high: float) -> DataFrame:
    """key, n, gap_mean, gap_cv (population), gap_share in [low, high); null where there are too few gaps or their mean is 0."""
    gaps = df.withColumn("gap", F.col(order) - F.lag(order).over(Window.partitionBy(key).orderBy(order)))
    cv = F.when(F.count("gap") >= 2, F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0)))
    share = F.avg(F.when(F.col("gap").isNotNull(), ((F.col("gap") >= low) & (F.col("gap") < high)).cast("double")))
    return gaps.groupBy(key).agg(F.count("gap").alias("n"), F.avg("gap").alias("gap_mean"), cv.alias("gap_cv"), share.alias("gap_share"))


def rayleigh(df: DataFrame, key: str, time: str, period: float) -> DataFrame:
    """key, n, r, p: mean resultant length of the phases and Rayleigh's p; null for fewer than three."""
    phase = 2 * F.pi() * F.pmod(F.col(time), F.lit(period)) / F.lit(period)
    sums = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.cos(phase)).alias("c"), F.avg(F.sin(phase)).alias("s"))
    r = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    n = F.col("n")
    nz = n * n * (1 - r * r)
    p = F.exp(F.sqrt(1 + 4 * n + 4 * nz) - (1 + 2 * n))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
    return sums.select(key, "n", F.when(n >= 3, r).alias("r"), F.when(n >= 3, p).alias("p"))


def chance_matches(windows: DataFrame, length: Column, total: float, alarms: int) -> DataFrame:
    """expected: how many of the windows as many uniform alarms would hit."""
    return windows.agg(F.sum(1 - F.pow(1 - F.least(F.lit(1.0), length / F.lit(float(total))), F.lit(alarms))).alias("expected"))


def paired_gain(df: DataFrame, keys: list[str], arm: str, base: str, value: str, retrains: str) -> DataFrame:
    """Each run beside the base arm's run: gain, and gain per retrain (null without retrains or base)."""
    reference = df.filter(F.col(arm) == base).select(*keys, F.col(value).alias("base_value"))
    gain = F.col(value) - F.col("base_value")
    return df.join(reference, keys, "left").withColumn("gain", gain).withColumn("gain_per_retrain", gain / F.nullif(F.col(retrains), F.lit(0)))
