"""Window operators over series. Every function leaves the plan to Catalyst; one window specification serves a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import spread
from tidemark.sources.series import HALF_HOUR


def over(key: str | Sequence[str] = "k", order: str = "pos"):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def rolling_mean(value: Column, size: int, key: str | Sequence[str] = "k", order: str = "pos") -> Column:
    """Trailing mean over size rows, null until the window is full."""
    w = over(key, order).rowsBetween(-(size - 1), 0)
    return F.when(F.count(value).over(w) == size, F.avg(value).over(w))


def eligible(flag: Column, slot: Column, size: int, key: str | Sequence[str] = "k", order: str = "pos", width: int = HALF_HOUR) -> Column:
    """Whether the trailing window is full, lies wholly in flagged rows and has no gap in time."""
    w = over(key, order)
    inside = F.sum(F.when(flag, 1).otherwise(0)).over(w.rowsBetween(-(size - 1), 0)) == size
    span = slot - F.lag(slot, size - 1).over(w) == (size - 1) * width
    return F.coalesce((F.row_number().over(w) >= size) & inside & span, F.lit(False))


def previous_mean(value: Column, size: int, key: str | Sequence[str] = "k", order: str = "pos") -> Column:
    """Mean over the size rows before this one, null until there are as many."""
    w = over(key, order).rowsBetween(-size, -1)
    return F.when(F.count(value).over(w) == size, F.avg(value).over(w))


def islands(df: DataFrame, label: str, key: str = "k", order: str = "pos", start: str = "slot", width: int = HALF_HOUR) -> DataFrame:
    """key, label, start, stop, n of every run of equal labels in a series; stop is one width behind the last row."""
    w = over(key, order)
    changed = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w))
    out = runs.groupBy(key, "_run", label).agg(F.min(start).alias("start"), (F.max(start) + width).alias("stop"), F.count("*").alias("n"))
    return out.drop("_run")


def cyclic_mean(df: DataFrame, day: str, value: str, half: int = 15, ring: int = 365) -> DataFrame:
    """day, smooth: mean over the 2 * half + 1 nearest days of a ring of days 1 to ring; df has a row for each day."""
    other = df.select(F.col(day).alias("_d"), F.col(value).alias("_v"))
    near = F.pmod(F.col("_d") - F.col(day) + half, F.lit(ring)) <= 2 * half
    return df.join(F.broadcast(other), near).groupBy(day).agg(F.avg("_v").alias("smooth"))


def interpolated(df: DataFrame, place: str, value: str) -> Column:
    """value, holes filled along the line between the nearest values; the nearest value beyond the ends."""
    back = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(place).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(place))
    v0, v1 = F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(ahead)
    p0, p1 = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
    line = v0 + (v1 - v0) * (F.col(place) - p0) / F.nullif(p1 - p0, F.lit(0))
    return F.coalesce(F.col(value), line, v0, v1)


def smooth_padded(value: Column, half: int, key: str = "k", order: str = "pos") -> Column:
    """Centred mean over 2 * half + 1 rows, the ends padded with the end values."""
    whole = over(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = over(key, order)
    n, at = F.count(F.lit(1)).over(whole), F.row_number().over(w)
    missing_left, missing_right = F.greatest(F.lit(0), half + 1 - at), F.greatest(F.lit(0), at + half - n)
    inside = F.sum(value).over(w.rowsBetween(-half, half))
    return (inside + missing_left * F.first(value).over(whole) + missing_right * F.last(value).over(whole)) / (2 * half + 1)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with their group's greatest order value; all of them where several have it."""
    return df.withColumn("_m", F.max(order).over(Window.partitionBy(*keys))).filter(F.col(order) == F.col("_m")).drop("_m")


def cumulative_by_score(df: DataFrame, score: str, hit: Column, key: str = "k") -> DataFrame:
    """key, score, kept, hits: rows and hits at this score or below; ties count together. Null scores come first. Counts are
    summed in ranges of (key, score) and handed on, so that no task holds a key."""
    tied = df.groupBy(key, score).agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("h"))
    return spread.running(tied, {"kept": F.col("n"), "hits": F.col("h")}, score, key).select(key, score, "kept", "hits")
