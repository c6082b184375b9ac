"""Exact order statistics without sorting a key: histograms of ranges that narrow down to one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.conformal import rank
from tidemark.sources.shared import written

#: Cells of a histogram; a round leaves one of them.
BINS = 1024


def _cell() -> Column:
    """The number of v's cell in [lo, hi]; it never falls as v rises, whatever the rounding."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    wide = hi - lo == float("inf")
    share = F.when(wide, (v / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise((v - lo) / (hi - lo))
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def kth_smallest(values: DataFrame, wanted: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """key, rank, value: the rank-th smallest value of a key (1: the least), for each row of wanted (key, rank).

    Every round counts the values left of each key by cells, which every task does for its own rows first, and goes on with
    the cell that holds the rank; its least and greatest value bound the next round, and once they are equal the value is
    found. Rounds are few, as each divides a range by BINS (two or three for most data, more where outliers span many
    orders of magnitude). Values that are null or not finite are left out; a rank beyond a key's values gives no row.
    """
    infinite = F.abs("v") == float("inf")
    rows, _ = written(values.select(F.col(key), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & ~infinite), "values")
    ends = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = wanted.select(key, "rank").distinct().join(ends, key).filter(F.col("rank").between(1, F.col("n"))).select(key, "rank", F.col("rank").alias("left"), "lo", "hi")
    found = None
    while True:
        state, _ = written(state, "ranges")
        done = state.filter("lo = hi").select(key, "rank", F.col("lo").alias("value"))
        found = done if found is None else found.unionByName(done)
        going = state.filter("lo < hi")
        if going.isEmpty():
            return found
        inside = rows.join(going, key).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        cells = inside.groupBy(key, "rank", "left", _cell().alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # At most BINS rows for each key and rank.
        earlier = F.sum("n").over(Window.partitionBy(key, "rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        placed = cells.withColumn("before", F.coalesce(earlier, F.lit(0)))
        state = placed.filter((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("n"))).select(key, "rank", (F.col("left") - F.col("before")).alias("left"), "lo", "hi")


def quantiles(values: DataFrame, q: float, key: str = "k", value: str = "v") -> DataFrame:
    """key, q: the quantile of a key's values on the line between the two nearest ones. See kth_smallest for odd values."""
    rows = values.select(key, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')")
    place = q * (F.count("*") - 1)
    sizes = rows.groupBy(key).agg(place.alias("place"), F.floor(place).alias("low"), F.ceil(place).alias("high"))
    ends = F.explode(F.array((F.col("low") + 1).cast("long"), (F.col("high") + 1).cast("long")))
    found = kth_smallest(rows, sizes.select(key, ends.alias("rank")), key).join(sizes, key)
    low, high = (F.max(F.when(F.col("rank") == F.col(c) + 1, F.col("value"))) for c in ("low", "high"))
    return found.groupBy(key).agg((low + (high - low) * F.max(F.col("place") - F.col("low"))).alias("q"))


def radii(residuals: DataFrame, alpha: float, key: str = "k", score: str = "score") -> DataFrame:
    """key, n, rank, radius as conformal.radii, for 0 < alpha < 1, without a window over a key."""
    scores = residuals.select(key, F.abs(score).alias("v"))
    counts = scores.groupBy(key).agg(F.count("*").alias("n")).withColumn("rank", rank(F.col("n"), alpha))
    found = kth_smallest(scores, counts, key)
    return counts.join(found, [key, "rank"], "left").select(key, "n", "rank", F.coalesce("value", F.lit(float("inf"))).alias("radius"))
