"""Gradient-boosted regression trees over lag rows, fitted by Spark: one ensemble for all series of a grid.

Every series is brought to its own training mean and deviation first, so that one ensemble serves all of them, and rows of
all series are spread over the tasks that grow its trees. A forecast feeds the lags of those behind it within a block; blocks
are shown what came before them, so they do not wait for each other and one series is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import spread
from tidemark.sources.series import HALF_HOUR
from tidemark.sources.shared import written

#: Lags in rows of a half-hourly grid, and the trees' parameters.
LAGS = (*range(1, 49), 96, 144, 336)
TREES, DEPTH, STEP, SHARE, HELD_OUT, LEAST_HELD_OUT = 300, 5, 0.05, 0.8, 0.15, 20
#: Stands for a value that is not known, far below all others: a split beneath the least value routes it apart.
MISSING = -1000.0
#: Steps of a recursion in one plan.
STEPS_TOGETHER = 16
#: Least gain on held-out rows, as a share of their error, for another tree.
TOLERANCE = 1e-4


def calendar(slot: Column) -> list[Column]:
    """Hour, minute, weekday (Monday is 0) and month of a slot."""
    at = F.timestamp_micros(slot).cast("timestamp_ntz")
    return [F.hour(at), F.minute(at), F.weekday(at), F.month(at)]


def scaled(grid: DataFrame, start: int, width: int = HALF_HOUR) -> DataFrame:
    """grid (k, slot, y) with place (slots from start), centre and scale of the key's values before start, and z, y brought to
    them. Keys without a value before start are left out; a constant key has scale 1."""
    known = grid.filter(F.col("slot") < start).groupBy("k").agg(F.avg("y").alias("centre"), F.stddev_pop("y").alias("scale"), F.min("slot").alias("first"))
    known = known.filter("centre IS NOT NULL").withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))
    place = ((F.col("slot") - start) / width).cast("long")
    return grid.select("k", "slot", "y").join(known, "k").withColumns({"place": place, "z": (F.col("y") - F.col("centre")) / F.col("scale")})


def lag_rows(series: DataFrame, lags: Sequence[int] = LAGS, size: int = 4 * spread.PIECE) -> DataFrame:
    """series of scaled with features: the lags of z, MISSING where there is no value, and the calendar."""
    cut = spread.haloed(series, max(lags), size, "place")
    w = Window.partitionBy("k", "_piece").orderBy("place")
    lagged = [F.coalesce(F.lag("z", n).over(w), F.lit(MISSING)) for n in lags]
    features = F.array(*lagged, *(c.cast("double") for c in calendar(F.col("slot"))))
    return spread.own(cut.withColumn("features", features))


def fit(series: DataFrame, lags: Sequence[int] = LAGS, trees: int = TREES, depth: int = DEPTH, step: float = STEP, share: float = SHARE, seed: int = 1) -> GBTRegressionModel:
    """The ensemble of the rows of scaled that have a value before place 0, a key's first slot aside. The last HELD_OUT of a
    key's time tells when to stop, if those rows are LEAST_HELD_OUT or more. ValueError without rows."""
    rows = lag_rows(series.filter("place < 0"), lags).filter("z IS NOT NULL AND slot > first")
    held = F.col("slot") >= F.col("slot") - F.col("place") * HALF_HOUR - HELD_OUT * (F.col("slot") - F.col("place") * HALF_HOUR - F.col("first"))
    table, _ = written(rows.select(array_to_vector("features").alias("features"), F.col("z").alias("label"), held.alias("held")), "lags")
    counts = table.agg(F.count("*").alias("n"), F.count_if("held").alias("held")).first()
    if not counts.n:
        raise ValueError("no values to learn from")
    learner = GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=share, featureSubsetStrategy=str(share) if share < 1 else "all", maxBins=64, validationTol=TOLERANCE, seed=seed)
    if counts.held >= LEAST_HELD_OUT and 2 * counts.held <= counts.n:
        learner = learner.setValidationIndicatorCol("held")
    return learner.fit(table)


def recursive(series: DataFrame, model: GBTRegressionModel, lags: Sequence[int] = LAGS, block: int = 48, width: int = HALF_HOUR) -> DataFrame:
    """k, slot, y, p for the rows of scaled from place 0 on, y not null: each block of slots is forecast slot by slot from
    the values before it and its own forecasts. A row holds one block and the values that its lags can reach."""
    reach = max(lags)
    cut = spread.haloed(series.filter(F.col("place") >= -reach), reach, block, "place").filter("_piece >= 0")
    value = F.struct("place", F.coalesce("z", F.lit(MISSING)).alias("z"))
    packed = cut.groupBy("k", "_piece", "centre", "scale").agg(
        F.sort_array(F.collect_list(F.when(~F.col("_own"), value))).alias("behind"),
        F.sort_array(F.collect_list(F.when(F.col("_own"), F.struct("slot", "y")))).alias("ahead"),
    )
    rows = packed.filter(F.size("ahead") > 0).withColumn("past", F.col("behind.z"))
    # Before a key's first slot nothing is known.
    rows = rows.withColumn("past", F.concat(F.array_repeat(F.lit(MISSING), F.lit(reach) - F.size("past")), F.col("past")))
    model = model.copy().setFeaturesCol("_features").setPredictionCol("_p")
    for at in range(block):
        now = F.col("ahead")[0]["slot"] + at * width
        lagged = F.transform(F.array(*map(F.lit, lags)), lambda n: F.element_at("past", -n))
        features = F.concat(lagged, F.array(*(c.cast("double") for c in calendar(now))))
        rows = model.transform(rows.withColumn("_features", array_to_vector(features)))
        rows = rows.withColumn("past", F.concat("past", F.array("_p"))).drop("_features", "_p")
        if at % STEPS_TOGETHER == STEPS_TOGETHER - 1:
            # Keeps a plan's generated code within what a class can hold.
            rows, _ = written(rows, "recursion")
    pairs = rows.select("k", "centre", "scale", F.explode(F.arrays_zip("ahead", F.slice("past", reach + 1, F.size("ahead")).alias("p"))).alias("r"))
    return pairs.select("k", "r.ahead.slot", "r.ahead.y", (F.col("r.p") * F.col("scale") + F.col("centre")).alias("p")).filter("y IS NOT NULL")


def forecasts(grid: DataFrame, start: int, block: int = 48, trees: int = TREES) -> DataFrame:
    """k, slot, y, p from start (microseconds) on: trees fitted on what lies before, then asked for a block of the grid at a
    time and shown each block behind it. grid: k, slot, y, a row for every slot, y null in the gaps, which have no rows in
    the result. Keys without a value before start have none either."""
    series, _ = written(scaled(grid, start), "scaled")
    return recursive(series, fit(series, trees=trees), block=block)
