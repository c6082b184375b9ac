"""Human-review escalation: how much to review, and how well what is not reviewed is covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import spread
from tidemark.operators.windows import cumulative_by_score


def width_score() -> Column:
    return F.round(F.col("upper") - F.col("lower"), 6)


def curve(scored: DataFrame, key: str = "k", score: str = "score", hit: str = "hit") -> DataFrame:
    """key, threshold, n, kept, review_rate, retained_coverage: every score as a threshold, and minus infinity below all.

    Rows with a score above the threshold are reviewed; ties stay together.
    """
    steps = cumulative_by_score(scored, score, F.col(hit), key).withColumnRenamed(score, "threshold")
    totals = scored.groupBy(key).agg(F.count("*").alias("n"))
    floor = totals.select(key, F.lit(float("-inf")).alias("threshold"), F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("hits"))
    both = steps.unionByName(floor).join(totals, key)
    return both.select(
        key, "threshold", "n", "kept", (1 - F.col("kept") / F.col("n")).alias("review_rate"), (F.col("hits") / F.nullif("kept", F.lit(0))).alias("retained_coverage")
    )


def curve_by_group(scored: DataFrame, group: str, key: str = "k", score: str = "score", hit: str = "hit") -> DataFrame:
    """As curve, per group of a key, on the key's common thresholds: a group's own steps carried forward over the
    grid, in ranges of it."""
    grid = scored.select(key, F.col(score).alias("threshold")).unionByName(scored.select(key, F.lit(float("-inf")).alias("threshold"))).distinct()
    groups = scored.groupBy(key, group).agg(F.count("*").alias("n"))
    steps = scored.groupBy(key, group, F.col(score).alias("threshold")).agg(F.count("*").alias("_n"), F.sum(F.col(hit).cast("long")).alias("_h"))
    stepped = grid.join(groups, key).join(steps, [key, group, "threshold"], "left").withColumn("_of", F.struct(key, group))
    out = spread.running(stepped, {"kept": F.col("_n"), "hits": F.col("_h")}, "threshold", "_of")
    return out.select(
        key, group, "threshold", "n", "kept", (1 - F.col("kept") / F.col("n")).alias("review_rate"), (F.col("hits") / F.nullif("kept", F.lit(0))).alias("retained_coverage")
    )


def rate_for_coverage(target: float, least_kept: int = 1) -> Column:
    """Least review rate that reaches a coverage on enough kept rows; null if none does."""
    return F.min(F.when((F.col("retained_coverage") >= target) & (F.col("kept") >= least_kept), F.col("review_rate")))


def coverage_at_budget(budget: float) -> Column:
    """Coverage at the greatest review rate within the budget; the lowest threshold if several have it."""
    best = F.max_by(F.struct("retained_coverage"), F.when(F.col("review_rate") <= budget, F.struct(F.col("review_rate"), -F.col("threshold"))))
    return best["retained_coverage"]


def operating_points(curves: DataFrame, targets=(0.90, 0.95), budgets=(0.05, 0.10, 0.20), least_kept: int = 48, key: str = "k") -> DataFrame:
    cells = [rate_for_coverage(t, least_kept).alias(f"rate_for_{round(t * 100)}") for t in targets]
    cells += [coverage_at_budget(b).alias(f"coverage_at_{round(b * 100)}") for b in budgets]
    return curves.groupBy(key).agg(*cells, F.count_distinct("review_rate").alias("n_rates"))
