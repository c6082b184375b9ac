"""Drift put into real streams: their residuals, drawn anew block by block, with shifts at known places.

A series is made by joins alone: each of its blocks takes a block of the same key's residuals, chosen by a fixed rule of the
block's number and the series' seed, so that any part of it can be made again; what is added depends on the place only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.series import rounded

#: Rows of a block (a day), and what is added after a change, in standard deviations of the residuals.
BLOCK = 48
SHIFT = 4.0
#: Rows behind a change within which an alarm counts for it, at most; a sixth of the series if that is less, so that two
#: changes never share an alarm.
TOLERANCE = 336
KINDS = ("none", "sudden", "gradual", "recurring")


def ramp(n: Column) -> Column:
    """Rows that a gradual change takes."""
    return F.greatest(F.lit(1), F.least(F.lit(1000), F.floor(n / 4))).cast("long")


def lift(kind: Column, t: Column, n: Column) -> Column:
    """The share of the shift that is added at place t of n: all from a quarter on (sudden), rising from there (gradual), all in
    the middle third (recurring)."""
    quarter, a, b = (F.floor(n * x / y).cast("long") for x, y in ((1, 4), (1, 3), (2, 3)))
    rising = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - quarter) / ramp(n)))
    return F.when((kind == "sudden") & (t >= quarter), 1.0).when(kind == "gradual", rising).when((kind == "recurring") & (t >= a) & (t < b), 1.0).otherwise(0.0)


def changes(kind: Column, n: Column) -> Column:
    """Array of (start, stop): the places, both inclusive, where an alarm counts for each change of a series of n rows."""
    quarter, a, b = (F.floor(n * x / y).cast("long") for x, y in ((1, 4), (1, 3), (2, 3)))
    within = F.least(F.lit(TOLERANCE).cast("long"), F.floor(n / 6).cast("long"))
    window = lambda start, more=0: F.struct(start.alias("start"), F.least(n - 1, start + more + within).alias("stop"))
    none = F.array(window(quarter))
    return F.when(kind == "sudden", none).when(kind == "gradual", F.array(window(quarter, ramp(n)))).when(kind == "recurring", F.array(window(a), window(b))).otherwise(F.slice(none, 1, 0))


def standard_residuals(forecasts: DataFrame) -> DataFrame:
    """k, pos, e: a key's errors in units of their standard deviation, numbered from 0. forecasts has k, pos, y, p."""
    errors = forecasts.select("k", "pos", (F.col("y") - F.col("p")).alias("e"))
    spread = errors.groupBy("k").agg(F.stddev_pop("e").alias("sd"))
    numbered = F.row_number().over(Window.partitionBy("k").orderBy("pos")).cast("long") - 1
    return errors.join(spread, "k").filter("sd > 0").select("k", numbered.alias("pos"), rounded(F.col("e") / F.col("sd"), 6).alias("e"))


def injected(residuals: DataFrame, kinds: Sequence[str] = KINDS, seeds: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """k, kind, seed, n, pos, y: for each key, kind and seed a series as long as the key's residuals (whole blocks of them).

    residuals: k, pos (from 0 without gaps), e. A key with less than a block has no series.
    """
    blocks = residuals.groupBy("k").agg(F.floor(F.count("*") / BLOCK).alias("blocks"))
    b = F.floor(F.col("pos") / BLOCK).cast("long")
    places = residuals.select("k", "pos").join(blocks, "k").filter(F.col("pos") < F.col("blocks") * BLOCK)
    seeded = places.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    drawn = F.pmod(31 * b * b + 17 * b * F.col("seed") + 7 * F.col("seed") + 3, F.col("blocks"))
    wanted = seeded.select("k", "seed", "pos", (F.col("blocks") * BLOCK).alias("n"), (drawn * BLOCK + F.col("pos") % BLOCK).alias("source"))
    found = wanted.join(residuals.select("k", F.col("pos").alias("source"), "e"), ["k", "source"])
    each = found.withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    return each.select("k", "kind", "seed", "n", "pos", rounded(F.col("e") + SHIFT * lift(F.col("kind"), F.col("pos"), F.col("n")), 6).alias("y"))


def scored(series: DataFrame, alarms: DataFrame, by: list[str]) -> DataFrame:
    """*by, runs, matched, missed, false_alarms, delay, false_per_year for each row of series (k, kind, n and more): each change
    takes the first alarm in its window, all other alarms are false. alarms: by and pos; a series may have none."""
    hits = alarms.join(series.select(*by, "changes"), by).select(*by, "pos", F.get(F.filter("changes", lambda c: F.col("pos").between(c["start"], c["stop"])), F.lit(0))["start"].alias("start"))
    first = hits.groupBy(*by, "start").agg(F.count("*").alias("n_alarms"), F.min("pos").alias("first"))
    matched = F.col("start").isNotNull()
    found = first.groupBy(*by).agg(F.sum("n_alarms").alias("alarms"), F.count_if(matched).alias("matched"), F.avg(F.when(matched, F.col("first") - F.col("start"))).alias("delay"))
    out = series.join(found, by, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("alarms", "matched")})
    false = F.col("alarms") - F.col("matched")
    return out.withColumns({"missed": F.size("changes") - F.col("matched"), "false_alarms": false, "false_per_year": false / F.col("n") * 17_520}).drop("alarms", "changes")
