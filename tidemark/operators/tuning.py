"""Detector tuning on the synthetic benchmark: every configuration of a grid against a budget of false alarms."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import detectors, injection
from tidemark.operators.folds import folded_blocks
from tidemark.sources import series as S
from tidemark.sources.shared import exists, written

#: The benchmark's series, and the false alarms a year that a configuration may raise on any of them.
KINDS = injection.KINDS
SEEDS = (1, 2, 3, 4, 5)
N = 20_000
NOISE = 1.0
BUDGET = 2.0

MAKE = {"adwin": detectors.Adwin, "kswin": detectors.Kswin, "page_hinkley": detectors.PageHinkley}


def grid() -> list[tuple[str, dict]]:
    """Fixed values: (detector, parameters) of the 504 configurations: 144 of ADWIN, 126 of KSWIN, 234 of Page-Hinkley."""
    out = [
        ("adwin", {"delta": 10.0**-k, "clock": clock, "min_window_length": least})
        for k in range(3, 11)
        for clock in (32, 48, 336)
        for least in (5, 48, 168, 240, 336, 1344)
    ]
    out += [
        ("kswin", {"alpha": alpha, "window_size": window, "stat_size": stat, "seed": 42})
        for alpha in (*(10.0**-k for k in range(4, 10)), 5e-5)
        for window in (336, 480, 672, 1344)
        for stat in (48, 96, 144, 240, 336, 672)
        if window >= 2 * stat
    ]
    thresholds = (425.0, 450.0, 475.0, 500.0, 550.0, 600.0, 650.0, 700.0, 750.0, 800.0, 850.0, 900.0, 950.0)
    out += [
        ("page_hinkley", {"min_instances": n, "delta": delta, "threshold": threshold, "alpha": alpha, "mode": "both"})
        for alpha in (0.9995, 1 - 0.0001)
        for delta in (0.0001, 0.0005, 0.001)
        for n in (20, 30, 50)
        for threshold in thresholds
    ]
    return out


def synthetic_series(spark: SparkSession, seeds: Sequence[int] = SEEDS, n: int = N) -> DataFrame:
    """k, kind, seed, n, pos, y of the benchmark's series."""
    out = None
    for kind in KINDS:
        for seed in seeds:
            rows = S.synthetic(spark, kind, n, NOISE, seed)[0]
            one = rows.select(F.lit("synthetic").alias("k"), F.lit(kind).alias("kind"), F.lit(seed).alias("seed"), F.lit(n).cast("long").alias("n"), F.col("t").alias("pos"), "y")
            out = one if out is None else out.unionByName(one)
    return out


def banks(configs: Sequence[tuple[str, dict]], going: Sequence[int]) -> list[tuple[str, list[int]]]:
    """(name, configurations) that run over a series together: KSWIN by window and sample, ADWIN a few at a time, Page-Hinkley
    all at once."""
    groups: dict[str, list[int]] = {}
    for i in going:
        name, params = configs[i]
        own = f"{params.get('window_size')}/{params.get('stat_size')}/{params.get('seed')}" if name == "kswin" else str(i // 12) if name == "adwin" else "all"
        groups.setdefault(f"{name}/{own}", []).append(i)
    return list(groups.items())


def _bank(configs: Sequence[tuple[str, dict]], members: Sequence[int]):
    name, first = configs[members[0]]
    params = [configs[i][1] for i in members]
    if name == "kswin":
        return detectors.KswinBank([p["alpha"] for p in params], first["window_size"], first["stat_size"], first["seed"])
    return detectors.PageHinkleyBank(params) if name == "page_hinkley" else detectors.Bank([MAKE[name](**p) for p in params])


def alarms_of(series: DataFrame, configs: Sequence[tuple[str, dict]], going: Sequence[int]) -> DataFrame:
    """k, kind, seed, config, pos of every alarm: each group of configurations is a fold over each series of its own, which holds
    the detectors' state and one block of values."""
    groups = banks(configs, going)

    def start(name: str):
        members = groups[int(name.rsplit("|", 1)[1])][1]
        bank = _bank(configs, members)
        return lambda pos, y: [(members[i], place) for i, place in bank.feed(y)]

    number = F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1)))
    rows = series.withColumn("bank", number).select(F.concat_ws("|", "k", "kind", "seed", "bank").alias("k"), "pos", "y")
    found = folded_blocks(rows, start, "name string, config int, pos long")
    parts = F.split("name", r"\|")
    back = lambda i: F.element_at(parts, -i)
    key = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 3), "|")
    return found.select(key.alias("k"), back(3).alias("kind"), back(2).cast("int").alias("seed"), "config", "pos")


def named(spark: SparkSession, configs: Sequence[tuple[str, dict]]) -> DataFrame:
    """config, detector, params (JSON, names in order): a row for each configuration."""
    return spark.createDataFrame([(i, name, json.dumps(params, sort_keys=True)) for i, (name, params) in enumerate(configs)], "config int, detector string, params string")


def failed() -> Column:
    """Whether a row of sweep_rows ends its configuration: any false alarm without drift, elsewhere a missed change or more
    false alarms a year than the budget."""
    none = F.col("kind") == "none"
    return F.when(none, F.col("false_alarms") > 0).otherwise((F.col("missed") > 0) | (F.col("false_per_year") > BUDGET))


def sweep_rows(series: DataFrame, configs: Sequence[tuple[str, dict]]) -> DataFrame:
    """detector, params, k, kind, seed, n, matched, missed, false_alarms, delay, false_per_year of every configuration and series
    that it came to.

    series: k, kind, seed, n, pos (from 0), y. Series without drift come first, then the kinds of drift; a configuration that
    fails on a series of a kind does not go on to the next. What reaches the driver is which configurations go on.
    """
    spark = series.sparkSession
    series, _ = written(series, "series")
    heads = series.groupBy("k", "kind", "seed").agg(F.max("n").alias("n")).withColumn("changes", injection.changes(F.col("kind"), F.col("n")))
    going, done = list(range(len(configs))), None
    for kind in KINDS:
        mine = F.col("kind") == kind
        jobs = heads.filter(mine).withColumn("config", F.explode(F.array(*map(F.lit, going))))
        scores, _ = written(injection.scored(jobs, alarms_of(series.filter(mine), configs, going), ["k", "kind", "seed", "config"]), "tuning")
        ended = scores.groupBy("config").agg(F.max(failed()).alias("failed")).filter("failed")
        going = sorted(set(going) - {r["config"] for r in ended.select("config").collect()})
        done = scores if done is None else done.unionByName(scores)
        if not going:
            break
    return done.join(F.broadcast(named(spark, configs)), "config").drop("config")


def sweep_series(series: DataFrame, configs: Sequence[tuple[str, dict]]) -> DataFrame:
    """detector, params, kind, runs, missed, false_alarms, delay, eligible of every configuration and kind that it came to."""
    rows, _ = written(sweep_rows(series, configs), "swept")
    sums = rows.groupBy("detector", "params", "kind").agg(F.count("*").alias("runs"), F.sum("missed").alias("missed"), F.sum("false_alarms").alias("false_alarms"), F.avg("delay").alias("delay"))
    fine = rows.groupBy("detector", "params").agg((~F.max(failed())).alias("eligible"))
    return sums.join(fine, ["detector", "params"])


def sweep(spark: SparkSession, configs: Sequence[tuple[str, dict]], seeds: Sequence[int] = SEEDS, n: int = N) -> DataFrame:
    """sweep_series over the benchmark's own series."""
    return sweep_series(synthetic_series(spark, seeds, n), configs)


def unfinished(configs: Sequence[tuple[str, dict]], rows: DataFrame) -> list[tuple[str, dict]]:
    """The configurations that sweep rows have nothing of. A sweep's rows are written as one table, so that what stands in it
    is whole."""
    jobs = named(rows.sparkSession, configs)
    return [configs[r.config] for r in jobs.join(rows.select("detector", "params").distinct(), ["detector", "params"], "left_anti").orderBy("config").collect()]


def sweep_into(path: str, series: DataFrame, configs: Sequence[tuple[str, dict]], group: int = 84) -> DataFrame:
    """sweep_rows kept in tables below path, one for each group of configurations: a sweep that was broken off goes on with those
    that no table has, if series are the same. Tables without Spark's mark of success are left out."""
    spark = series.sparkSession
    tables = [f"{path}/part={i}" for i in range(-(-len(configs) // group))]
    whole = [t for t in tables if exists(spark, f"{t}/_SUCCESS")]
    left = unfinished(configs, spark.read.option("basePath", path).parquet(*whole)) if whole else list(configs)
    for table in (t for t in tables if t not in whole):
        now, left = left[:group], left[group:]
        if now:
            sweep_rows(series, now).write.mode("overwrite").parquet(table)
            whole.append(table)
    return spark.read.option("basePath", path).parquet(*whole).drop("part")


def summarised(rows: DataFrame) -> DataFrame:
    """detector, params, eligible, fail_reason, false alarms a year by kind and of all rows, delay by kind and of all drift: a row
    for each configuration of sweep_rows. The reason is that of the first row that failed, by kind, seed and key; a kind the
    configuration did not come to is null, and so are the two means over all rows unless it is eligible."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    reason = F.when(F.col("kind") == "none", "false alarm without drift").when(F.col("missed") > 0, F.concat(F.lit("missed "), "kind")).otherwise(F.concat(F.lit("over the budget on "), "kind"))
    first = F.min(F.when(failed(), F.struct(place.alias("place"), "seed", "k", reason.alias("reason"))))
    of = lambda kind, value: F.avg(F.when(F.col("kind") == kind, F.col(value)))
    out = rows.groupBy("detector", "params").agg(
        first.alias("first"),
        *(of(kind, "false_per_year").alias(f"fa_per_year_{kind}") for kind in KINDS),
        *(of(kind, "delay").alias(f"delay_{kind}") for kind in KINDS[1:]),
        F.max(F.when(F.col("kind") == "none", F.col("false_per_year"))).alias("most_fa_none"),
        F.avg("false_per_year").alias("fa"),
        F.avg(F.when(F.col("kind") != "none", F.col("delay"))).alias("delay"),
    )
    eligible = F.col("first").isNull()
    out = out.withColumns({"eligible": eligible, "fail_reason": F.coalesce("first.reason", F.lit("")), "fa_per_year": F.when(eligible, F.col("fa")), "mean_delay": F.when(eligible, F.col("delay"))})
    return out.drop("first", "fa", "delay")


def winners(summary: DataFrame, names: Sequence[str] = tuple(MAKE)) -> DataFrame:
    """A row for each detector: its eligible configuration of the fewest false alarms a year, then of the shortest delay, then of
    the least parameters as text; without one, status no_eligible_configuration."""
    order = F.struct("fa_per_year", F.coalesce("mean_delay", F.lit(float("inf"))), "params")
    best = summary.filter("eligible").groupBy("detector").agg(F.min_by(F.struct("params", "fa_per_year", "mean_delay", "fa_per_year_none", "most_fa_none"), order).alias("b"))
    every = summary.sparkSession.createDataFrame([(n,) for n in names], "detector string")
    status = F.when(F.col("b").isNull(), "no_eligible_configuration").otherwise("selected")
    return every.join(best, "detector", "left").select("detector", "b.*", status.alias("status"))
