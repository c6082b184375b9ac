"""Report queries over the ledger and the streams, and the run surface."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ledger, metrics, regimes, spread, windows
from tidemark.plans import streams as C
from tidemark.plans.evaluation import _roll
from tidemark.plans.registry import query
from tidemark.plans.scans import r
from tidemark.sources import series as S


@query("agg_mean_sd_text", "SELECT model, arm, CASE WHEN n = 1 THEN printf('%.1f', m) || ' ± n/a' ELSE printf('%.1f ± %.1f', m, sd) END AS cell FROM (SELECT model, arm, count(*) AS n, round(avg(mae), 4) AS m, round(stddev_samp(mae), 4) AS sd FROM runs GROUP BY ALL)")
def agg_mean_sd_text(spark, sf_dir):
    rows = C.runs(spark, sf_dir).groupBy("model", "arm").agg(F.count("*").alias("n"), r(F.avg("mae"), 4).alias("m"), r(F.stddev_samp("mae"), 4).alias("sd"))
    return rows.select("model", "arm", ledger.mean_sd_text("m", "sd", "n").alias("cell"))


def _means(spark, sf_dir, keys, value="mae"):
    return C.runs(spark, sf_dir).groupBy(*keys).agg(r(F.avg(value), 4).alias("mean"), r(F.stddev_samp(value), 4).alias("sd"), F.count("*").alias("n"))


_LATEST = "(SELECT * FROM (SELECT *, max(yr) OVER (PARTITION BY model, arm, region, seed) AS m FROM ledger) WHERE yr = m)"


@query("top_latest_delay", f"SELECT model AS detector, arm AS kind, round(avg(metric_value) FILTER (WHERE metric_name = 'mae'), 4) AS delay, round(stddev_samp(metric_value) FILTER (WHERE metric_name = 'mae'), 4) AS delay_sd, count(*) FILTER (WHERE metric_name = 'mae') AS n FROM {_LATEST} GROUP BY ALL")
def top_latest_delay(spark, sf_dir):
    rows = ledger.latest_runs(C.ledger(spark, sf_dir).withColumn("timestamp", F.col("yr")), ["model", "arm", "region", "seed"]).filter("metric_name = 'mae'")
    return rows.groupBy(F.col("model").alias("detector"), F.col("arm").alias("kind")).agg(r(F.avg("metric_value"), 4).alias("delay"), r(F.stddev_samp("metric_value"), 4).alias("delay_sd"), F.count("*").alias("n"))


@query("jn_delay_rate", "SELECT model AS detector, arm AS kind, delay, rate FROM (SELECT model, arm, round(avg(mae), 4) AS delay FROM runs GROUP BY ALL) LEFT JOIN (SELECT model, arm, round(sum(n_retrains) / count(*) * 365.0, 4) AS rate FROM runs WHERE arm <> 'A' GROUP BY ALL) USING (model, arm)")
def jn_delay_rate(spark, sf_dir):
    rows = C.runs(spark, sf_dir)
    rate = rows.filter("arm <> 'A'").groupBy("model", "arm").agg(r(F.sum("n_retrains") / F.count("*") * 365.0, 4).alias("rate"))
    out = rows.groupBy("model", "arm").agg(r(F.avg("mae"), 4).alias("delay")).join(rate, ["model", "arm"], "left")
    return out.select(F.col("model").alias("detector"), F.col("arm").alias("kind"), "delay", "rate")


@query("agg_gain_samples", "SELECT a.model, a.region, a.arm, round(avg(a.mae - b.mae), 4) AS gain, sum(a.train_samples)::BIGINT AS samples FROM runs a LEFT JOIN (SELECT * FROM runs WHERE arm = 'A') b USING (model, region, seed, yr) GROUP BY ALL")
def agg_gain_samples(spark, sf_dir):
    out = metrics.paired_gain(C.runs(spark, sf_dir), ["model", "region", "seed", "yr"], "arm", "A", "mae", "n_retrains")
    return out.groupBy("model", "region", "arm").agg(r(F.avg("gain"), 4).alias("gain"), F.sum("train_samples").alias("samples"))


def _text(value: str, digits: int) -> str:
    """SQL of mean and deviation as text; the small shift keeps values midway between two texts from going either way."""
    m, sd = f"round(avg({value}), 4) + 1e-7", f"round(stddev_samp({value}), 4) + 1e-7"
    return f"CASE count({value}) WHEN 0 THEN 'n/a' WHEN 1 THEN printf('%.{digits}f', {m}) || ' ± n/a' ELSE printf('%.{digits}f ± %.{digits}f', {m}, {sd}) END"


def _cell(value: str, digits: int):
    """_text as a column, of a grouping."""
    return F.struct((r(F.avg(value), 4) + 1e-7).alias("m"), (r(F.stddev_samp(value), 4) + 1e-7).alias("sd"), F.count(value).alias("n")).alias(f"_{value}_{digits}")


def _cells(rows, **names):
    """rows with the texts of _cell's structs under their names."""
    for name, (value, digits) in names.items():
        at = f"_{value}_{digits}"
        rows = rows.withColumn(name, ledger.mean_sd_text(f"{at}.m", f"{at}.sd", f"{at}.n", digits)).drop(at)
    return rows


@query("rp_t4", f"""SELECT model, region, arm, round(avg(n_retrains), 0)::BIGINT AS retrains, round(avg(train_samples), 0)::BIGINT AS samples, {_text("wall", 0)} AS wall_clock,
 {_text("gain", 1)} AS gain, {_text("per", 2)} AS gain_per_retrain, count(DISTINCT seed) AS seeds
 FROM (SELECT a.*, a.width AS wall, a.mae - b.mae AS gain, (a.mae - b.mae) / nullif(a.n_retrains, 0) AS per FROM runs a LEFT JOIN (SELECT * FROM runs WHERE arm = 'A') b USING (model, region, seed, yr)) GROUP BY model, region, arm""")
def rp_t4(spark, sf_dir):
    """Cost and gain of each arm beside arm A: retrains, training rows, time (a run's mean quantity stands for it), gain in all and
    for each retrain as mean and deviation over its runs, seeds. Runs without a retrain or a run of arm A have no share in them."""
    out = metrics.paired_gain(C.runs(spark, sf_dir).withColumn("wall", F.col("width")), ["model", "region", "seed", "yr"], "arm", "A", "mae", "n_retrains")
    rows = out.withColumnRenamed("gain_per_retrain", "per").groupBy("model", "region", "arm").agg(
        r(F.avg("n_retrains"), 0).cast("long").alias("retrains"), r(F.avg("train_samples"), 0).cast("long").alias("samples"), _cell("wall", 0), _cell("gain", 1), _cell("per", 2), F.countDistinct("seed").alias("seeds")
    )
    return _cells(rows, wall_clock=("wall", 0), gain=("gain", 1), gain_per_retrain=("per", 2))


_TOP = "(SELECT *, row_number() OVER (PARTITION BY model, region ORDER BY mean, arm) AS place FROM (SELECT model, region, arm, round(avg(mae), 4) AS mean, round(stddev_samp(mae), 4) AS sd FROM runs GROUP BY ALL))"


@query("top_window", f"SELECT a.model, a.region, a.arm, b.mean - a.mean <= greatest(a.sd, b.sd) AS tie FROM {_TOP} a JOIN {_TOP} b USING (model, region) WHERE a.place = 1 AND b.place = 2")
def top_window(spark, sf_dir):
    w = Window.partitionBy("model", "region").orderBy("mean", "arm")
    ranked = _means(spark, sf_dir, ["model", "region", "arm"]).withColumns({"place": F.row_number().over(w), "next": F.lead("mean").over(w), "next_sd": F.lead("sd").over(w)})
    tie = F.col("next") - F.col("mean") <= F.greatest("sd", "next_sd")
    return ranked.filter("place = 1").select("model", "region", "arm", tie.alias("tie"))


@query("rp_sweep", f"SELECT model, region, arm, mean, place, place = 1 AS winner FROM {_TOP}")
def rp_sweep(spark, sf_dir):
    w = Window.partitionBy("model", "region").orderBy("mean", "arm")
    return _means(spark, sf_dir, ["model", "region", "arm"]).withColumn("place", F.row_number().over(w).cast("long")).select("model", "region", "arm", "mean", "place", (F.col("place") == 1).alias("winner"))


def _coverage_table(cut, scale):
    """k, regime, n, coverage, width, norm_width, worst_24h, complete_windows of intervals in pieces with a halo of 47: widths
    also as a share of the key's training mean; the worst 24 hours are the lowest coverage of 48 consecutive half-hours inside
    one regime, of which complete_windows are counted."""
    of = spread.by_piece()
    day = windows.over(of).rowsBetween(-47, 0)
    same = F.min("regime").over(day) == F.max("regime").over(day)
    whole = windows.eligible(F.lit(True), F.col("slot"), 48, of)
    rolled = cut.withColumns({"ok": F.coalesce(same, F.lit(False)) & whole, "rc": windows.rolling_mean(metrics.covered().cast("double"), 48, of)})
    return spread.own(rolled).join(scale, "k").groupBy("k", "regime").agg(
        F.count("*").alias("n"), r(metrics.coverage()).alias("coverage"), r(metrics.width()).alias("width"), r(metrics.width() / F.first("scale")).alias("norm_width"),
        r(F.min(F.when(F.col("ok"), F.col("rc")))).alias("worst_24h"), F.count_if("ok").alias("complete_windows"),
    )


@query("rp_t5", """, w5 AS (SELECT *, (y BETWEEN lower AND upper)::INT AS hit, avg((y BETWEEN lower AND upper)::INT) OVER w AS rc,
 coalesce(count(*) OVER w = 48 AND min(regime) OVER w = max(regime) OVER w AND slot - lag(slot, 47) OVER o = 47 * 1800000000::BIGINT, false) AS ok
 FROM ivl WINDOW o AS (PARTITION BY k ORDER BY pos), w AS (PARTITION BY k ORDER BY pos ROWS 47 PRECEDING)),
 sc AS (SELECT k, avg(y) AS scale FROM s WHERE split = 'train' GROUP BY k)
 SELECT k, regime, count(*) AS n, round(avg(hit), 6) AS coverage, round(avg(upper - lower), 6) AS width, round(avg(upper - lower) / any_value(scale), 6) AS norm_width,
 round(min(rc) FILTER (WHERE ok), 6) AS worst_24h, count(*) FILTER (WHERE ok) AS complete_windows FROM w5 JOIN sc USING (k) GROUP BY k, regime""")
def rp_t5(spark, sf_dir):
    placed = C.placed(spark, sf_dir)
    scale = placed.filter("split = 'train'").groupBy("k").agg(F.avg("y").alias("scale"))
    labelled = regimes.global_regimes(placed, C.overlapping(spark, sf_dir))
    return _coverage_table(C.intervals_in_pieces(labelled, 47), scale)


_PICK = "(SELECT *, row_number() OVER (PARTITION BY region ORDER BY mean, model) AS place FROM (SELECT region, model, round(avg(mae), 2) AS mean, round(stddev_samp(mae), 2) AS sd, round(avg(width), 4) AS cost FROM runs GROUP BY ALL))"


def _picked(spark, sf_dir):
    w = Window.partitionBy("region").orderBy("mean", "model")
    rows = C.runs(spark, sf_dir).groupBy("region", "model").agg(r(F.avg("mae"), 2).alias("mean"), r(F.stddev_samp("mae"), 2).alias("sd"), r(F.avg("width"), 4).alias("cost"))
    rows = rows.withColumns({"place": F.row_number().over(w)}).withColumns({f"l_{c}": F.first(c).over(w) for c in ("mean", "sd", "cost")})
    return rows.filter((F.col("place") == 1) | (F.col("mean") <= F.col("l_mean") + F.col("l_sd")) & (F.col("cost") < F.col("l_cost")))


@query("top_arm_retrains", "SELECT model, arm FROM (SELECT model, arm, row_number() OVER (PARTITION BY model ORDER BY fa, delay, arm) AS p FROM (SELECT model, arm, sum(n_retrains)::BIGINT AS fa, round(avg(mae), 4) AS delay FROM runs GROUP BY ALL)) WHERE p = 1")
def top_arm_retrains(spark, sf_dir):
    rows = C.runs(spark, sf_dir).groupBy("model", "arm").agg(F.sum("n_retrains").alias("fa"), r(F.avg("mae"), 4).alias("delay"))
    return rows.withColumn("p", F.row_number().over(Window.partitionBy("model").orderBy("fa", "delay", "arm"))).filter("p = 1").select("model", "arm")


@query("agg_arm_limit", "SELECT model, arm, count(*) AS n, max(n_retrains) AS worst, CASE WHEN max(n_retrains) > 3 THEN 'false alarms' ELSE 'passed' END AS reason FROM runs GROUP BY ALL")
def agg_arm_limit(spark, sf_dir):
    worst = F.max("n_retrains")
    return C.runs(spark, sf_dir).groupBy("model", "arm").agg(F.count("*").alias("n"), worst.alias("worst"), F.when(worst > 3, "false alarms").otherwise("passed").alias("reason"))


@query("rp_f1", f"SELECT slot, round(avg(rolling), 6) AS mean, count(rolling) AS n FROM ({_roll('abs(y - p)', 'fc', 48)}) GROUP BY slot HAVING count(rolling) >= 2")
def rp_f1(spark, sf_dir):
    rows = C.forecasts(spark, sf_dir).withColumn("rolling", windows.rolling_mean(metrics.error(), 48))
    return rows.groupBy("slot").agg(r(F.avg("rolling")).alias("mean"), F.count("rolling").alias("n")).filter("n >= 2")


