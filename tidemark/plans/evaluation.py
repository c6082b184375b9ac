"""Queries on metrics, windows, regimes, intervals and escalation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import escalation, forecast, metrics, regimes, selection, spread, windows
from tidemark.plans import streams as C
from tidemark.plans.registry import query
from tidemark.plans.scans import r
from tidemark.sources import series as S

_ROLL = "SELECT k, slot, CASE WHEN n = {w} THEN m END AS rolling FROM (SELECT k, slot, count(*) OVER w AS n, avg({x}) OVER w AS m FROM {t} WINDOW w AS (PARTITION BY k ORDER BY pos ROWS {p} PRECEDING))"


def _roll(x: str, t: str, w: int) -> str:
    return _ROLL.format(x=x, t=t, w=w, p=w - 1)


@query("slice_rolling_mae", f"SELECT split, k, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(max(rolling), 6) AS worst FROM fc JOIN ({_roll('abs(y - p)', 'fc', 48)}) USING (k, slot) GROUP BY ALL")
def slice_rolling_mae(spark, sf_dir):
    rows = C.forecasts(spark, sf_dir).withColumn("rolling", windows.rolling_mean(metrics.error(), 48))
    return rows.groupBy("split", "k").agg(F.count("*").alias("n"), r(metrics.mae()).alias("mae"), r(F.max("rolling")).alias("worst"))


@query("agg_mean_mae", "SELECT k, round(avg(abs(y - p)), 6) AS mae FROM fc GROUP BY k")
def agg_mean_mae(spark, sf_dir):
    return C.forecasts(spark, sf_dir).groupBy("k").agg(r(metrics.mae()).alias("mae"))


@query("agg_abs_error", "SELECT k, slot, round(abs(y - p), 6) AS e FROM fc")
def agg_abs_error(spark, sf_dir):
    return C.forecasts(spark, sf_dir).select("k", "slot", r(metrics.error()).alias("e"))


@query("agg_by_regime", "SELECT regime, count(*) AS n, round(avg(abs(fc.y - p)), 6) AS mae FROM fc JOIN lab USING (k, slot) GROUP BY regime")
def agg_by_regime(spark, sf_dir):
    rows = C.forecasts(spark, sf_dir).join(C.labelled(spark, sf_dir).select("k", "slot", "regime"), ["k", "slot"])
    return rows.groupBy("regime").agg(F.count("*").alias("n"), r(metrics.mae()).alias("mae"))


@query("agg_pinball", "SELECT k, round(avg(CASE WHEN y >= p THEN 0.05 * (y - p) ELSE -0.95 * (y - p) END), 6) AS loss FROM fc GROUP BY k")
def agg_pinball(spark, sf_dir):
    return C.forecasts(spark, sf_dir).groupBy("k").agg(r(metrics.pinball(0.05)).alias("loss"))


@query("agg_interval_pinball", "SELECT k, round((avg(CASE WHEN y >= lower THEN 0.05 * (y - lower) ELSE -0.95 * (y - lower) END) + avg(CASE WHEN y >= upper THEN 0.95 * (y - upper) ELSE -0.05 * (y - upper) END)) / 2, 6) AS loss FROM iv GROUP BY k")
def agg_interval_pinball(spark, sf_dir):
    return C.intervals(spark, sf_dir).groupBy("k").agg(r(metrics.interval_pinball(0.1)).alias("loss"))


@query("agg_coverage", "SELECT k, round(avg((y BETWEEN lower AND upper)::INT), 6) AS coverage FROM iv GROUP BY k")
def agg_coverage(spark, sf_dir):
    return C.intervals(spark, sf_dir).groupBy("k").agg(r(metrics.coverage()).alias("coverage"))


@query("agg_width", "SELECT k, round(avg(upper - lower), 6) AS width FROM iv GROUP BY k")
def agg_width(spark, sf_dir):
    return C.intervals(spark, sf_dir).groupBy("k").agg(r(metrics.width()).alias("width"))


@query("agg_width_scale", "SELECT k, round(avg(y), 6) AS scale FROM s WHERE split = 'train' GROUP BY k")
def agg_width_scale(spark, sf_dir):
    return C.stream(spark, sf_dir).filter("split = 'train'").groupBy("k").agg(r(F.avg("y")).alias("scale"))


@query("agg_norm_width", "SELECT k, round(avg(upper - lower) / any_value(scale), 6) AS norm FROM iv JOIN (SELECT k, avg(y) AS scale FROM s WHERE split = 'train' GROUP BY k) USING (k) GROUP BY k")
def agg_norm_width(spark, sf_dir):
    scale = C.stream(spark, sf_dir).filter("split = 'train'").groupBy("k").agg(F.avg("y").alias("scale"))
    return C.intervals(spark, sf_dir).join(scale, "k").groupBy("k").agg(r(metrics.width() / F.first("scale")).alias("norm"))


_ELIGIBLE = """el AS (SELECT *, coalesce(row_number() OVER o >= 12 AND sum((regime = 'drift')::INT) OVER w = 12 AND slot - lag(slot, 11) OVER o = 11 * 1800000000::BIGINT, false) AS ok,
 CASE WHEN count(*) OVER w = 12 THEN avg((y BETWEEN lower AND upper)::INT) OVER w END AS rc FROM ivl WINDOW o AS (PARTITION BY k ORDER BY pos), w AS (PARTITION BY k ORDER BY pos ROWS 11 PRECEDING))"""


def _eligible(spark, sf_dir):
    labelled = regimes.global_regimes(C.placed(spark, sf_dir), C.overlapping(spark, sf_dir))
    rows, of = C.intervals_in_pieces(labelled, 11), spread.by_piece()
    flagged = rows.withColumns({"ok": windows.eligible(F.col("regime") == "drift", F.col("slot"), 12, of), "rc": windows.rolling_mean(metrics.covered().cast("double"), 12, of)})
    return spread.own(flagged)


@query("agg_uq_by_regime", f", {_ELIGIBLE} SELECT k, regime, count(*) AS n, round(avg((y BETWEEN lower AND upper)::INT), 6) AS coverage, round(avg(upper - lower), 6) AS width, round(min(rc) FILTER (WHERE ok), 6) AS worst, count(*) FILTER (WHERE ok) AS windows FROM el GROUP BY ALL")
def agg_uq_by_regime(spark, sf_dir):
    return _eligible(spark, sf_dir).groupBy("k", "regime").agg(
        F.count("*").alias("n"), r(metrics.coverage()).alias("coverage"), r(metrics.width()).alias("width"), r(F.min(F.when(F.col("ok"), F.col("rc")))).alias("worst"), F.count_if("ok").alias("windows")
    )


@query("win_eligible", f", {_ELIGIBLE} SELECT k, slot, ok FROM el")
def win_eligible(spark, sf_dir):
    return _eligible(spark, sf_dir).select("k", "slot", "ok")


@query("win_count_complete", f", {_ELIGIBLE} SELECT k, count(*) FILTER (WHERE ok) AS n FROM el GROUP BY k")
def win_count_complete(spark, sf_dir):
    return _eligible(spark, sf_dir).groupBy("k").agg(F.count_if("ok").alias("n"))


@query("win_worst", f", {_ELIGIBLE} SELECT k, round(min(rc) FILTER (WHERE ok), 6) AS worst FROM el GROUP BY k")
def win_worst(spark, sf_dir):
    return _eligible(spark, sf_dir).groupBy("k").agg(r(F.min(F.when(F.col("ok"), F.col("rc")))).alias("worst"))


@query("win_rolling_mae", f"SELECT k, slot, round(rolling, 6) AS rolling FROM ({_roll('abs(y - p)', 'fc', 336)})")
def win_rolling_mae(spark, sf_dir):
    rows = C.forecasts_in_pieces(C.placed(spark, sf_dir), 335)
    return spread.own(rows.withColumn("rolling", r(windows.rolling_mean(metrics.error(), 336, spread.by_piece())))).select("k", "slot", "rolling")


def _rolling_coverage(spark, sf_dir, size):
    rows = C.intervals_in_pieces(C.placed(spark, sf_dir), size - 1)
    rolling = windows.rolling_mean(metrics.covered().cast("double"), size, spread.by_piece())
    return spread.own(rows.withColumn("rolling", r(rolling))).select("k", "slot", "rolling")


@query("win_rolling_cov", f"SELECT k, slot, round(rolling, 6) AS rolling FROM ({_roll('(y BETWEEN lower AND upper)::INT', 'iv', 48)})")
def win_rolling_cov(spark, sf_dir):
    return _rolling_coverage(spark, sf_dir, 48)


@query("win_rolling_cov_7d", f"SELECT k, slot, round(rolling, 6) AS rolling FROM ({_roll('(y BETWEEN lower AND upper)::INT', 'iv', 336)})")
def win_rolling_cov_7d(spark, sf_dir):
    return _rolling_coverage(spark, sf_dir, 336)


@query("win_nonconf", "SELECT k, slot, round(CASE WHEN n = 48 THEN m END, 6) AS nonconformity FROM (SELECT k, slot, split, count(*) OVER w AS n, avg(abs(y - p)) OVER w AS m FROM fc WHERE split <> 'train' WINDOW w AS (PARTITION BY k ORDER BY pos ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)) WHERE split = 'test'")
def win_nonconf(spark, sf_dir):
    rows = C.forecasts(spark, sf_dir).filter("split <> 'train'")
    return rows.select("k", "slot", "split", r(windows.previous_mean(metrics.error(), 48)).alias("nonconformity")).filter("split = 'test'").drop("split")


@query("win_lag_seasonal", "SELECT k, slot, p FROM fc")
def win_lag_seasonal(spark, sf_dir):
    return C.forecasts(spark, sf_dir).select("k", "slot", "p")


@query("fc_seasonal_naive", "SELECT k, split, round(avg(abs(y - p)), 6) AS mae FROM fc WHERE split <> 'train' GROUP BY ALL")
def fc_seasonal_naive(spark, sf_dir):
    return C.forecasts(spark, sf_dir).filter("split <> 'train'").groupBy("k", "split").agg(r(metrics.mae()).alias("mae"))


@query("fc_fourier", "SELECT k, slot, round(sin(2 * pi() * pos / 48), 6) AS sin_48_1, round(cos(2 * pi() * pos / 48), 6) AS cos_48_1, round(sin(4 * pi() * pos / 48), 6) AS sin_48_2, round(cos(4 * pi() * pos / 48), 6) AS cos_48_2 FROM s")
def fc_fourier(spark, sf_dir):
    rows = C.stream(spark, sf_dir).select("k", "slot", *forecast.fourier(F.col("pos"), {48: 2}))
    return rows.withColumns({c: r(c) for c in rows.columns[2:]})


@query("fc_frame", "SELECT k AS unique_id, make_timestamp(slot) AS ds, y FROM s")
def fc_frame(spark, sf_dir):
    return C.stream(spark, sf_dir).select(F.col("k").alias("unique_id"), S.at("slot").alias("ds"), "y")


@query("fc_lag_features", "SELECT k, slot, " + ", ".join(f"lag(y, {n}) OVER w AS y_lag_{n}" for n in (1, 2, 3, 48, 96, 144, 336)) + " FROM s WINDOW w AS (PARTITION BY k ORDER BY pos)")
def fc_lag_features(spark, sf_dir):
    return forecast.lag_features(C.stream(spark, sf_dir), (1, 2, 3, 48, 96, 144, 336)).drop("y", "pos", "split")


@query("win_cumcounts", "SELECT k, score, sum(n) OVER (PARTITION BY k ORDER BY score)::BIGINT AS kept, sum(h) OVER (PARTITION BY k ORDER BY score)::BIGINT AS hits FROM (SELECT k, score, count(*) AS n, sum(hit::INT) AS h FROM scored GROUP BY ALL)")
def win_cumcounts(spark, sf_dir):
    return windows.cumulative_by_score(C.scored(spark, sf_dir), "score", F.col("hit"))


@query("win_gaps_islands", "SELECT k, regime, min(slot) AS start, max(slot) + 1800000000 AS stop, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY pos) AS run FROM (SELECT *, (regime IS DISTINCT FROM lag(regime) OVER (PARTITION BY k ORDER BY pos))::INT AS c FROM lab)) GROUP BY k, regime, run")
def win_gaps_islands(spark, sf_dir):
    return windows.islands(C.labelled(spark, sf_dir), "regime")


@query("win_latest_rows", "SELECT model, arm, region, seed, yr, mae FROM (SELECT *, max(yr) OVER (PARTITION BY model, arm, region) AS m FROM runs) WHERE yr = m")
def win_latest_rows(spark, sf_dir):
    return windows.latest(C.runs(spark, sf_dir), ["model", "arm", "region"], "yr").select("model", "arm", "region", "seed", "yr", "mae")


@query("win_diff", "SELECT k, us, us - lag(us) OVER (PARTITION BY k ORDER BY us) AS gap FROM alarm")
def win_diff(spark, sf_dir):
    return C.alarms(spark, sf_dir).withColumn("gap", F.col("us") - F.lag("us").over(Window.partitionBy("k").orderBy("us")))


@query("win_smooth", "SELECT k, slot, round((inside + greatest(0, 3 + 1 - rn) * f + greatest(0, rn + 3 - n) * l) / 7, 6) AS smooth FROM (SELECT k, slot, row_number() OVER o AS rn, count(*) OVER a AS n, first_value(y) OVER a AS f, last_value(y) OVER a AS l, sum(y) OVER c AS inside FROM s WINDOW o AS (PARTITION BY k ORDER BY pos), a AS (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), c AS (PARTITION BY k ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))")
def win_smooth(spark, sf_dir):
    return C.stream(spark, sf_dir).select("k", "slot", r(windows.smooth_padded(F.col("y"), 3)).alias("smooth"))


@query("win_label_regimes", "SELECT k, pos, CASE WHEN pos < 300 THEN 'pre_drift' WHEN pos < 636 OR (pos >= 700 AND pos < 1036) THEN 'drift' ELSE 'post_drift' END AS regime FROM s")
def win_label_regimes(spark, sf_dir):
    return regimes.position_regimes(C.stream(spark, sf_dir), [300, 700]).select("k", "pos", "regime")


# Regimes and windows.


@query("ev_windows", "SELECT event_id, drift_start, drift_end, pre_start, post_end FROM win")
def ev_windows(spark, sf_dir):
    return C.windows(spark).select("event_id", "drift_start", "drift_end", "pre_start", "post_end")


@query("ev_match_window", "SELECT event_id, drift_start, match_end FROM win")
def ev_match_window(spark, sf_dir):
    return C.windows(spark).select("event_id", "drift_start", "match_end")


@query("ev_global_regime", "SELECT k, slot, regime, event_id FROM lab")
def ev_global_regime(spark, sf_dir):
    return C.labelled(spark, sf_dir).select("k", "slot", "regime", "event_id")


@query("jn_interval_regime", "SELECT regime, event_id, count(*) AS n FROM lab GROUP BY ALL")
def jn_interval_regime(spark, sf_dir):
    return C.labelled(spark, sf_dir).groupBy("regime", "event_id").agg(F.count("*").alias("n"))


@query("ev_local_regime", """SELECT k, slot, CASE kind WHEN 1 THEN 'drift' WHEN 2 THEN 'pre_drift' ELSE 'post_drift' END AS regime, event_id FROM (SELECT *, row_number() OVER (PARTITION BY k, slot ORDER BY kind, drift_start, event_id) AS r FROM (
 SELECT s.k, slot, event_id, drift_start, CASE WHEN slot >= drift_start AND slot < drift_end THEN 1 WHEN slot < drift_start THEN 2 ELSE 3 END AS kind FROM s JOIN owin ON slot >= pre_start AND slot < post_end)) WHERE r = 1""")
def ev_local_regime(spark, sf_dir):
    return regimes.local_regimes(C.stream(spark, sf_dir), C.overlapping(spark, sf_dir)).select("k", "slot", "regime", "event_id")


# Alarms.


@query("agg_false_alarms", "SELECT k, a AS alarms, round(a / n * 10000, 6) AS per_10k, round(a / n * 17520, 6) AS per_year FROM (SELECT k, count(*)::DOUBLE AS n FROM s GROUP BY k) JOIN (SELECT k, count(*) AS a FROM alarm GROUP BY k) USING (k)")
def agg_false_alarms(spark, sf_dir):
    n = C.ev30(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"))
    a = C.alarms(spark, sf_dir).groupBy("k").agg(F.count("*").alias("alarms"))
    share = F.col("alarms") / F.col("n")
    return n.join(a, "k").select("k", "alarms", r(share * 10000).alias("per_10k"), r(share * 17520).alias("per_year"))


_GAP = "(SELECT k, (us - lag(us) OVER (PARTITION BY k ORDER BY us)) / 1800000000.0 AS gap FROM alarm)"


@query("agg_gap_stats", f"SELECT k, count(gap) AS n, round(avg(gap), 6) AS gap_mean, round(CASE WHEN count(gap) >= 2 THEN stddev_pop(gap) / nullif(avg(gap), 0) END, 6) AS gap_cv, round(avg((gap >= 10 AND gap < 30)::INT), 6) AS gap_share FROM {_GAP} GROUP BY k")
def agg_gap_stats(spark, sf_dir):
    rows = C.alarms(spark, sf_dir).withColumn("h", F.col("us") / 1_800_000_000.0)
    rows = rows.withColumn("g", (F.col("us") - F.lag("us").over(Window.partitionBy("k").orderBy("us"))) / F.lit(1_800_000_000.0))
    cv = F.when(F.count("g") >= 2, F.stddev_pop("g") / F.nullif(F.avg("g"), F.lit(0.0)))
    share = F.avg(F.when(F.col("g").isNotNull(), ((F.col("g") >= 10) & (F.col("g") < 30)).cast("double")))
    return rows.groupBy("k").agg(F.count("g").alias("n"), r(F.avg("g")).alias("gap_mean"), r(cv).alias("gap_cv"), r(share).alias("gap_share"))


@query("agg_rayleigh", "SELECT k, n, round(CASE WHEN n >= 3 THEN sqrt(c * c + q * q) END, 6) AS r, round(CASE WHEN n >= 3 THEN least(1, greatest(0, exp(sqrt(1 + 4 * n + 4 * n * n * (1 - (c * c + q * q))) - (1 + 2 * n)))) END, 6) AS p FROM (SELECT k, count(*) AS n, avg(cos(2 * pi() * (us % 604800000000) / 604800000000)) AS c, avg(sin(2 * pi() * (us % 604800000000) / 604800000000)) AS q FROM alarm GROUP BY k)")
def agg_rayleigh(spark, sf_dir):
    out = metrics.rayleigh(C.alarms(spark, sf_dir), "k", "us", 604_800_000_000)
    return out.select("k", "n", r("r").alias("r"), r("p").alias("p"))


@query("agg_chance", f"SELECT round(sum(1 - pow(1 - least(1, (match_end - drift_start) / {30.0 * S.DAY}), 20)), 6) AS expected FROM win")
def agg_chance(spark, sf_dir):
    length = F.col("match_end") - F.col("drift_start")
    return metrics.chance_matches(C.windows(spark), length, 30.0 * S.DAY, 20).select(r("expected").alias("expected"))


@query("agg_percentile_rank", "SELECT k, round(avg((abs(y - p) <= 20)::INT), 6) AS share FROM fc GROUP BY k")
def agg_percentile_rank(spark, sf_dir):
    return C.forecasts(spark, sf_dir).groupBy("k").agg(r(F.avg((metrics.error() <= 20).cast("double"))).alias("share"))


@query("agg_quantile", "SELECT k, round(quantile_cont(abs(y - p), 0.99), 6) AS q FROM fc GROUP BY k")
def agg_quantile(spark, sf_dir):
    errors = C.forecasts(spark, sf_dir).select("k", metrics.error().alias("v"))
    return selection.quantiles(errors, 0.99).select("k", r("q").alias("q"))


@query("agg_nan_mean_max", f"SELECT k, round(avg(rolling), 6) AS mean, round(max(rolling), 6) AS worst, count(rolling) AS n FROM ({_roll('abs(y - p)', 'fc', 336)}) GROUP BY k")
def agg_nan_mean_max(spark, sf_dir):
    rows = C.forecasts(spark, sf_dir).withColumn("rolling", windows.rolling_mean(metrics.error(), 336))
    return rows.groupBy("k").agg(r(F.avg("rolling")).alias("mean"), r(F.max("rolling")).alias("worst"), F.count("rolling").alias("n"))


@query("agg_adapt_gain", "SELECT model, region, seed, yr, arm, round(a.mae - b.mae, 4) AS gain, round((a.mae - b.mae) / nullif(a.n_retrains, 0), 4) AS per_retrain FROM runs a LEFT JOIN (SELECT model, region, seed, yr, mae FROM runs WHERE arm = 'A') b USING (model, region, seed, yr)")
def agg_adapt_gain(spark, sf_dir):
    out = metrics.paired_gain(C.runs(spark, sf_dir), ["model", "region", "seed", "yr"], "arm", "A", "mae", "n_retrains")
    return out.select("model", "region", "seed", "yr", "arm", r("gain", 4).alias("gain"), r("gain_per_retrain", 4).alias("per_retrain"))


@query("agg_first", "SELECT model, arm, region, arg_min(train_samples, (yr * 10 + seed)) AS train_samples FROM runs GROUP BY ALL")
def agg_first(spark, sf_dir):
    return C.runs(spark, sf_dir).groupBy("model", "arm", "region").agg(F.min_by("train_samples", F.struct("yr", "seed")).alias("train_samples"))


@query("agg_mean_std", "SELECT model, arm, region, round(avg(mae), 4) AS mean, round(stddev_samp(mae), 4) AS sd, count(DISTINCT seed) AS seeds FROM runs GROUP BY ALL")
def agg_mean_std(spark, sf_dir):
    return C.runs(spark, sf_dir).groupBy("model", "arm", "region").agg(r(F.avg("mae"), 4).alias("mean"), r(F.stddev_samp("mae"), 4).alias("sd"), F.count_distinct("seed").alias("seeds"))


@query("agg_seed_band", "SELECT model, arm, yr, round(avg(mae), 4) AS mean, round(stddev_samp(mae), 4) AS sd FROM runs WHERE region = 'north' GROUP BY ALL")
def agg_seed_band(spark, sf_dir):
    return C.runs(spark, sf_dir).filter("region = 'north'").groupBy("model", "arm", "yr").agg(r(F.avg("mae"), 4).alias("mean"), r(F.stddev_samp("mae"), 4).alias("sd"))


@query("agg_seed_mean_curve", "SELECT model, yr, round(avg(mae), 4) AS mean FROM runs GROUP BY ALL")
def agg_seed_mean_curve(spark, sf_dir):
    return C.runs(spark, sf_dir).groupBy("model", "yr").agg(r(F.avg("mae"), 4).alias("mean"))


# Intervals and escalation.


@query("uq_scores", "SELECT k, pos, round(score, 6) AS score FROM cal")
def uq_scores(spark, sf_dir):
    return C.calibration(spark, sf_dir).select("k", "pos", r("score").alias("score"))


@query("uq_rank", "SELECT k, n, rank FROM rad")
def uq_rank(spark, sf_dir):
    return C.radii(spark, sf_dir).select("k", "n", "rank")


@query("uq_radius", "SELECT k, round(radius, 6) AS radius FROM rad")
def uq_radius(spark, sf_dir):
    return selection.radii(C.calibration(spark, sf_dir), 0.1).select("k", r("radius").alias("radius"))


@query("uq_fixed", "SELECT k, slot, lower, upper FROM iv")
def uq_fixed(spark, sf_dir):
    return C.intervals(spark, sf_dir).select("k", "slot", "lower", "upper")


@query("uq_escalate_flag", "SELECT k, slot, score > 150 AS escalate FROM scored")
def uq_escalate_flag(spark, sf_dir):
    return C.scored(spark, sf_dir).select("k", "slot", (F.col("score") > 150).alias("escalate"))


@query("es_widths", "SELECT k, slot, round(upper - lower, 6) AS width FROM iv")
def es_widths(spark, sf_dir):
    return C.intervals(spark, sf_dir).select("k", "slot", escalation.width_score().alias("width"))


@query("es_scores", "SELECT k, slot, score FROM scored")
def es_scores(spark, sf_dir):
    return C.scored(spark, sf_dir).select("k", "slot", "score")


@query("es_signals", "SELECT k, slot, round(upper - lower, 6) AS width, round(CASE WHEN n1 = 1 THEN m1 END, 6) AS nonconf_1, round(CASE WHEN n48 = 48 THEN m48 END, 6) AS nonconf_48 FROM iv JOIN (SELECT k, slot, count(*) OVER a AS n1, avg(abs(y - p)) OVER a AS m1, count(*) OVER b AS n48, avg(abs(y - p)) OVER b AS m48 FROM fc WHERE split <> 'train' WINDOW a AS (PARTITION BY k ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY k ORDER BY pos ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)) USING (k, slot)")
def es_signals(spark, sf_dir):
    rows = C.forecasts(spark, sf_dir).filter("split <> 'train'")
    signals = rows.select("k", "slot", *(r(windows.previous_mean(metrics.error(), n)).alias(f"nonconf_{n}") for n in (1, 48)))
    return C.intervals(spark, sf_dir).select("k", "slot", escalation.width_score().alias("width")).join(signals, ["k", "slot"])


@query("es_review_rate", "SELECT k, round(avg((score > 150)::INT), 6) AS rate FROM scored GROUP BY k")
def es_review_rate(spark, sf_dir):
    return C.scored(spark, sf_dir).groupBy("k").agg(r(F.avg((F.col("score") > 150).cast("double"))).alias("rate"))


@query("es_retained_cov", "SELECT k, round(avg(hit::INT) FILTER (WHERE score <= 150), 6) AS coverage FROM scored GROUP BY k")
def es_retained_cov(spark, sf_dir):
    return C.scored(spark, sf_dir).groupBy("k").agg(r(F.avg(F.when(F.col("score") <= 150, F.col("hit").cast("double")))).alias("coverage"))


_CURVE = """cu AS (SELECT k, threshold, n, kept, 1 - kept / n::DOUBLE AS review_rate, h / nullif(kept, 0)::DOUBLE AS retained_coverage FROM (
 SELECT k, score AS threshold, sum(c) OVER w AS kept, sum(h0) OVER w AS h FROM (SELECT k, score, count(*) AS c, sum(hit::INT) AS h0 FROM scored GROUP BY ALL) WINDOW w AS (PARTITION BY k ORDER BY score)
 UNION ALL SELECT DISTINCT k, '-inf'::DOUBLE, 0, 0 FROM scored) JOIN (SELECT k, count(*) AS n FROM scored GROUP BY k) USING (k))"""


@query("es_curve", f", {_CURVE} SELECT k, threshold, n, kept::BIGINT AS kept, round(review_rate, 6) AS review_rate, round(retained_coverage, 6) AS retained_coverage FROM cu")
def es_curve(spark, sf_dir):
    return C.curve(spark, sf_dir).withColumns({c: r(c) for c in ("review_rate", "retained_coverage")})


@query("es_curve_regime", """SELECT g.k, g.regime, g.threshold, any_value(g.n) AS n, count(s.score) AS kept, round(1 - count(s.score) / any_value(g.n)::DOUBLE, 6) AS review_rate, round(avg(s.hit::INT), 6) AS retained_coverage FROM (
 SELECT * FROM (SELECT k, regime, count(*) AS n FROM scored GROUP BY ALL) JOIN (SELECT DISTINCT k, score AS threshold FROM scored UNION SELECT k, '-inf'::DOUBLE FROM scored) USING (k)) g
 LEFT JOIN scored s ON s.k = g.k AND s.regime = g.regime AND s.score <= g.threshold GROUP BY g.k, g.regime, g.threshold""")
def es_curve_regime(spark, sf_dir):
    out = escalation.curve_by_group(C.scored(spark, sf_dir), "regime")
    return out.withColumns({c: r(c) for c in ("review_rate", "retained_coverage")})


@query("es_rate_for_cov", f", {_CURVE} SELECT k, round(min(review_rate) FILTER (WHERE retained_coverage >= 0.9 AND kept >= 48), 6) AS rate FROM cu GROUP BY k")
def es_rate_for_cov(spark, sf_dir):
    return C.curve(spark, sf_dir).groupBy("k").agg(r(escalation.rate_for_coverage(0.9, 48)).alias("rate"))


@query("top_min_rate", f", {_CURVE} SELECT k, round(min(review_rate) FILTER (WHERE retained_coverage >= 0.95 AND kept >= 10), 6) AS rate FROM cu GROUP BY k")
def top_min_rate(spark, sf_dir):
    return C.curve(spark, sf_dir).groupBy("k").agg(r(escalation.rate_for_coverage(0.95, 10)).alias("rate"))


_BUDGET = "(SELECT k, retained_coverage, row_number() OVER (PARTITION BY k ORDER BY review_rate DESC, threshold) AS r FROM cu WHERE review_rate <= {b})"


@query("es_cov_at_budget", f", {_CURVE} SELECT k, round(retained_coverage, 6) AS coverage FROM {_BUDGET.format(b=0.2)} WHERE r = 1")
def es_cov_at_budget(spark, sf_dir):
    return C.curve(spark, sf_dir).groupBy("k").agg(r(escalation.coverage_at_budget(0.2)).alias("coverage"))


@query("top_max_by", f", {_CURVE} SELECT k, round(retained_coverage, 6) AS coverage FROM {_BUDGET.format(b=0.5)} WHERE r = 1")
def top_max_by(spark, sf_dir):
    return C.curve(spark, sf_dir).groupBy("k").agg(r(escalation.coverage_at_budget(0.5)).alias("coverage"))


@query("es_points", f", {_CURVE} SELECT c.k, round(min(review_rate) FILTER (WHERE c.retained_coverage >= 0.9 AND kept >= 48), 6) AS rate_for_90, round(min(review_rate) FILTER (WHERE c.retained_coverage >= 0.95 AND kept >= 48), 6) AS rate_for_95, " + ", ".join(f"round(any_value(b{n}.retained_coverage), 6) AS coverage_at_{n}" for n in (5, 10, 20)) + ", count(DISTINCT review_rate) AS n_rates FROM cu c " + " ".join(f"LEFT JOIN (SELECT k, retained_coverage FROM {_BUDGET.format(b=n / 100)} WHERE r = 1) b{n} ON b{n}.k = c.k" for n in (5, 10, 20)) + " GROUP BY c.k")
def es_points(spark, sf_dir):
    out = escalation.operating_points(C.curve(spark, sf_dir))
    return out.withColumns({c: r(c) for c in out.columns if c.startswith(("rate", "coverage"))})


@query("es_sweep", f", {_CURVE} SELECT k, metric_name, round(metric_value, 6) AS metric_value FROM (SELECT k, min(review_rate) FILTER (WHERE retained_coverage >= 0.9) AS rate_90, count(*)::DOUBLE AS steps FROM cu GROUP BY k) UNPIVOT (metric_value FOR metric_name IN (rate_90, steps))")
def es_sweep(spark, sf_dir):
    wide = C.curve(spark, sf_dir).groupBy("k").agg(escalation.rate_for_coverage(0.9).alias("rate_90"), F.count("*").cast("double").alias("steps"))
    return wide.unpivot("k", ["rate_90", "steps"], "metric_name", "metric_value").filter("metric_value IS NOT NULL").withColumn("metric_value", r("metric_value"))


@query("es_cov_grid", f", {_CURVE} SELECT g.k, g.rate, round(arg_max(retained_coverage, review_rate), 6) AS coverage FROM (SELECT k, i / 20.0::DOUBLE AS rate FROM (SELECT DISTINCT k FROM scored), (SELECT unnest(range(21)) AS i)) g JOIN cu ON cu.k = g.k AND review_rate <= g.rate + 1e-12 WHERE kept >= 48 GROUP BY g.k, g.rate")
def es_cov_grid(spark, sf_dir):
    """The curve read as of a grid of review rates: union, then the last curve row carried forward."""
    cu = C.curve(spark, sf_dir).filter("kept >= 48").groupBy("k", "review_rate").agg(F.max("retained_coverage").alias("c"))
    grid = C.scored(spark, sf_dir).select("k").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20)))).select("k", (F.col("i") / 20.0).alias("rate"))
    both = cu.select("k", F.col("review_rate").alias("at"), "c", F.lit(None).cast("double").alias("rate")).unionByName(grid.select("k", (F.col("rate") + 1e-12).alias("at"), F.lit(None).cast("double").alias("c"), "rate"))
    w = Window.partitionBy("k").orderBy("at", F.col("rate").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("coverage", F.last("c", ignorenulls=True).over(w)).filter("rate IS NOT NULL AND coverage IS NOT NULL").select("k", "rate", r("coverage").alias("coverage"))
