"""Queries on sources, cleaning, grids, joins, filters, sets and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import clean, ledger, profile, selection, windows
from tidemark.plans import streams as C
from tidemark.plans.registry import query
from tidemark.sources import series as S
from tidemark.sources.shared import shared_folder, written


def r(column, places: int = 6):
    return S.rounded(column, places)


@query("src_csv_dir", "SELECT k, ts, value FROM ev WHERE value IS NOT NULL")
def src_csv_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "csv")
    rows = C.raw(spark, sf_dir).filter("value IS NOT NULL")
    out = rows.select(F.col("k").alias("REGION"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("SETTLEMENTDATE"), F.col("value").alias("TOTALDEMAND"), F.lit(0.0).alias("RRP"), F.lit("TRADE").alias("PERIODTYPE"))
    out.write.option("header", True).csv(folder)
    return S.read_csv_folder(spark, folder).select(F.col("REGION").alias("k"), F.col("SETTLEMENTDATE").alias("ts"), F.col("TOTALDEMAND").alias("value"))


@query("src_load_split", "SELECT split, k, count(*) AS n, round(sum(y), 3) AS total FROM s GROUP BY ALL")
def src_load_split(spark, sf_dir):
    return C.stream(spark, sf_dir).groupBy("split", "k").agg(F.count("*").alias("n"), r(F.sum("y"), 3).alias("total"))


@query("src_events", "SELECT event_id, start_date, end_date, date_precision, region, tier FROM cat WHERE region IN ('all', 'click')")
def src_events(spark, sf_dir):
    return C.catalogue(spark).filter(F.col("region").isin("all", "click"))


@query("src_synthetic", """SELECT kind, t, round(20 + 5 * sin(2 * pi() * t / 48) + CASE kind WHEN 'none' THEN 0 WHEN 'sudden' THEN CASE WHEN t >= 1000 THEN 8 ELSE 0 END
 WHEN 'gradual' THEN 8 * least(1, greatest(0, (t - 1000) / 1000.0)) ELSE CASE WHEN t >= 1333 AND t < 2666 THEN 8 ELSE 0 END END, 6) AS y
 FROM (SELECT unnest(range(4000)) AS t), (VALUES ('none'), ('sudden'), ('gradual'), ('recurring')) v(kind)""")
def src_synthetic(spark, sf_dir):
    out = None
    for kind in ("none", "sudden", "gradual", "recurring"):
        rows = S.synthetic(spark, kind, 4000)[0].select(F.lit(kind).alias("kind"), "t", r("y").alias("y"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("src_calibration", "SELECT model, region, seed, max(yr) AS yr, arg_max(mae, yr) AS mae FROM runs WHERE arm = 'A' GROUP BY ALL")
def src_calibration(spark, sf_dir):
    rows = C.runs(spark, sf_dir).filter("arm = 'A'")
    return ledger.last_run(rows, ["model", "region", "seed"], ["yr"]).select("model", "region", "seed", "yr", "mae")


def _appended(spark: SparkSession, sf_dir: str, tag: str, rows: DataFrame) -> DataFrame:
    """Rows written in two appends and read back."""
    folder = shared_folder(spark, tag)
    for year_part in (F.col("yr") % 2 == 0, F.col("yr") % 2 == 1):
        rows.filter(year_part).write.mode("append").partitionBy("region").parquet(folder)
    return spark.read.parquet(folder).select(*rows.columns)


@query("snk_ledger", "SELECT method, region, seed, yr, metric_name, metric_value FROM ledger WHERE region = 'north'")
def snk_ledger(spark, sf_dir):
    rows = C.ledger(spark, sf_dir).select("method", "region", "seed", "yr", "metric_name", "metric_value")
    return _appended(spark, sf_dir, "ledger", rows).filter("region = 'north'")


@query("snk_curve", "SELECT k, slot, round(CASE WHEN n = 48 THEN m END, 6) AS rolling FROM (SELECT k, slot, count(*) OVER w AS n, avg(abs(y - p)) OVER w AS m FROM fc WINDOW w AS (PARTITION BY k ORDER BY pos ROWS 47 PRECEDING))")
def snk_curve(spark, sf_dir):
    rows = C.forecasts(spark, sf_dir).select("k", "slot", r(windows.rolling_mean(F.abs(F.col("y") - F.col("p")), 48)).alias("rolling"))
    return written(rows, "curve")[0]


@query("snk_forecast_curve", "SELECT k, slot, y, p FROM fc")
def snk_forecast_curve(spark, sf_dir):
    return written(C.forecasts(spark, sf_dir).select("k", "slot", "y", "p"), "forecast")[0]


@query("snk_detections", "SELECT k, us FROM alarm")
def snk_detections(spark, sf_dir):
    return written(C.alarms(spark, sf_dir), "detections")[0]


@query("snk_config", "SELECT DISTINCT method, substr(sha1(method), 1, 12) AS config_hash FROM ledger")
def snk_config(spark, sf_dir):
    rows = C.ledger(spark, sf_dir).select("method", F.substring(F.sha1("method"), 1, 12).alias("config_hash")).distinct()
    folder = shared_folder(spark, "config")
    rows.write.parquet(folder)
    rows.write.mode("ignore").parquet(folder)
    return spark.read.parquet(folder)


@query("snk_paths", "SELECT DISTINCT 'curves/' || method || '_' || region || '_seed' || CASE WHEN seed = 7 THEN 'none' ELSE seed::VARCHAR END AS path FROM ledger")
def snk_paths(spark, sf_dir):
    seed = F.when(F.col("seed") != 7, F.col("seed"))
    return C.ledger(spark, sf_dir).select(ledger.run_path("curves", F.col("method"), F.col("region"), seed).alias("path")).distinct()


@query("flt_region", "SELECT event_id, tier FROM cat WHERE region IN ('all', 'view')")
def flt_region(spark, sf_dir):
    return C.catalogue(spark).filter(F.col("region").isin("all", "view")).select("event_id", "tier")


@query("flt_split", "SELECT k, slot, split FROM s WHERE split = 'calibration'")
def flt_split(spark, sf_dir):
    return C.stream(spark, sf_dir).filter("split = 'calibration'").select("k", "slot", "split")


@query("flt_holdout", f"SELECT k, CASE WHEN slot < {S.stamp('2024-01-16')} THEN 'fit' ELSE 'validation' END AS part, count(*) AS n FROM s WHERE split = 'train' GROUP BY ALL")
def flt_holdout(spark, sf_dir):
    part = F.when(F.col("slot") < S.stamp("2024-01-16"), "fit").otherwise("validation")
    return C.stream(spark, sf_dir).filter("split = 'train'").groupBy("k", part.alias("part")).agg(F.count("*").alias("n"))


@query("flt_test_alarms", f"SELECT k, us FROM alarm WHERE us >= {S.stamp('2024-01-24')}")
def flt_test_alarms(spark, sf_dir):
    return C.alarms(spark, sf_dir).filter(F.col("us") >= S.stamp("2024-01-24"))


@query("flt_overlap", "SELECT event_id, drift_start, drift_end FROM owin")
def flt_overlap(spark, sf_dir):
    return C.overlapping(spark, sf_dir).select("event_id", "drift_start", "drift_end")


@query("flt_finite_mask", "SELECT k, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE isfinite(score)) AS finite FROM scored GROUP BY k")
def flt_finite_mask(spark, sf_dir):
    finite = (F.abs("score") < float("inf")) & ~F.isnan("score")
    return C.scored(spark, sf_dir).groupBy("k").agg(F.count_if("hit").alias("hits"), F.count_if(finite).alias("finite"))


@query("flt_ui", "SELECT column_name, n FROM (SELECT 'model' AS column_name, count(DISTINCT model) AS n FROM runs UNION ALL SELECT 'arm', count(DISTINCT arm) FROM runs UNION ALL SELECT 'region', count(DISTINCT region) FROM runs) WHERE n BETWEEN 2 AND 30")
def flt_ui(spark, sf_dir):
    rows = C.runs(spark, sf_dir).select("model", "arm", "region").unpivot([], ["model", "arm", "region"], "column_name", "v")
    numeric = F.avg(F.col("v").rlike(r"^\s*[-+]?\d").cast("double")) < 0.5
    stats = rows.groupBy("column_name").agg(F.count_distinct("v").alias("n"), numeric.alias("words"), F.max(F.col("v").contains("±")).alias("pm"))
    return stats.filter("n BETWEEN 2 AND 30 AND words AND NOT pm").select("column_name", "n")


@query("prj_demand_series", "SELECT ts, value FROM ev WHERE k = 'view' AND value IS NOT NULL")
def prj_demand_series(spark, sf_dir):
    return C.raw(spark, sf_dir).filter("k = 'view' AND value IS NOT NULL").select("ts", "value").orderBy("ts")


@query("prj_zscore", "SELECT k, slot, round((y - m) / nullif(sd, 0), 6) AS z FROM s JOIN st USING (k)")
def prj_zscore(spark, sf_dir):
    rows = C.stream(spark, sf_dir)
    stats = rows.filter("split = 'train'").groupBy("k").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"))
    return rows.join(stats, "k").select("k", "slot", r((F.col("y") - F.col("m")) / F.nullif("sd", F.lit(0.0))).alias("z"))


@query("prj_residual", "SELECT k, slot, round(y - p, 6) AS residual FROM fc WHERE split = 'calibration'")
def prj_residual(spark, sf_dir):
    return C.forecasts(spark, sf_dir).filter("split = 'calibration'").select("k", "slot", r(F.col("y") - F.col("p")).alias("residual"))


@query("prj_split_method", "SELECT DISTINCT method, split_part(method, '/', 1) AS model, split_part(method, '/', 2) AS arm, split_part(method, '/', 3) AS uq FROM ledger")
def prj_split_method(spark, sf_dir):
    return C.ledger(spark, sf_dir).select("method").distinct().select("method", *ledger.split_method())


@query("prj_regime_spelling", "SELECT replace(regime, '_', '-') AS regime, count(*) AS n FROM lab GROUP BY 1")
def prj_regime_spelling(spark, sf_dir):
    return C.labelled(spark, sf_dir).groupBy(F.replace("regime", F.lit("_"), F.lit("-")).alias("regime")).agg(F.count("*").alias("n"))


@query("val_columns", "SELECT 'missing_one' AS missing")
def val_columns(spark, sf_dir):
    try:
        clean.require(C.catalogue(spark), ["event_id", "missing_one"])
    except ValueError as e:
        return spark.range(1).select(F.lit(str(e).split("'")[1]).alias("missing"))
    raise AssertionError("the check did not fail")


@query("val_changepoints", "SELECT count(*) AS bad FROM s WHERE pos < 0 OR pos > 1440")
def val_changepoints(spark, sf_dir):
    return C.stream(spark, sf_dir).agg(F.count_if((F.col("pos") < 0) | (F.col("pos") > 1440)).alias("bad"))


@query("val_intervals", "SELECT count(*) FILTER (WHERE lower > upper OR y IS NULL OR isnan(lower) OR isnan(upper)) AS bad, count(*) AS n FROM iv")
def val_intervals(spark, sf_dir):
    bad = (F.col("lower") > F.col("upper")) | F.col("y").isNull() | F.isnan("lower") | F.isnan("upper")
    return C.intervals(spark, sf_dir).agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"))


@query("val_labels", "SELECT count(*) AS bad FROM lab WHERE regime NOT IN ('pre_drift', 'drift', 'post_drift')")
def val_labels(spark, sf_dir):
    known = spark.createDataFrame([("pre_drift",), ("drift",), ("post_drift",)], "regime string")
    return C.labelled(spark, sf_dir).join(known, "regime", "left_anti").agg(F.count("*").alias("bad"))


@query("val_tier", "SELECT count(*) AS bad FROM cat WHERE tier NOT IN (1, 2) OR tier IS NULL")
def val_tier(spark, sf_dir):
    return C.catalogue(spark).agg(F.count_if(~F.col("tier").isin(1, 2) | F.col("tier").isNull()).alias("bad"))


@query("val_series", "SELECT k, count(*) AS n, count(*) - count(y) AS missing FROM s GROUP BY k")
def val_series(spark, sf_dir):
    return C.stream(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"), (F.count("*") - F.count("y")).alias("missing"))


def _dirty(spark, sf_dir):
    """Readings as text, some broken, with arrival order; every 50th row comes twice, every 70th conflicts."""
    rows = C.raw(spark, sf_dir).select(F.col("event_id").alias("arrival"), "k", F.when(F.col("event_id") % 97 == 0, "bad").otherwise(F.col("ts").cast("string")).alias("ts"), F.when(F.col("event_id") % 31 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    again = rows.filter("arrival % 50 = 0")
    other = rows.filter("arrival % 70 = 1").withColumns({"arrival": F.col("arrival") + 1_000_000, "value": F.lit("1.5")})
    return rows.unionByName(again).unionByName(other)


_DIRTY = """d0 AS (SELECT event_id AS arrival, k, CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN event_id % 31 = 0 THEN NULL ELSE value END AS value FROM ev),
dirty AS (SELECT * FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE arrival % 50 = 0 UNION ALL SELECT arrival + 1000000, k, ts, 1.5 FROM d0 WHERE arrival % 70 = 1) WHERE ts IS NOT NULL)"""


def _with(sql: str) -> str:
    return f", {_DIRTY} {sql}"


@query("cln_coerce", _with("SELECT k, count(*) AS n, count(value) AS known FROM dirty GROUP BY k"))
def cln_coerce(spark, sf_dir):
    return clean.coerced(_dirty(spark, sf_dir), ["value"], ["ts"]).groupBy("k").agg(F.count("*").alias("n"), F.count("value").alias("known"))


@query("cln_pipeline", _with("SELECT k, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY k, ts ORDER BY arrival) AS r FROM (SELECT DISTINCT * FROM dirty)) WHERE r = 1"))
def cln_pipeline(spark, sf_dir):
    return clean.clean(_dirty(spark, sf_dir), "k", "ts", "value", "arrival").select("k", "ts", "value")


@query("cln_out_of_order", "SELECT k, count(*) FILTER (WHERE ts < before) AS out_of_order FROM (SELECT k, ts, lag(ts) OVER (PARTITION BY k ORDER BY event_id) AS before FROM ev) GROUP BY k")
def cln_out_of_order(spark, sf_dir):
    return clean.out_of_order(C.raw(spark, sf_dir), "k", "ts", "event_id")


@query("cln_dedup_exact", _with("SELECT count(*) AS n FROM (SELECT DISTINCT * FROM dirty)"))
def cln_dedup_exact(spark, sf_dir):
    return clean.coerced(_dirty(spark, sf_dir), ["value"], ["ts"]).dropDuplicates().agg(F.count("*").alias("n"))


@query("cln_conflicts", _with("SELECT k, count(*) AS n FROM (SELECT k, count(*) OVER (PARTITION BY k, ts) AS c FROM (SELECT DISTINCT * FROM dirty)) WHERE c > 1 GROUP BY k"))
def cln_conflicts(spark, sf_dir):
    rows = clean.coerced(_dirty(spark, sf_dir), ["value"], ["ts"]).dropDuplicates()
    return clean.conflicts(rows, ["k", "ts"]).groupBy("k").agg(F.count("*").alias("n"))


@query("cln_keep_first", _with("SELECT k, ts, min(arrival) AS arrival FROM dirty GROUP BY ALL"))
def cln_keep_first(spark, sf_dir):
    return clean.keep_first(clean.coerced(_dirty(spark, sf_dir), ["value"], ["ts"]), ["k", "ts"], "arrival").select("k", "ts", "arrival")


_CADENCE = "SELECT k, us, step FROM (SELECT k, us, us - lag(us) OVER (PARTITION BY k ORDER BY us) AS step FROM (SELECT DISTINCT k, slot AS us FROM s)) WHERE step <> 1800000000"


@query("cln_cadence", _CADENCE)
def cln_cadence(spark, sf_dir):
    return clean.cadence(C.ev30(spark, sf_dir).withColumn("ts", S.at("slot")), "k", "ts", S.HALF_HOUR)


@query("gap_sampling", f"SELECT k, count(*) AS gaps FROM ({_CADENCE}) GROUP BY k")
def gap_sampling(spark, sf_dir):
    return cln_cadence(spark, sf_dir).groupBy("k").agg(F.count("*").alias("gaps"))


@query("lim_examples", f"SELECT k, us FROM ({_CADENCE}) ORDER BY us, k LIMIT 10")
def lim_examples(spark, sf_dir):
    return cln_cadence(spark, sf_dir).orderBy("us", "k").limit(10).select("k", "us")


@query("cln_audit_table", """SELECT k, "check", n FROM (SELECT k, count(*) AS rows, count(DISTINCT ts) AS distinct_times, count(*) FILTER (WHERE value IS NULL) AS null_values,
 count(*) FILTER (WHERE value < 0) AS negative_values, count(*) FILTER (WHERE ts IS NULL) AS null_times, count(*) FILTER (WHERE ts < before) AS out_of_order,
 count(*) FILTER (WHERE first = 1 AND step <> 1800000000) AS irregular_steps, count(*) FILTER (WHERE c > 1) AS conflicting_rows FROM (
 SELECT *, us - lag(us) OVER (PARTITION BY k ORDER BY us, event_id) AS step FROM (SELECT *, lag(ts) OVER (PARTITION BY k ORDER BY event_id) AS before, count(*) OVER (PARTITION BY k, ts) AS c, row_number() OVER (PARTITION BY k, ts ORDER BY event_id) AS first FROM ev)) GROUP BY k)
 UNPIVOT (n FOR "check" IN (rows, distinct_times, null_values, negative_values, null_times, out_of_order, irregular_steps, conflicting_rows))""")
def cln_audit_table(spark, sf_dir):
    return clean.audit(C.raw(spark, sf_dir), "k", "ts", "value", "event_id", S.HALF_HOUR)


@query("cln_split_table", "SELECT split, count(*) FILTER (WHERE k = 'click') AS click, count(*) FILTER (WHERE k = 'error') AS error, count(*) FILTER (WHERE k = 'view') AS view FROM s WHERE k IN ('click', 'error', 'view') GROUP BY split")
def cln_split_table(spark, sf_dir):
    rows = C.stream(spark, sf_dir).filter(F.col("k").isin("click", "error", "view"))
    return rows.groupBy("split").pivot("k", ["click", "error", "view"]).count().fillna(0)


@query("rsm_30min_right", """SELECT k, slot, y FROM (SELECT k, unnest(generate_series(min(slot), max(slot), 1800000000)) AS slot FROM ev30 GROUP BY k) LEFT JOIN ev30 USING (k, slot)""")
def rsm_30min_right(spark, sf_dir):
    return S.with_gaps(C.ev30(spark, sf_dir)).select("k", "slot", "y")


@query("rsm_daily_complete", "SELECT k, date_trunc('day', make_timestamp(slot))::DATE AS day, round(avg(y), 6) AS y FROM ev30 GROUP BY ALL HAVING count(*) >= 40")
def rsm_daily_complete(spark, sf_dir):
    days = C.ev30(spark, sf_dir).groupBy("k", F.to_date(S.at("slot")).alias("day")).agg(r(F.avg("y")).alias("y"), F.count("y").alias("n"))
    return days.filter("n >= 40").drop("n")


@query("rsm_daily_mean", "SELECT l_returnflag AS k, l_shipdate::DATE AS day, round(avg(l_quantity), 6) AS y FROM lineitem GROUP BY ALL")
def rsm_daily_mean(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("k"), F.to_date("l_shipdate").alias("day")).agg(r(F.avg("l_quantity")).alias("y"))


@query("rsm_daily_display", "SELECT k, make_timestamp(slot)::DATE AS day, round(quantile_cont(y, 0.5), 6) AS median, min(y) AS low, max(y) AS high FROM ev30 GROUP BY ALL")
def rsm_daily_display(spark, sf_dir):
    return C.ev30(spark, sf_dir).groupBy("k", F.to_date(S.at("slot")).alias("day")).agg(r(F.percentile("y", 0.5)).alias("median"), F.min("y").alias("low"), F.max("y").alias("high"))


# Joins.

_SIDE = "(SELECT model, region, seed, yr, round(width / 2, 4) AS pinball FROM runs WHERE arm = 'A' AND seed <= 5)"


@query("jn_left_pinball", f"SELECT r.model, r.region, r.seed, r.yr, r.arm, mae, pinball FROM runs r LEFT JOIN {_SIDE} p USING (model, region, seed, yr)")
def jn_left_pinball(spark, sf_dir):
    rows = C.runs(spark, sf_dir)
    side = rows.filter("arm = 'A' AND seed <= 5").select("model", "region", "seed", "yr", r(F.col("width") / 2, 4).alias("pinball"))
    return rows.join(side, ["model", "region", "seed", "yr"], "left").select("model", "region", "seed", "yr", "arm", "mae", "pinball")


@query("jn_left_fa_year", "SELECT k, n, rate FROM (SELECT k, count(*) AS n FROM s GROUP BY k) LEFT JOIN (SELECT k, round(count(*) / (30 / 365.0), 6) AS rate FROM alarm GROUP BY k) USING (k)")
def jn_left_fa_year(spark, sf_dir):
    rate = C.alarms(spark, sf_dir).groupBy("k").agg(r(F.count("*") / (30 / 365.0)).alias("rate"))
    return C.ev30(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n")).join(rate, "k", "left")


@query("jn_index_cost", "SELECT model, arm, region, mae, cost FROM (SELECT model, arm, region, round(avg(mae), 4) AS mae FROM runs GROUP BY ALL) LEFT JOIN (SELECT model, arm, region, sum(train_samples)::BIGINT AS cost FROM runs WHERE arm <> 'A' GROUP BY ALL) USING (model, arm, region)")
def jn_index_cost(spark, sf_dir):
    rows, keys = C.runs(spark, sf_dir), ["model", "arm", "region"]
    cost = rows.filter("arm <> 'A'").groupBy(*keys).agg(F.sum("train_samples").alias("cost"))
    return rows.groupBy(*keys).agg(r(F.avg("mae"), 4).alias("mae")).join(cost, keys, "left")


@query("jn_self_baseline", "SELECT a.model, a.region, a.seed, a.yr, a.arm, round(a.mae - b.mae, 4) AS gain FROM runs a LEFT JOIN (SELECT * FROM runs WHERE arm = 'A') b USING (model, region, seed, yr)")
def jn_self_baseline(spark, sf_dir):
    rows, keys = C.runs(spark, sf_dir), ["model", "region", "seed", "yr"]
    base = rows.filter("arm = 'A'").select(*keys, F.col("mae").alias("base"))
    return rows.join(base, keys, "left").select(*keys, "arm", r(F.col("mae") - F.col("base"), 4).alias("gain"))


@query("jn_reindex_labels", "SELECT iv.k, iv.slot, regime FROM iv LEFT JOIN lab USING (k, slot)")
def jn_reindex_labels(spark, sf_dir):
    return C.intervals(spark, sf_dir).select("k", "slot").join(C.labelled(spark, sf_dir).select("k", "slot", "regime"), ["k", "slot"], "left")


@query("jn_profile_lookup", """SELECT k, slot, round(f, 6) AS factor FROM s JOIN (SELECT isodow(make_timestamp(slot)) - 1 AS wd, avg(y) AS f FROM s WHERE split = 'train' GROUP BY 1) ON wd = isodow(make_timestamp(slot)) - 1""")
def jn_profile_lookup(spark, sf_dir):
    rows = C.stream(spark, sf_dir).withColumn("wd", F.weekday(S.at("slot")))
    factors = rows.filter("split = 'train'").groupBy("wd").agg(F.avg("y").alias("f"))
    out = rows.join(factors, "wd", "left")
    return out.select("k", "slot", r(F.when(F.col("f").isNull(), F.raise_error(F.lit("no factor")).cast("double")).otherwise(F.col("f"))).alias("factor"))


@query("jn_lag_lookup", "SELECT a.k, a.slot, a.y, b.y AS y_1, c.y AS y_48 FROM s a LEFT JOIN s b ON b.k = a.k AND b.slot = a.slot - 1800000000::BIGINT LEFT JOIN s c ON c.k = a.k AND c.slot = a.slot - 48 * 1800000000::BIGINT")
def jn_lag_lookup(spark, sf_dir):
    grid = C.ev30(spark, sf_dir)
    w = Window.partitionBy("k").orderBy("slot")
    lags = {f"y_{n}": F.lag("y", n).over(w) for n in (1, 48)}
    return S.with_gaps(grid).withColumns(lags).filter("y IS NOT NULL").select("k", "slot", "y", "y_1", "y_48")


@query("jn_anti_history", "SELECT k, slot, y FROM s WHERE split = 'train' OR slot % 3600000000 = 0")
def jn_anti_history(spark, sf_dir):
    rows = C.stream(spark, sf_dir)
    history = rows.filter("split = 'train'")
    new = rows.filter("slot % 3600000000 = 0").join(history, ["k", "slot"], "left_anti")
    return history.select("k", "slot", "y").unionByName(new.select("k", "slot", "y"))


@query("jn_interval_match", "SELECT a.k, a.us, w.event_id FROM alarm a JOIN kwin w ON a.k = w.k AND us >= drift_start AND us < match_end")
def jn_interval_match(spark, sf_dir):
    w = C.key_windows(spark, sf_dir)
    a = C.alarms(spark, sf_dir)
    return a.join(w, (a.k == w.k) & (a.us >= w.drift_start) & (a.us < w.match_end)).select(a.k, a.us, w.event_id)


@query("jn_tolerance_anti", f"SELECT k, us FROM alarm a WHERE k = 'click' AND NOT EXISTS (SELECT 1 FROM alarm b WHERE b.k = 'view' AND abs(a.us - b.us) <= {S.DAY // 8})")
def jn_tolerance_anti(spark, sf_dir):
    """The band is cut into buckets of its width: an equi join on the bucket and its neighbours, not all pairs."""
    band = S.DAY // 8
    rows = C.alarms(spark, sf_dir)
    a = rows.filter("k = 'click'").withColumn("cell", F.expr(f"us div {band}"))
    b = rows.filter("k = 'view'").select(F.col("us").alias("o"), F.explode(F.expr(f"sequence(us div {band} - 1, us div {band} + 1)")).alias("cell"))
    return a.join(b, (a.cell == b.cell) & (F.abs(a.us - b.o) <= band), "left_anti").select("k", "us")


@query("jn_event_overlap", f"SELECT event_id FROM win WHERE drift_start < {S.stamp('2024-01-20')} AND drift_end > {S.stamp('2024-01-10')}")
def jn_event_overlap(spark, sf_dir):
    return C.windows(spark).filter((F.col("drift_start") < S.stamp("2024-01-20")) & (F.col("drift_end") > S.stamp("2024-01-10"))).select("event_id")


@query("jn_detection_day", "SELECT a.k, a.us, e.event_id FROM alarm a JOIN cat e ON make_timestamp(a.us)::DATE = e.start_date")
def jn_detection_day(spark, sf_dir):
    a = C.alarms(spark, sf_dir).withColumn("start_date", F.to_date(S.at("us")))
    return a.join(C.catalogue(spark), "start_date").select("k", "us", "event_id")


@query("jn_semi_arms", "SELECT model, arm, region, seed, yr FROM runs WHERE arm IN ('A', 'C')")
def jn_semi_arms(spark, sf_dir):
    arms = spark.createDataFrame([("A",), ("C",)], "arm string")
    return C.runs(spark, sf_dir).join(arms, "arm", "left_semi").select("model", "arm", "region", "seed", "yr")


# Sets and order.


@query("set_union_all", "SELECT k, slot FROM iv UNION ALL SELECT k, slot FROM s WHERE split = 'calibration'")
def set_union_all(spark, sf_dir):
    return C.intervals(spark, sf_dir).select("k", "slot").unionByName(C.stream(spark, sf_dir).filter("split = 'calibration'").select("k", "slot"))


@query("set_union_splits", "SELECT k, slot, y FROM s")
def set_union_splits(spark, sf_dir):
    rows = C.stream(spark, sf_dir)
    parts = [rows.filter(F.col("split") == x).select("k", "slot", "y") for x in ("train", "calibration", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("set_union_index", "SELECT slot FROM s WHERE k = 'click' UNION SELECT slot FROM s WHERE k = 'view'")
def set_union_index(spark, sf_dir):
    rows = C.ev30(spark, sf_dir)
    return rows.filter("k = 'click'").select("slot").union(rows.filter("k = 'view'").select("slot")).distinct()


@query("set_unique_sorted", "SELECT k, score AS threshold FROM scored UNION SELECT k, '-inf'::DOUBLE FROM scored")
def set_unique_sorted(spark, sf_dir):
    rows = C.scored(spark, sf_dir)
    return rows.select("k", F.col("score").alias("threshold")).union(rows.select("k", F.lit(float("-inf")))).distinct()


@query("set_cross_product", "SELECT d, m, t FROM (VALUES ('up'), ('down'), ('both')) a(d), (VALUES (20), (30)) b(m), (VALUES (50.0), (600.0)) c(t)")
def set_cross_product(spark, sf_dir):
    """A parameter grid: three literal lists."""
    grid = spark.range(1)
    for name, values in (("d", ["up", "down", "both"]), ("m", [20, 30]), ("t", [50.0, 600.0])):
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return grid.drop("id")


@query("srt_tier", "SELECT event_id, row_number() OVER (ORDER BY tier, start_date, event_id) AS place FROM cat")
def srt_tier(spark, sf_dir):
    return C.catalogue(spark).select("event_id", F.row_number().over(Window.orderBy("tier", "start_date", "event_id")).cast("long").alias("place"))


@query("srt_rank_winner", "SELECT model, region, arm FROM (SELECT *, row_number() OVER (PARTITION BY model, region ORDER BY m, w, arm) AS r FROM (SELECT model, region, arm, round(avg(mae), 2) AS m, round(avg(width), 2) AS w FROM runs GROUP BY ALL)) WHERE r = 1")
def srt_rank_winner(spark, sf_dir):
    means = C.runs(spark, sf_dir).groupBy("model", "region", "arm").agg(r(F.avg("mae"), 2).alias("m"), r(F.avg("width"), 2).alias("w"))
    return means.withColumn("r", F.row_number().over(Window.partitionBy("model", "region").orderBy("m", "w", "arm"))).filter("r = 1").select("model", "region", "arm")


@query("srt_arm_order", "SELECT DISTINCT arm, CASE arm WHEN 'B' THEN 1 WHEN 'A' THEN 2 WHEN 'D' THEN 3 ELSE 4 END AS place FROM runs")
def srt_arm_order(spark, sf_dir):
    return C.runs(spark, sf_dir).select("arm").distinct().select("arm", ledger.arm_order(F.col("arm"), ["B", "A", "D"]).cast("int").alias("place"))


@query("top_tail1", "SELECT model, arm, region, seed, yr, mae FROM (SELECT *, row_number() OVER (PARTITION BY model, arm, region, seed ORDER BY yr DESC) AS r FROM runs) WHERE r = 1")
def top_tail1(spark, sf_dir):
    return ledger.last_run(C.runs(spark, sf_dir), ["model", "arm", "region", "seed"], ["yr"]).select("model", "arm", "region", "seed", "yr", "mae")


@query("top_kth_smallest", "SELECT k, score FROM (SELECT k, score, row_number() OVER (PARTITION BY k ORDER BY score) AS r FROM cal) WHERE r = 18")
def top_kth_smallest(spark, sf_dir):
    rows = C.calibration(spark, sf_dir)
    found = selection.kth_smallest(rows, rows.select("k", F.lit(18).cast("long").alias("rank")), value="score")
    return found.select("k", F.col("value").alias("score"))


@query("ddp_drop", "SELECT DISTINCT model, region FROM runs")
def ddp_drop(spark, sf_dir):
    return C.runs(spark, sf_dir).dropDuplicates(["model", "region"]).select("model", "region")


# Reshaping and scalar functions.


@query("rsh_pivot", "SELECT method, region, round(avg(metric_value) FILTER (WHERE metric_name = 'mae'), 4) AS mae, round(avg(metric_value) FILTER (WHERE metric_name = 'width'), 4) AS width FROM ledger GROUP BY ALL")
def rsh_pivot(spark, sf_dir):
    out = ledger.pivoted(C.ledger(spark, sf_dir), ["method", "region"], ["mae", "width"])
    return out.select("method", "region", r("mae", 4).alias("mae"), r("width", 4).alias("width"))


@query("rsh_unstack_first", "SELECT model, region, seed, max(mae) FILTER (WHERE yr = 1996) AS y1996, max(mae) FILTER (WHERE yr = 1997) AS y1997 FROM runs WHERE arm = 'B' GROUP BY ALL")
def rsh_unstack_first(spark, sf_dir):
    out = C.runs(spark, sf_dir).filter("arm = 'B'").groupBy("model", "region", "seed").pivot("yr", [1996, 1997]).agg(F.first("mae"))
    return out.toDF("model", "region", "seed", "y1996", "y1997")


@query("rsh_unstack_nan", "SELECT model, arm, max(mae) FILTER (WHERE region = 'north' AND seed = 1 AND yr = 2001) AS north, max(mae) FILTER (WHERE region = 'west') AS west FROM runs GROUP BY ALL")
def rsh_unstack_nan(spark, sf_dir):
    rows = C.runs(spark, sf_dir).withColumn("c", F.when((F.col("region") == "north") & (F.col("seed") == 1) & (F.col("yr") == 2001), "north"))
    return rows.groupBy("model", "arm").pivot("c", ["north", "west"]).agg(F.max("mae"))


@query("rsh_unpivot", "SELECT method, region, seed, yr, metric_name, metric_value FROM ledger")
def rsh_unpivot(spark, sf_dir):
    return C.ledger(spark, sf_dir).select("method", "region", "seed", "yr", "metric_name", "metric_value")


@query("rsh_category_order", "SELECT DISTINCT regime, CASE regime WHEN 'pre_drift' THEN 0 WHEN 'drift' THEN 1 ELSE 2 END AS place FROM lab")
def rsh_category_order(spark, sf_dir):
    place = F.when(F.col("regime") == "pre_drift", 0).when(F.col("regime") == "drift", 1).otherwise(2)
    return C.labelled(spark, sf_dir).select("regime", place.alias("place")).distinct()


@query("fn_string", "SELECT DISTINCT method, lower(method) AS low, replace(method, '/', '-') AS dashed, substr(method, 1, 3) AS head, starts_with(method, 'A') AS is_a, regexp_extract(method, '([A-Z])/', 1) AS letter FROM ledger")
def fn_string(spark, sf_dir):
    m = F.col("method")
    return C.ledger(spark, sf_dir).select("method").distinct().select("method", F.lower(m).alias("low"), F.replace(m, F.lit("/"), F.lit("-")).alias("dashed"), F.substring(m, 1, 3).alias("head"), m.startswith("A").alias("is_a"), F.regexp_extract(m, "([A-Z])/", 1).alias("letter"))


@query("fn_datetime", "SELECT DISTINCT o_orderdate::DATE AS day, dayofyear(o_orderdate)::INT AS doy, (isodow(o_orderdate) - 1)::INT AS weekday, month(o_orderdate)::INT AS month, (o_orderdate::DATE + 7)::DATE AS later FROM orders")
def fn_datetime(spark, sf_dir):
    t = F.col("o_orderdate")
    return S.table(spark, sf_dir, "orders").select(F.to_date(t).alias("day"), F.dayofyear(t).alias("doy"), F.weekday(t).alias("weekday"), F.month(t).alias("month"), F.date_add(F.to_date(t), 7).alias("later")).distinct()


@query("fn_math", "SELECT k, slot, round(sin(pos) + cos(pos), 6) AS wave, round(sqrt(abs(y)), 6) AS root, round(log10(greatest(abs(y), 0.001)), 6) AS log, pos % 48 AS phase, ceil(round(y, 3))::BIGINT AS up FROM s")
def fn_math(spark, sf_dir):
    y, pos = F.col("y"), F.col("pos")
    return C.stream(spark, sf_dir).select("k", "slot", r(F.sin(pos) + F.cos(pos)).alias("wave"), r(F.sqrt(F.abs(y))).alias("root"), r(F.log10(F.greatest(F.abs(y), F.lit(0.001)))).alias("log"), F.pmod(pos, F.lit(48)).alias("phase"), F.ceil(r(y, 3)).alias("up"))


@query("fn_json_hash", "SELECT event_id, (props->>'k')::BIGINT AS v, substr(sha1(props), 1, 12) AS digest FROM ev")
def fn_json_hash(spark, sf_dir):
    return C.raw(spark, sf_dir).select("event_id", F.from_json("props", "k long")["k"].alias("v"), F.substring(F.sha1("props"), 1, 12).alias("digest"))


# Profiles.

_SD = "CASE WHEN leap AND doy = 60 THEN 59.5 WHEN leap AND doy > 60 THEN doy - 1 ELSE doy END::DOUBLE"
_PROFILE = f"""days AS (SELECT day, y, {_SD} AS d, isodow(day) - 1 AS wd FROM (SELECT o_orderdate::DATE AS day, round(avg(o_totalprice), 4) AS y, dayofyear(o_orderdate::DATE) AS doy,
  (year(o_orderdate::DATE) % 4 = 0 AND (year(o_orderdate::DATE) % 100 <> 0 OR year(o_orderdate::DATE) % 400 = 0)) AS leap FROM orders GROUP BY o_orderdate::DATE)),
tr AS (SELECT * FROM days WHERE day < DATE '1999-01-01'),
lv AS (SELECT r.d, l.level FROM (SELECT unnest(range(1, 366))::DOUBLE AS d) r LEFT JOIN (SELECT d, avg(y) AS level FROM tr WHERE d <> 59.5 GROUP BY d) l USING (d)),
fl AS (SELECT d, coalesce(level, v0 + (v1 - v0) * (d - p0) / nullif(p1 - p0, 0), v0, v1) AS level FROM (SELECT d, level, last_value(level IGNORE NULLS) OVER b AS v0, first_value(level IGNORE NULLS) OVER a AS v1,
  last_value(CASE WHEN level IS NOT NULL THEN d END IGNORE NULLS) OVER b AS p0, first_value(CASE WHEN level IS NOT NULL THEN d END IGNORE NULLS) OVER a AS p1 FROM lv
  WINDOW b AS (ORDER BY d ROWS UNBOUNDED PRECEDING), a AS (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),
sm AS (SELECT a.d, avg(b.level) AS smooth FROM fl a JOIN fl b ON ((b.d - a.d + 15)::INT % 365 + 365) % 365 <= 30 GROUP BY a.d),
an AS (SELECT d, smooth / (SELECT avg(smooth) FROM sm) AS f FROM sm),
wl AS (SELECT wd, avg(y / ((a.f + b.f) / 2)) AS level FROM tr JOIN an a ON a.d = floor(tr.d) JOIN an b ON b.d = ceil(tr.d) GROUP BY wd),
wk AS (SELECT wd, level / (SELECT avg(level) FROM wl) AS f FROM wl),
res AS (SELECT day, y, (SELECT avg(level) FROM wl) * (a.f + b.f) / 2 * wk.f AS expected FROM days JOIN an a ON a.d = floor(days.d) JOIN an b ON b.d = ceil(days.d) JOIN wk USING (wd))"""


def _days(spark, sf_dir):
    rows = S.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(r(F.avg("o_totalprice"), 4).alias("y"))
    return rows.withColumn("ts", F.col("day").cast("timestamp_ntz"))


def _fit(spark, sf_dir):
    days = _days(spark, sf_dir)
    return days, profile.fit(days.filter("day < DATE '1999-01-01'"))


@query("agg_seasonal_means", f", {_PROFILE} SELECT d, round(avg(y), 4) AS level FROM tr GROUP BY d")
def agg_seasonal_means(spark, sf_dir):
    return _days(spark, sf_dir).filter("day < DATE '1999-01-01'").groupBy(profile.season_day(F.col("ts")).alias("d")).agg(r(F.avg("y"), 4).alias("level"))


@query("win_interpolate", f", {_PROFILE} SELECT d, round(level, 4) AS level FROM fl")
def win_interpolate(spark, sf_dir):
    rows = _days(spark, sf_dir).filter("day < DATE '1999-01-01'").groupBy(profile.season_day(F.col("ts")).alias("d")).agg(F.avg("y").alias("level"))
    ring = spark.range(1, 366).select(F.col("id").cast("double").alias("d")).join(rows, "d", "left")
    return ring.select("d", r(windows.interpolated(ring, "d", "level"), 4).alias("level"))


@query("win_cyclic_ma", f", {_PROFILE} SELECT d, round(smooth, 4) AS smooth FROM sm")
def win_cyclic_ma(spark, sf_dir):
    rows = _days(spark, sf_dir).filter("day < DATE '1999-01-01'").groupBy(profile.season_day(F.col("ts")).alias("d")).agg(F.avg("y").alias("level"))
    ring = spark.range(1, 366).select(F.col("id").cast("double").alias("d")).join(rows, "d", "left")
    filled = ring.select("d", windows.interpolated(ring, "d", "level").alias("level"))
    return windows.cyclic_mean(filled, "d", "level").select("d", r("smooth", 4).alias("smooth"))


@query("jn_interp_lookup", f", {_PROFILE} SELECT day, round((a.f + b.f) / 2, 6) AS annual FROM days JOIN an a ON a.d = floor(days.d) JOIN an b ON b.d = ceil(days.d)")
def jn_interp_lookup(spark, sf_dir):
    days, fitted = _fit(spark, sf_dir)
    rows = profile._with_annual(days.withColumn("d", profile.season_day(F.col("ts"))), fitted.annual)
    return rows.select("day", r("annual").alias("annual"))


@query("ev_profile_fit", f", {_PROFILE} SELECT 'annual' AS kind, d AS place, round(f, 6) AS factor FROM an UNION ALL SELECT 'weekly', wd::DOUBLE, round(f, 6) FROM wk UNION ALL SELECT 'base', 0, round(avg(level), 4) FROM wl")
def ev_profile_fit(spark, sf_dir):
    _, p = _fit(spark, sf_dir)
    annual = p.annual.select(F.lit("annual").alias("kind"), F.col("d").alias("place"), r("factor").alias("factor"))
    weekly = p.weekly.select(F.lit("weekly"), F.col("weekday").cast("double"), r("factor"))
    return annual.union(weekly).union(p.base.select(F.lit("base"), F.lit(0.0), r("base", 4)))


@query("ev_profile_apply", f", {_PROFILE} SELECT day, round(expected, 3) AS expected, round(y - expected, 3) AS residual FROM res")
def ev_profile_apply(spark, sf_dir):
    days, p = _fit(spark, sf_dir)
    return profile.apply(days, p).select("day", r("expected", 3).alias("expected"), r("residual", 3).alias("residual"))


@query("ev_profile_daily", f", {_PROFILE} SELECT day, round(y - expected, 3) AS residual FROM res WHERE day >= DATE '1999-01-01'")
def ev_profile_daily(spark, sf_dir):
    return ev_profile_apply(spark, sf_dir).filter("day >= DATE '1999-01-01'").select("day", "residual")


@query("ev_std_stream", f", {_PROFILE} SELECT day, round((y - expected - m) / sd, 6) AS z FROM res, (SELECT avg(y - expected) AS m, stddev_pop(y - expected) AS sd FROM res WHERE day < DATE '1999-01-01')")
def ev_std_stream(spark, sf_dir):
    days, p = _fit(spark, sf_dir)
    return profile.standard_scores(profile.apply(days, p), F.col("day") < F.lit("1999-01-01").cast("date")).select("day", r("z").alias("z"))


@query("agg_amplitude", "SELECT k, 'month' AS part, round(max(m) - min(m), 6) AS amplitude FROM (SELECT l_returnflag AS k, month(l_shipdate) AS g, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY k UNION ALL SELECT k, 'weekday', round(max(m) - min(m), 6) FROM (SELECT l_returnflag AS k, isodow(l_shipdate) AS g, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY k")
def agg_amplitude(spark, sf_dir):
    rows, out = S.table(spark, sf_dir, "lineitem"), None
    for part, g in (("month", F.month("l_shipdate")), ("weekday", F.weekday("l_shipdate"))):
        means = rows.groupBy(F.col("l_returnflag").alias("k"), g.alias("g")).agg(F.avg("l_quantity").alias("m"))
        one = means.groupBy("k").agg(F.lit(part).alias("part"), r(F.max("m") - F.min("m")).alias("amplitude"))
        out = one if out is None else out.unionByName(one)
    return out


@query("agg_autocorr", "SELECT k, 1 AS lag, round(corr(y, y1), 6) AS c FROM (SELECT k, y, lag(y, 1) OVER (PARTITION BY k ORDER BY pos) AS y1 FROM s) GROUP BY k UNION ALL SELECT k, 48, round(corr(y, y1), 6) FROM (SELECT k, y, lag(y, 48) OVER (PARTITION BY k ORDER BY pos) AS y1 FROM s) GROUP BY k")
def agg_autocorr(spark, sf_dir):
    w = windows.over()
    rows = C.stream(spark, sf_dir).withColumns({"a": F.lag("y", 1).over(w), "b": F.lag("y", 48).over(w)})
    both = rows.groupBy("k").agg(F.expr("corr(y, a) FILTER (WHERE a IS NOT NULL)").alias("1"), F.expr("corr(y, b) FILTER (WHERE b IS NOT NULL)").alias("48"))
    return both.unpivot("k", ["1", "48"], "lag", "c").select("k", F.col("lag").cast("int").alias("lag"), r("c").alias("c"))


@query("agg_value_counts", "SELECT k, count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE k END AS k FROM ev) GROUP BY k")
def agg_value_counts(spark, sf_dir):
    return C.raw(spark, sf_dir).groupBy(F.when(F.col("event_id") % 7 != 0, F.col("k")).alias("k")).agg(F.count("*").alias("n"))
