"""Queries on the extension surface (user classes), runners and orchestration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import adapt, conformal, detectors, forecast, ledger, matching, metrics
from tidemark.plans import sequential as Q
from tidemark.plans import stages
from tidemark.plans import streams as C
from tidemark.plans.registry import query
from tidemark.plans.scans import r
from tidemark.sources import series as S
from tidemark.sources.shared import shared_folder, written
from tidemark.sources.shipping import ship_package


@query("snk_synth_detections", f", {Q._INJECTED} SELECT k, pos FROM ph WHERE fired")
def snk_synth_detections(spark, sf_dir):
    """Alarms on the shifted streams, as a table."""
    ship_package(spark)
    rows = Q._injected(spark, sf_dir).select(F.concat_ws("|", "k", "kind", "seed").alias("k"), "pos", F.col("pos").alias("slot"), "y")
    return written(detectors.alarms(rows, Q._ph).select("k", "pos"), "synthetic")[0]


@query("snk_table_image", "SELECT '| model | n |' AS line, 0 AS place UNION ALL SELECT '| ' || model || ' | ' || count(*) || ' |', 1 FROM runs GROUP BY model")
def snk_table_image(spark, sf_dir):
    """A report table as text lines, for whatever draws it."""
    rows = C.runs(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n")).select(F.concat(F.lit("| "), "model", F.lit(" | "), "n", F.lit(" |")).alias("line"), F.lit(1).alias("place"))
    return spark.createDataFrame([("| model | n |", 0)], "line string, place int").unionByName(rows)


@query("jn_left_sweep", "SELECT a.model, a.region, a.seed, a.yr, a.arm, a.mae, b.width FROM (SELECT * FROM runs WHERE arm = 'D') a LEFT JOIN (SELECT * FROM runs WHERE arm = 'D' AND seed < 4) b USING (model, region, seed, yr)")
def jn_left_sweep(spark, sf_dir):
    rows, keys = C.runs(spark, sf_dir).filter("arm = 'D'"), ["model", "region", "seed", "yr"]
    return rows.select(*keys, "arm", "mae").join(rows.filter("seed < 4").select(*keys, "width"), keys, "left")


@query("jn_index_cost_local", "SELECT model, region, n, cost FROM (SELECT model, region, count(*) AS n FROM runs GROUP BY ALL) LEFT JOIN (SELECT model, region, max(n_retrains) AS cost FROM runs WHERE region = 'north' GROUP BY ALL) USING (model, region)")
def jn_index_cost_local(spark, sf_dir):
    rows = C.runs(spark, sf_dir)
    cost = rows.filter("region = 'north'").groupBy("model", "region").agg(F.max("n_retrains").alias("cost"))
    return rows.groupBy("model", "region").agg(F.count("*").alias("n")).join(cost, ["model", "region"], "left")


class Above(detectors.Detector):
    """A user's detector: fires above a level."""

    def __init__(self, level: float):
        self.level = level
        super().__init__()

    def reset(self) -> None:
        pass

    def _step(self, x: float) -> bool:
        self.statistic = x
        return x > self.level


@query("ux_detector", "SELECT k, pos FROM s WHERE y > 100")
def ux_detector(spark, sf_dir):
    ship_package(spark)
    return detectors.alarms(C.stream(spark, sf_dir), lambda: Above(100.0)).select("k", "pos")


class LastValue(forecast.Forecaster):
    """A user's forecaster: the last value it has seen."""

    def fit(self, y):
        self.last = y[-1]
        return self

    def predict(self, n):
        return [self.last] * n

    def observe(self, y):
        self.last = y[-1]


@query("ux_forecaster", "SELECT a.k, a.pos, b.y AS p FROM s a JOIN s b ON b.k = a.k AND b.pos = 700 + 48 * ((a.pos - 700) // 48) - 1 WHERE a.pos >= 700")
def ux_forecaster(spark, sf_dir):
    ship_package(spark)
    return forecast.replay(C.stream(spark, sf_dir), LastValue, 700, 48).select("k", "pos", "p")


class OnDays(adapt.Adapter):
    """A user's arm: retrains at the end of given days."""

    def __init__(self, days: list[str], window_days: int | None = None):
        self.days, self.window_days = [S.stamp(d) for d in days], window_days

    def boundaries(self, series, triggers):
        last = series.groupBy("k").agg(F.max("day").alias("last"))
        return last.select("k", "last", F.explode(F.array(*map(F.lit, self.days))).alias("day")).filter("day < last").select("k", "day")


@query("ux_adapter", f", {Q._H} SELECT e.k, d.day FROM ends e, (VALUES ({S.stamp('2024-01-10')}), ({S.stamp('2024-02-10')})) d(day) WHERE d.day < e.b")
def ux_adapter(spark, sf_dir):
    return OnDays(["2024-01-10", "2024-02-10"]).boundaries(Q._history(spark, sf_dir), None)


class Constant(conformal.UncertaintyQuantifier):
    """A user's quantifier: the forecast plus or minus a constant."""

    def __init__(self, radius: float):
        self.radius = radius

    def interval(self, forecast):
        return forecast - self.radius, forecast + self.radius

    def observe(self, forecast, y):
        pass


@query("ux_uq", "SELECT k, pos, p - 25 AS lower, p + 25 AS upper FROM fc WHERE split = 'test'")
def ux_uq(spark, sf_dir):
    ship_package(spark)
    return conformal.replay(C.forecasts(spark, sf_dir).filter("split = 'test'"), lambda: Constant(25.0)).select("k", "pos", "lower", "upper")


@query("ux_config_of", """SELECT name, substr(sha1(c), 1, 12) AS config_hash FROM (VALUES ('a', '{"level": 100.0}'), ('b', '{"radius": 25.0}')) v(name, c)""")
def ux_config_of(spark, sf_dir):
    level = {"level": ledger.config_of(Above(100.0))["level"]}
    rows = [("a", ledger.config_hash(level)), ("b", ledger.config_hash(ledger.config_of(Constant(25.0))))]
    return spark.createDataFrame(rows, "name string, config_hash string")




@query("ux_uq_runner", "SELECT k, regime, metric_name, round(metric_value, 6) AS metric_value FROM (SELECT k, regime, avg((y BETWEEN lower AND upper)::INT) AS coverage, avg(upper - lower) AS width FROM ivl GROUP BY ALL) UNPIVOT (metric_value FOR metric_name IN (coverage, width))")
def ux_uq_runner(spark, sf_dir):
    wide = C.labelled_intervals(spark, sf_dir).groupBy("k", "regime").agg(metrics.coverage().alias("coverage"), metrics.width().alias("width"))
    return ledger.to_rows(wide, ["k", "regime"], ["coverage", "width"]).withColumn("metric_value", r("metric_value"))


@query("ux_detect_runs")
def ux_detect_runs(spark, sf_dir):
    """One detector on the half-hourly and on the daily stream."""
    ship_package(spark)
    rows = C.stream(spark, sf_dir)
    daily = rows.groupBy("k", (F.col("slot") - F.col("slot") % S.DAY).alias("slot")).agg(F.avg("y").alias("y"))
    daily = S.numbered(daily)
    make = lambda: detectors.PageHinkley(10, 0.05, 30.0, 0.99)
    parts = [detectors.alarms(x, make).select(F.lit(n).alias("stream"), "k", "pos", "us") for n, x in (("half_hourly", rows), ("daily", daily))]
    return parts[0].unionByName(parts[1])


@query("ux_synth_runs")
def ux_synth_runs(spark, sf_dir):
    """The selected detectors' runs over the shifted streams, by detector, kind and seed."""
    rows = Q._injected_scores(spark, sf_dir, detectors.SELECTED)
    return rows.groupBy("detector", "kind", "seed").agg(F.sum("matched").alias("matched"), F.sum("missed").alias("missed"), F.sum("false_alarms").alias("false_alarms"), F.avg("delay").alias("delay"))


@query("ev_delay", f", {Q._INJECTED} SELECT k, round(avg(delay), 6) AS delay FROM sc WHERE kind <> 'none' GROUP BY k")
def ev_delay(spark, sf_dir):
    return Q._ph_scores(spark, sf_dir).filter("kind <> 'none'").groupBy("k").agg(r(F.avg("delay")).alias("delay"))


@query("ev_missed", f", {Q._INJECTED} SELECT k, sum(missed)::BIGINT AS missed FROM sc WHERE kind <> 'none' GROUP BY k")
def ev_missed(spark, sf_dir):
    return Q._ph_scores(spark, sf_dir).filter("kind <> 'none'").groupBy("k").agg(F.sum("missed").alias("missed"))


@query("ux_seasonal_qc", "SELECT k, round(corr(e, e1), 6) AS after, round(corr(y, y1), 6) AS before FROM (SELECT k, y, y - p AS e, lag(y) OVER (PARTITION BY k ORDER BY pos) AS y1, lag(y - p) OVER (PARTITION BY k ORDER BY pos) AS e1 FROM fc) GROUP BY k")
def ux_seasonal_qc(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("pos")
    rows = C.forecasts(spark, sf_dir).withColumn("e", F.col("y") - F.col("p")).withColumns({"y1": F.lag("y").over(w)}).withColumns({"e1": F.lag("e").over(w)})
    return rows.groupBy("k").agg(r(F.expr("corr(e, e1) FILTER (WHERE e1 IS NOT NULL)")).alias("after"), r(F.expr("corr(y, y1) FILTER (WHERE y1 IS NOT NULL)")).alias("before"))


@query("ux_changepoints", f", {Q._KEPT} SELECT k, us, make_timestamp(us)::DATE AS day FROM kept WHERE us >= {S.stamp('2024-01-24')}")
def ux_changepoints(spark, sf_dir):
    kept = matching.debounced(C.alarms(spark, sf_dir), refractory=C.REFRACTORY).filter(F.col("accepted") & (F.col("us") >= S.stamp("2024-01-24")))
    return written(kept.select("k", "us", F.to_date(S.at("us")).alias("day")), "changepoints")[0]
