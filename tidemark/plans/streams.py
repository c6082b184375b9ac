"""The canonical streams of the queries: as DataFrames and as the common head of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import conformal, escalation, forecast, metrics, regimes, selection, spread
from tidemark.sources import series as S
from tidemark.sources.shared import written

SPLITS = [("train", "2023-01-01", "2024-01-20"), ("calibration", "2024-01-21", "2024-01-23"), ("test", "2024-01-24", None)]
CATALOGUE = [
    ("E1", "2024-01-05", "2024-01-05", "day", "all", 1),
    ("E2", "2024-01-09", "2024-01-11", "date_range", "click", 2),
    ("E3", "2024-01-14", "2024-01-14", "day", "all", 2),
    ("E4", "2024-01-17", "2024-01-19", "date_range", "view", 1),
    ("E5", "2024-01-22", "2024-01-22", "day", "purchase", 2),
    ("E6", "2024-01-24", "2024-01-25", "date_range", "all", 2),
    ("E7", "2024-01-27", "2024-01-27", "day", "error", 1),
    ("E8", "2024-03-01", "2024-03-02", "date_range", "all", 2),
]
KEYS = ["click", "error", "purchase", "signup", "view"]
#: A short refractory period, so that a month of data has several accepted alarms.
REFRACTORY = S.DAY // 2

_T1, _T2 = S.stamp("2024-01-21"), S.stamp("2024-01-24")
_EVENTS = ", ".join(f"('{i}', DATE '{a}', DATE '{b}', '{p}', '{r}', {t})" for i, a, b, p, r, t in CATALOGUE)

PRELUDE = f"""WITH RECURSIVE ev AS (SELECT event_id, ts, epoch_us(ts) AS us, event_type AS k, value, props, user_id FROM events),
ev30 AS (SELECT k, us + 1799999999 - (us + 1799999999) % 1800000000 AS slot, round(avg(value), 6) AS y FROM ev WHERE us IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
s AS (SELECT k, slot, y, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS pos,
  CASE WHEN slot < {_T1} THEN 'train' WHEN slot < {_T2} THEN 'calibration' ELSE 'test' END AS split FROM ev30),
fc AS (SELECT * FROM (SELECT *, lag(y, 48) OVER (PARTITION BY k ORDER BY pos) AS p FROM s) WHERE p IS NOT NULL),
cal AS (SELECT k, pos, abs(y - p) AS score FROM fc WHERE split = 'calibration'),
rad AS (SELECT k, max(n) AS n, max(rk) AS rank, CASE WHEN max(rk) > max(n) THEN 'inf'::DOUBLE ELSE max(score) FILTER (WHERE rn = rk) END AS radius
  FROM (SELECT *, ceil(round((n + 1) * 0.9, 9))::BIGINT AS rk FROM (SELECT k, score, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY score) AS rn FROM cal)) GROUP BY k),
iv AS (SELECT k, slot, pos, y, p, round(p - radius, 6) AS lower, round(p + radius, 6) AS upper FROM fc JOIN rad USING (k) WHERE split = 'test'),
cat(event_id, start_date, end_date, date_precision, region, tier) AS (VALUES {_EVENTS}),
win AS (SELECT event_id, tier, region, date_precision, epoch_us(start_date::TIMESTAMP) AS drift_start, epoch_us(end_date::TIMESTAMP) + {S.DAY} AS drift_end,
  epoch_us(start_date::TIMESTAMP) - 7 * {S.DAY} AS pre_start, epoch_us(end_date::TIMESTAMP) + 8 * {S.DAY} AS post_end,
  CASE WHEN date_precision = 'day' THEN epoch_us(start_date::TIMESTAMP) ELSE epoch_us(end_date::TIMESTAMP) END + 8 * {S.DAY} AS match_end FROM cat),
span AS (SELECT min(slot) AS a, max(slot) AS b FROM s),
owin AS (SELECT win.* FROM win, span WHERE drift_start <= b AND drift_end > a AND region = 'all'),
lab AS (SELECT k, slot, pos, y, split, CASE kind WHEN 1 THEN 'drift' WHEN 2 THEN 'post_drift' ELSE 'pre_drift' END AS regime, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY k, slot ORDER BY kind, CASE WHEN kind = 2 THEN -drift_start ELSE drift_start END, event_id) AS r FROM (
    SELECT s.*, o.event_id, o.drift_start, CASE WHEN slot >= drift_start AND slot < drift_end THEN 1 WHEN slot >= drift_end THEN 2 ELSE 3 END AS kind FROM s, owin o)) WHERE r = 1),
ivl AS (SELECT iv.*, lab.regime FROM iv JOIN lab USING (k, slot)),
st AS (SELECT k, avg(y) AS m, stddev_pop(y) AS sd FROM s WHERE split = 'train' GROUP BY k),
alarm AS (SELECT s.k, s.slot AS us FROM s JOIN st USING (k) WHERE abs((y - m) / nullif(sd, 0)) > 2),
kwin AS (SELECT w.*, k FROM win w JOIN (SELECT DISTINCT k FROM s) ON region = 'all' OR region = k),
scored AS (SELECT k, slot, pos, regime, round(upper - lower + abs(y), 6) AS score, (y BETWEEN lower AND upper) AS hit FROM ivl),
runs AS (SELECT l_returnflag AS model, chr((65 + l_partkey % 4)::INT) AS arm, CASE WHEN l_suppkey % 2 = 0 THEN 'north' ELSE 'south' END AS region, l_linenumber AS seed, year(l_shipdate) AS yr,
  round(avg(l_extendedprice), 4) AS mae, round(avg(l_discount), 6) AS coverage, round(avg(l_quantity), 4) AS width, count(*) % 5 AS n_retrains, count(*) AS train_samples FROM lineitem GROUP BY ALL),
ledger AS (SELECT model || '/' || arm || '/fixed' AS method, model, arm, region, seed, yr, n_retrains, train_samples, metric_name, metric_value FROM runs
  UNPIVOT (metric_value FOR metric_name IN (mae, coverage, width)))"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select("event_id", "ts", S.micros("ts").alias("us"), F.col("event_type").alias("k"), "value", "props", "user_id")


def ev30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regrid(S.table(spark, sf_dir, "events"), "event_type", "ts", "value")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.numbered(ev30(spark, sf_dir)).withColumn("split", S.split_column(F.col("slot"), SPLITS))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).withColumn("p", forecast.seasonal_naive()).filter("p IS NOT NULL")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(spark, sf_dir).filter("split = 'calibration'").select("k", "pos", metrics.error().alias("score"))


def radii(spark: SparkSession, sf_dir: str, alpha: float = 0.1) -> DataFrame:
    return conformal.radii(calibration(spark, sf_dir), alpha)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = forecasts(spark, sf_dir).filter("split = 'test'").drop("split")
    return conformal.fixed_intervals(test, radii(spark, sf_dir)).withColumns({c: S.rounded(c, 6) for c in ("lower", "upper")})


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stream, in a written table, numbered in ranges so that no task holds a key."""
    rows = spread.numbered(ev30(spark, sf_dir)).withColumn("split", S.split_column(F.col("slot"), SPLITS))
    return written(rows, "placed")[0]


def forecasts_in_pieces(rows: DataFrame, reach: int, size: int = spread.PIECE) -> DataFrame:
    """forecasts of placed rows in pieces, ready for windows that look back reach rows."""
    cut = spread.haloed(rows, reach + 48, size)
    return cut.withColumn("p", forecast.seasonal_naive(key=spread.by_piece())).filter("p IS NOT NULL")


def intervals_in_pieces(rows: DataFrame, reach: int, alpha: float = 0.1) -> DataFrame:
    """intervals of placed rows in pieces, ready for windows that look back reach rows; radii are selected without a sort."""
    cut = forecasts_in_pieces(rows, reach)
    scores = spread.own(cut).filter("split = 'calibration'").select("k", metrics.error().alias("score"))
    test = cut.filter("split = 'test'").drop("split")
    return conformal.fixed_intervals(test, selection.radii(scores, alpha)).withColumns({c: S.rounded(c, 6) for c in ("lower", "upper")})


def catalogue(spark: SparkSession) -> DataFrame:
    return S.catalogue(spark, CATALOGUE)


def windows(spark: SparkSession) -> DataFrame:
    return regimes.event_windows(catalogue(spark))


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.overlapping(windows(spark).filter("region = 'all'"), ev30(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.global_regimes(stream(spark, sf_dir), overlapping(spark, sf_dir))


def labelled_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir).join(labelled(spark, sf_dir).select("k", "slot", "regime"), ["k", "slot"])


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir)
    stats = rows.filter("split = 'train'").groupBy("k").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"))
    return rows.join(stats, "k").filter(F.abs((F.col("y") - F.col("m")) / F.nullif("sd", F.lit(0.0))) > 2).select("k", F.col("slot").alias("us"))


def key_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ev30(spark, sf_dir).select("k").distinct()
    return windows(spark).join(keys, (F.col("region") == "all") | (F.col("region") == F.col("k")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_intervals(spark, sf_dir)
    return rows.select("k", "slot", "pos", "regime", S.rounded(F.col("upper") - F.col("lower") + F.abs("y"), 6).alias("score"), metrics.covered().alias("hit"))


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return escalation.curve(scored(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "lineitem")
    keyed = rows.select(
        F.col("l_returnflag").alias("model"), F.char(65 + F.col("l_partkey") % 4).alias("arm"), F.when(F.col("l_suppkey") % 2 == 0, "north").otherwise("south").alias("region"),
        F.col("l_linenumber").alias("seed"), F.year("l_shipdate").cast("long").alias("yr"), "l_extendedprice", "l_discount", "l_quantity",
    )
    return keyed.groupBy("model", "arm", "region", "seed", "yr").agg(
        S.rounded(F.avg("l_extendedprice"), 4).alias("mae"), S.rounded(F.avg("l_discount"), 6).alias("coverage"), S.rounded(F.avg("l_quantity"), 4).alias("width"),
        (F.count("*") % 5).alias("n_retrains"), F.count("*").alias("train_samples"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = runs(spark, sf_dir)
    ids = ["model", "arm", "region", "seed", "yr", "n_retrains", "train_samples"]
    return wide.unpivot(ids, ["mae", "coverage", "width"], "metric_name", "metric_value").withColumn("method", F.concat_ws("/", "model", "arm", F.lit("fixed")))
