"""Queries on forecasters and retraining arms: frozen runs, runs that refit, what they cost, and the plan of stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import adapt, forecast, metrics
from tidemark.plans import sequential as Q
from tidemark.plans import stages
from tidemark.plans import streams as C
from tidemark.plans.registry import query
from tidemark.plans.scans import r
from tidemark.plans.surface import LastValue, OnDays
from tidemark.sources import series as S
from tidemark.sources.shared import shared_folder, written
from tidemark.sources.shipping import ship_package

START = S.stamp("2024-01-24")
_DAY = f"slot - slot % {S.DAY}"


def _triggers(spark, sf_dir):
    return C.alarms(spark, sf_dir).select("k", (F.col("us") - F.col("us") % S.DAY).alias("day"))


def _run(spark, sf_dir, arm: adapt.Adapter, make, triggers=None):
    ship_package(spark)
    series = Q._history(spark, sf_dir)
    boundaries = arm.boundaries(series.filter(F.col("slot") >= START), triggers)
    return adapt.arm_forecasts(series, boundaries, make, START, arm.window_days)


def _arm_sql(name: str, boundaries: str, window_days: int | None = None) -> str:
    """CTEs of an arm that forecasts the mean of its training rows: {name}_m: k, model, p, n; {name}_f: k, slot, y, model, p."""
    window = "" if window_days is None else f" AND (g.model IS NULL OR {_DAY.replace('slot', 's.slot')} > g.model - {window_days * S.DAY})"
    return f"""{name}_b AS ({boundaries}),
{name}_g AS (SELECT s.k, s.slot, s.y, max(b.day) AS model FROM s LEFT JOIN {name}_b b ON b.k = s.k AND s.slot >= b.day + {S.DAY} WHERE s.slot >= {START} GROUP BY ALL),
{name}_m AS (SELECT g.k, g.model, avg(s.y) AS p, count(*) AS n FROM (SELECT DISTINCT k, model FROM {name}_g) g JOIN s ON s.k = g.k AND s.slot < coalesce(g.model + {S.DAY}, {START}){window} GROUP BY ALL),
{name}_f AS (SELECT g.*, m.p FROM {name}_g g JOIN {name}_m m ON m.k = g.k AND m.model IS NOT DISTINCT FROM g.model)"""


_TEST = f"te AS (SELECT k, min({_DAY}) AS a, max({_DAY}) AS b FROM s WHERE slot >= {START} GROUP BY k)"
_ON_TRIGGER = f"SELECT DISTINCT al.k, al.us - al.us % {S.DAY} AS day FROM alarm al JOIN te ON te.k = al.k WHERE al.us - al.us % {S.DAY} >= a AND al.us - al.us % {S.DAY} < b"
_EVERY_2 = f"SELECT k, unnest(generate_series(a + {S.DAY}, b - {S.DAY}, 2 * {S.DAY})) AS day FROM te"


@query("sq_arm_loop", f", {_TEST}, {_arm_sql('c', _ON_TRIGGER)} SELECT k, coalesce(model, -1) AS model, count(*) AS n, round(any_value(p), 6) AS p, round(avg(abs(y - p)), 6) AS mae FROM c_f GROUP BY ALL")
def sq_arm_loop(spark, sf_dir):
    """Segments of an arm's run: forecast, refit at the end of a trigger's day, next segment; one on the last day does nothing."""
    rows = _run(spark, sf_dir, adapt.OnTrigger(), forecast.HistoryMean, _triggers(spark, sf_dir))
    return rows.groupBy("k", F.coalesce("model", F.lit(-1)).alias("model")).agg(F.count("*").alias("n"), r(F.first("p")).alias("p"), r(metrics.mae()).alias("mae"))


_ADS = f"SELECT k, {S.stamp('2024-01-26')} AS day FROM te WHERE {S.stamp('2024-01-26')} < b"


@query("ad_contract", f", {_TEST}, {_arm_sql('c', _ADS, 3)} SELECT m.k, m.n AS train_rows, round(m.p, 6) AS p, count(*) AS served FROM c_m m JOIN c_f f ON f.k = m.k AND f.model = m.model GROUP BY ALL")
def ad_contract(spark, sf_dir):
    """A user's arm refits on its three days; what the refitted model was trained on, says, and serves."""
    rows = _run(spark, sf_dir, OnDays(["2024-01-26"], 3), forecast.HistoryMean).filter("model IS NOT NULL")
    return rows.groupBy("k", "train_rows", r("p").alias("p")).agg(F.count("*").alias("served"))


_COST = "SELECT k, count(*) AS n_retrains, sum(n)::BIGINT AS train_samples, string_agg(strftime(make_timestamp(model), '%Y-%m-%d'), ',' ORDER BY model) AS retrained FROM {m} WHERE model IS NOT NULL GROUP BY k"


@query("ad_accounting", f", {_TEST}, {_arm_sql('c', _ON_TRIGGER)} SELECT k, coalesce(n_retrains, 0) AS n_retrains, coalesce(train_samples, 0) AS train_samples, coalesce(retrained, '') AS retrained, true AS timed FROM (SELECT DISTINCT k FROM c_f) LEFT JOIN ({_COST.format(m='c_m')}) USING (k)")
def ad_accounting(spark, sf_dir):
    """What an arm's refits cost: their number, rows, days, and the seconds they took, which are only held to be there."""
    costs = adapt.arm_costs(_run(spark, sf_dir, adapt.OnTrigger(), forecast.HistoryMean, _triggers(spark, sf_dir)))
    days = F.concat_ws(",", F.transform("retrained", lambda d: F.date_format(S.at(d), "yyyy-MM-dd")))
    return costs.select("k", "n_retrains", "train_samples", days.alias("retrained"), (F.col("fit_seconds") > 0).alias("timed"))


_ARMS = {"A": ("SELECT NULL::VARCHAR AS k, NULL::BIGINT AS day WHERE false", None), "B": (_EVERY_2, 2), "C": (_ON_TRIGGER, None), "D": (_ON_TRIGGER, 5)}


@query(
    "ux_adapt_runs",
    f", {_TEST}, " + ", ".join(_arm_sql(a.lower(), *_ARMS[a]) for a in _ARMS) + " "
    + " UNION ALL ".join(f"SELECT '{a}' AS arm, f.k, coalesce(any_value(c.n_retrains), 0) AS n_retrains, coalesce(any_value(c.train_samples), 0) AS train_samples, round(avg(abs(y - p)), 6) AS mae FROM {a.lower()}_f f LEFT JOIN ({_COST.format(m=a.lower() + '_m')}) c ON c.k = f.k GROUP BY f.k" for a in _ARMS),
)
def ux_adapt_runs(spark, sf_dir):
    """Every arm over every series: forecasts, refits, error and cost."""
    triggers, out = _triggers(spark, sf_dir), None
    for name, arm in (("A", adapt.NeverRetrain()), ("B", adapt.EveryDays(2)), ("C", adapt.OnTrigger()), ("D", adapt.OnTrigger(5))):
        run, _ = written(_run(spark, sf_dir, arm, forecast.HistoryMean, triggers), f"arm-{name}")
        scores = run.groupBy("k").agg(r(metrics.mae()).alias("mae"))
        rows = adapt.arm_costs(run).join(scores, "k").select(F.lit(name).alias("arm"), "k", "n_retrains", "train_samples", "mae")
        out = rows if out is None else out.unionByName(rows)
    return out


# Frozen runs.


def _frozen(spark, sf_dir, make, start=START, upto=None):
    ship_package(spark)
    series = Q._history(spark, sf_dir)
    series = series if upto is None else series.filter(F.col("slot") < upto)
    return adapt.arm_forecasts(series, adapt.NeverRetrain().boundaries(series, None), make, start)


def _naive_sql(start: int, upto: int | None = None) -> str:
    """k, slot, y and the frozen forecasts of three models, in blocks of 48 rows from start on."""
    end = "" if upto is None else f" AND a.slot < {upto}"
    return f"""SELECT a.k, a.slot, a.y, b.y AS naive, c.y AS last, m.p AS mean FROM s a JOIN (SELECT k, min(pos) AS f FROM s WHERE slot >= {start} GROUP BY k) f ON f.k = a.k
 JOIN s b ON b.k = a.k AND b.pos = a.pos - 48 JOIN s c ON c.k = a.k AND c.pos = f.f + (a.pos - f.f) // 48 * 48 - 1 JOIN (SELECT k, avg(y) AS p FROM s WHERE slot < {start} GROUP BY k) m ON m.k = a.k WHERE a.slot >= {start}{end}"""


_MODELS = {"naive": forecast.SeasonalNaive, "last": LastValue, "mean": forecast.HistoryMean}
_SCORES = "SELECT k, model, count(*) AS n, round(avg(abs(y - p)), 6) AS mae FROM (SELECT * FROM ({rows}) UNPIVOT (p FOR model IN (naive, last, mean))) GROUP BY ALL"


def _scores(spark, sf_dir, start=START, upto=None):
    out = None
    for name, make in _MODELS.items():
        rows = _frozen(spark, sf_dir, make, start, upto).groupBy("k").agg(F.count("*").alias("n"), r(metrics.mae()).alias("mae")).select("k", F.lit(name).alias("model"), "n", "mae")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("ux_baselines", ", b AS (" + _SCORES.format(rows=_naive_sql(START)) + ") SELECT * FROM b")
def ux_baselines(spark, sf_dir):
    """Baselines fitted once on what lies before the test span, scored on it."""
    return _scores(spark, sf_dir)


@query("ux_nhits")
def ux_nhits(spark, sf_dir):
    """The block model fitted once, scored on the test span."""
    return _frozen(spark, sf_dir, forecast.BlockRidge).groupBy("k").agg(F.count("*").alias("n"), metrics.mae().alias("mae"))


_T1 = S.stamp("2024-01-21")


@query("ux_calibration", f", c AS ({_naive_sql(_T1, START)}) SELECT k, slot, round(y - naive, 6) AS residual FROM c")
def ux_calibration(spark, sf_dir):
    """Forecasts of the calibration span by models fitted on the training span, saved as signed residuals."""
    rows = _frozen(spark, sf_dir, forecast.SeasonalNaive, _T1, START).select("k", "slot", r(F.col("y") - F.col("p")).alias("residual"))
    return written(rows, "calibration")[0]


_T0 = S.stamp("2024-01-16")


@query("ux_holdout", ", h AS (" + _SCORES.format(rows=_naive_sql(_T0, _T1)) + ") SELECT k, model, mae, place FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY mae, model) AS place FROM h)")
def ux_holdout(spark, sf_dir):
    """Models ranked on the last days of the training span, fitted on those before."""
    place = F.row_number().over(Window.partitionBy("k").orderBy("mae", "model")).cast("long")
    return _scores(spark, sf_dir, _T0, _T1).select("k", "model", "mae", place.alias("place"))


@query("sq_block_fc", "SELECT a.k, a.pos, a.slot, a.y, b.y AS p FROM s a JOIN s b ON b.k = a.k AND b.pos = a.pos - 48 WHERE a.pos >= 700")
def sq_block_fc(spark, sf_dir):
    """A model asked for a block at a time, and shown each block behind it; of the seasonal model's season, so that its
    forecasts are the values of one season before."""
    return Q._replayed(spark, sf_dir, forecast.SeasonalNaive)


@query("sq_recursive_fc")
def sq_recursive_fc(spark, sf_dir):
    """One-step forecasts of a linear autoregression that feed its later lags."""
    ship_package(spark)
    return forecast.ahead(C.stream(spark, sf_dir).filter("split = 'train'"), forecast.LinearAr, 96)


# Stages.


def _actions(spark, sf_dir, folder):
    """What the light stages do: each writes a table and reads those of the stages before."""
    put = lambda rows, name: rows.write.parquet(f"{folder}/{name}")
    return {
        "data": lambda: put(C.stream(spark, sf_dir), "data"),
        "detect": lambda: put(C.alarms(spark, sf_dir).join(spark.read.parquet(f"{folder}/data").select("k").distinct(), "k", "left_semi"), "detect"),
        "escalation": lambda: put(C.scored(spark, sf_dir).withColumn("review", F.col("score") > 150), "escalation"),
        "produce": lambda: put(spark.read.parquet(f"{folder}/escalation").groupBy("k").agg(F.count_if("review").alias("n")), "produce"),
    }


@query("ux_stage_plan", """SELECT 'data' AS name, 'done' AS outcome, count(*) AS n FROM s UNION ALL SELECT 'detect', 'done', count(*) FROM alarm UNION ALL SELECT 'escalation', 'done', count(*) FROM scored
 UNION ALL SELECT 'produce', 'done', count(DISTINCT k) FROM scored UNION ALL SELECT name, 'left out', 0 FROM (VALUES ('synthetic'), ('forecast'), ('adapt'), ('uncertainty')) v(name)""")
def ux_stage_plan(spark, sf_dir):
    """The light stages run one after another; what each wrote."""
    folder = shared_folder(spark, "stages")
    actions = _actions(spark, sf_dir, folder)
    chosen, left = stages.select(stages.STAGES)
    log = stages.execute([stages.Stage(s.name, s.needs, s.heavy, actions[s.name]) for s in chosen])
    rows = [(name, outcome, spark.read.parquet(f"{folder}/{name}").count() if outcome == "done" else 0) for name, outcome in log]
    return spark.createDataFrame(rows + [(s.name, "left out", 0) for s in left], "name string, outcome string, n long")
