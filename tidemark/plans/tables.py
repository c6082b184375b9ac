"""Report tables, figures' data, files from outside and the run surface, each built by the library's operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import clean, conformal, escalation, ledger, metrics, profile, regimes, windows
from tidemark.plans import scans, sequential
from tidemark.plans import streams as C
from tidemark.plans.evaluation import _roll
from tidemark.plans.registry import query
from tidemark.plans.reports import _PICK
from tidemark.plans.scans import r
from tidemark.sources import external
from tidemark.sources import series as S
from tidemark.sources.shared import locked, shared_folder, written

_GREEDY = sequential._GREEDY

# Files from outside, locks and caches.


def _csv(spark, rows, schema, tag):
    folder = shared_folder(spark, tag)
    spark.createDataFrame(rows, schema).coalesce(1).write.option("header", True).option("escape", '"').csv(folder)
    return folder


@query("src_cached_load", "SELECT k, slot, round(avg(value), 6) AS y FROM (SELECT k, us + 1799999999 - (us + 1799999999) % 1800000000 AS slot, value FROM (SELECT *, row_number() OVER (PARTITION BY k, ts ORDER BY event_id) AS r FROM ev WHERE ts IS NOT NULL) WHERE r = 1 AND k = 'click' AND value IS NOT NULL) GROUP BY ALL")
def src_cached_load(spark, sf_dir):
    """One region's readings cleaned and put on the grid, once for all that ask; an unknown region is an error."""
    load = lambda region: S.loaded(spark, sf_dir, region, C.KEYS, _cleaned)
    if load("click") is not load("click"):
        raise AssertionError("the second call read the files again")
    try:
        load("nowhere")
    except ValueError:
        return load("click")
    raise AssertionError("an unknown region was read")


def _cleaned(spark, sf_dir, region):
    raw = C.raw(spark, sf_dir).filter(F.col("k") == region).select(F.col("event_id").alias("arrival"), "k", F.col("ts").cast("string").alias("ts"), F.col("value").cast("string").alias("value"))
    return S.regrid(clean.clean(raw, "k", "ts", "value", "arrival"), "k", "ts", "value")


@query("src_winners", "SELECT 'ph' AS detector, 600.0 AS threshold, 20 AS min_instances")
def src_winners(spark, sf_dir):
    """A detector's frozen row from a file; a file or row that is missing, or a row that was not selected, is an error."""
    rows = [("ph", "selected", '{"threshold": 600.0, "min_instances": 20}'), ("other", "rejected", "{}")]
    path = _csv(spark, rows, "detector string, status string, kwargs string", "winners")
    read = lambda at, name: external.frozen_config(spark, at, name, "threshold double, min_instances int")
    for at, name, error in ((f"{path}-none", "ph", FileNotFoundError), (path, "nobody", LookupError), (path, "other", ValueError)):
        try:
            read(at, name)
        except error:
            continue
        raise AssertionError(f"{at}, {name} was read")
    return read(path, "ph")


@query("src_group_b", "SELECT file, k, count(*) AS n, coalesce(CASE WHEN file = 'there' THEN CASE k WHEN 'click' THEN '0.5' WHEN 'view' THEN '0.7' END END, 'awaiting') AS other FROM s, (VALUES ('there'), ('absent')) v(file) GROUP BY ALL")
def src_group_b(spark, sf_dir):
    """Another team's values beside ours, with their file and without it."""
    path, out = _csv(spark, [("click", "0.5"), ("view", "0.7")], "k string, other string", "others"), None
    ours = C.ev30(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"))
    for name, at in (("there", path), ("absent", f"{path}-none")):
        rows = ours.join(external.optional_csv(spark, at, "k string, other string"), "k", "left").select(F.lit(name).alias("file"), "k", "n", F.coalesce("other", F.lit("awaiting")).alias("other"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("jn_group_b", "SELECT metric_name, region, coalesce(v, 'awaiting') AS v FROM (SELECT DISTINCT metric_name, region FROM ledger) LEFT JOIN (VALUES ('mae', 'north', '1.5'), ('width', 'south', '25')) o(metric_name, region, v) USING (metric_name, region)")
def jn_group_b(spark, sf_dir):
    path = _csv(spark, [("mae", "north", "1.5"), ("width", "south", "25")], "metric_name string, region string, v string", "others")
    other = external.optional_csv(spark, path, "metric_name string, region string, v string")
    keys = C.ledger(spark, sf_dir).select("metric_name", "region").distinct()
    return keys.join(other, ["metric_name", "region"], "left").withColumn("v", F.coalesce("v", F.lit("awaiting")))


@query("snk_lock", "SELECT region, count(*) AS n FROM runs GROUP BY region")
def snk_lock(spark, sf_dir):
    """Two appenders of one table at once; each holds the table's lock while it writes."""
    from concurrent.futures import ThreadPoolExecutor

    folder = shared_folder(spark, "appended")
    rows = C.runs(spark, sf_dir).select("region", "mae")

    def append(region):
        with locked(spark, f"{folder}.lock"):
            rows.filter(F.col("region") == region).write.mode("append").parquet(folder)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(append, ["north", "south"]))
    return spark.read.parquet(folder).groupBy("region").agg(F.count("*").alias("n"))


@query("src_ui_read", "SELECT model, arm, region, seed, yr, mae, 2 AS version FROM runs WHERE arm <> 'A'")
def src_ui_read(spark, sf_dir):
    """A table that a page reads again and again: one plan until the file is written anew."""
    folder = shared_folder(spark, "table")
    rows = C.runs(spark, sf_dir).select("model", "arm", "region", "seed", "yr", "mae")
    schema = "model string, arm string, region string, seed int, yr long, mae double, version int"
    rows.filter("arm = 'A'").withColumn("version", F.lit(1)).write.option("header", True).csv(folder)
    first = external.cached_csv(spark, folder, schema)
    if external.cached_csv(spark, folder, schema) is not first:
        raise AssertionError("an unchanged file was read again")
    rows.filter("arm <> 'A'").withColumn("version", F.lit(2)).write.mode("overwrite").option("header", True).csv(folder)
    return external.cached_csv(spark, folder, schema)


@query("val_level", "SELECT model, arm, region, seed, yr, round(coverage * 20 - 0.5, 6) AS alpha, round(coverage * 20 - 0.5, 6) > 0 AND round(coverage * 20 - 0.5, 6) < 1 AS valid FROM runs")
def val_level(spark, sf_dir):
    """Levels outside (0, 1), by the same rule as the quantifiers'."""
    alpha = r(F.col("coverage") * 20 - 0.5)
    return C.runs(spark, sf_dir).select("model", "arm", "region", "seed", "yr", alpha.alias("alpha"), conformal.valid_level(alpha).alias("valid"))


@query("set_except", "SELECT c AS missing FROM (VALUES ('l_orderkey'), ('l_shipdate'), ('tier'), ('region')) v(c) EXCEPT SELECT column_name FROM (DESCRIBE lineitem)")
def set_except(spark, sf_dir):
    """Required columns that a table lacks."""
    missing = clean.missing_columns(S.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_shipdate", "tier", "region"])
    return spark.createDataFrame([(c,) for c in missing], "missing string")


# Detection tables and figures.




@query("rp_t2", f""", {_GREEDY}, ev1 AS (SELECT k, event_id, match_end - drift_start AS len FROM kwin WHERE tier = 1),
cn AS (SELECT k, count(*) AS raw, count(*) FILTER (WHERE label <> 'Ignored') AS accepted, count(*) FILTER (WHERE tier = 1) AS t1, count(*) FILTER (WHERE tier = 2) AS t2, count(*) FILTER (WHERE label = 'Unmatch') AS unmatched FROM al GROUP BY k),
dl AS (SELECT e.k, max(CASE WHEN e.event_id = 'E1' THEN coalesce(round(delay, 0)::BIGINT::VARCHAR, 'not detected') END) AS "E1", max(CASE WHEN e.event_id = 'E4' THEN coalesce(round(delay, 0)::BIGINT::VARCHAR, 'not detected') END) AS "E4",
 max(CASE WHEN e.event_id = 'E7' THEN coalesce(round(delay, 0)::BIGINT::VARCHAR, 'not detected') END) AS "E7", count(*) - count(delay) AS tier1_unmatched, any_value(c.accepted) AS n,
 round(sum(1 - pow(1 - least(1, len / {30.0 * S.DAY}), c.accepted)), 2) AS chance_tier1 FROM ev1 e JOIN cn c ON c.k = e.k LEFT JOIN al ON al.k = e.k AND al.event_id = e.event_id GROUP BY e.k)
SELECT c.k, "E1", "E4", "E7", t1 AS tier1_matched, tier1_unmatched, round(t1 / nullif(accepted, 0)::DOUBLE, 2) AS precision_t1, t2 AS tier2_matched, round(t2 / nullif(accepted, 0)::DOUBLE, 2) AS precision_t2, unmatched, raw, accepted, chance_tier1 FROM cn c JOIN dl USING (k)""")
def rp_t2(spark, sf_dir):
    """Delays of the first-tier events, precision by tier over all accepted alarms, and what chance would match."""
    matches, _ = written(sequential._matches(spark, sf_dir), "matches")
    tier1 = C.key_windows(spark, sf_dir).filter("tier = 1").select("k", "event_id", (F.col("match_end") - F.col("drift_start")).alias("len"))
    label, tier = F.col("label"), F.col("tier")
    counts = matches.groupBy("k").agg(F.count("*").alias("raw"), F.count_if(label != "Ignored").alias("accepted"), F.count_if(tier == 1).alias("t1"), F.count_if(tier == 2).alias("t2"), F.count_if(label == "Unmatch").alias("unmatched"))
    found = tier1.join(matches.select("k", "event_id", "delay_days"), ["k", "event_id"], "left").join(counts.select("k", "accepted"), "k")
    hit = 1 - F.pow(1 - F.least(F.lit(1.0), F.col("len") / (30.0 * S.DAY)), F.col("accepted"))
    names = [i for i, *_, t in C.CATALOGUE if t == 1]
    cell = F.coalesce(r("delay_days", 0).cast("long").cast("string"), F.lit("not detected"))
    rows = found.groupBy("k").agg(*(F.max(F.when(F.col("event_id") == n, cell)).alias(n) for n in names), F.count_if(F.col("delay_days").isNull()).alias("tier1_unmatched"), r(F.sum(hit), 2).alias("chance_tier1"))
    share = lambda n: r(F.col(n) / F.nullif("accepted", F.lit(0)), 2)
    return counts.join(rows, "k").select(
        "k", *names, F.col("t1").alias("tier1_matched"), "tier1_unmatched", share("t1").alias("precision_t1"), F.col("t2").alias("tier2_matched"), share("t2").alias("precision_t2"), "unmatched", "raw", "accepted", "chance_tier1",
    )


_CELL = "CASE WHEN count({v}) = 0 THEN 'n/a' WHEN count({v}) = 1 THEN printf('%.1f', round(avg({v}), 4)) || ' ± n/a' ELSE printf('%.1f ± %.1f', round(avg({v}), 4), round(stddev_samp({v}), 4)) END"
_LOC = "(SELECT k, slot, CASE kind WHEN 1 THEN 'drift' WHEN 2 THEN 'pre_drift' ELSE 'post_drift' END AS regime FROM (SELECT *, row_number() OVER (PARTITION BY k, slot ORDER BY kind, drift_start, event_id) AS r FROM (SELECT s.k, slot, event_id, drift_start, CASE WHEN slot >= drift_start AND slot < drift_end THEN 1 WHEN slot < drift_start THEN 2 ELSE 3 END AS kind FROM s JOIN owin ON slot >= pre_start AND slot < post_end)) WHERE r = 1)"


@query("rp_t3", f""", sd AS (SELECT * FROM (SELECT k, slot, pos, y, n AS seed, lag(y, 48) OVER w AS p1, lag(y, 96) OVER w AS p2, lag(y, 144) OVER w AS p3 FROM s, (VALUES (1), (2), (3)) v(n) WINDOW w AS (PARTITION BY n, k ORDER BY pos))),
sp AS (SELECT k, slot, seed, y, CASE seed WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS p FROM sd),
rg AS (SELECT 'global' AS rule, k, slot, regime FROM lab UNION ALL SELECT 'local', k, slot, regime FROM {_LOC}),
pr AS (SELECT rule, k, seed, avg(abs(y - p)) FILTER (WHERE regime = 'pre_drift') AS pre, avg(abs(y - p)) FILTER (WHERE regime = 'drift') AS drift, avg(abs(y - p)) FILTER (WHERE regime = 'post_drift') AS post,
 avg(((CASE WHEN y >= p - 25 THEN 0.05 * (y - p + 25) ELSE -0.95 * (y - p + 25) END) + (CASE WHEN y >= p + 25 THEN 0.95 * (y - p - 25) ELSE -0.05 * (y - p - 25) END)) / 2) AS pinball FROM sp JOIN rg USING (k, slot) WHERE p IS NOT NULL GROUP BY ALL)
SELECT rule, k, {_CELL.format(v='pre')} AS pre_drift, {_CELL.format(v='drift')} AS drift, {_CELL.format(v='post')} AS post_drift, {_CELL.format(v='pinball')} AS pinball, count(*) AS seeds FROM pr GROUP BY rule, k""")
def rp_t3(spark, sf_dir):
    """Error by regime and pinball loss, mean and deviation over runs, by both regime rules. A run is a season of one, two or
    three days with bounds at 25 on either side."""
    series, found = C.stream(spark, sf_dir), C.overlapping(spark, sf_dir)
    w = windows.over()
    runs = None
    for seed in (1, 2, 3):
        one = series.select("k", "slot", "y", F.lag("y", 48 * seed).over(w).alias("p"), F.lit(seed).alias("seed")).filter("p IS NOT NULL")
        runs = one if runs is None else runs.unionByName(one)
    runs = runs.withColumns({"lower": F.col("p") - 25, "upper": F.col("p") + 25})
    out = None
    for rule, label in (("global", regimes.global_regimes), ("local", regimes.local_regimes)):
        labels = label(series, found).select("k", "slot", "regime")
        scored = runs.join(labels, ["k", "slot"]).groupBy("k", "seed")
        cells = [F.avg(F.when(F.col("regime") == x, metrics.error())).alias(x) for x in metrics.REGIMES]
        one = scored.agg(*cells, metrics.interval_pinball(0.1).alias("pinball")).withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    names = [*metrics.REGIMES, "pinball"]
    stats = out.groupBy("rule", "k").agg(*(c for x in names for c in (r(F.avg(x), 4).alias(f"{x}_m"), r(F.stddev_samp(x), 4).alias(f"{x}_s"), F.count(x).alias(f"{x}_n"))), F.count("*").alias("seeds"))
    return stats.select("rule", "k", *(ledger.mean_sd_text(f"{x}_m", f"{x}_s", f"{x}_n").alias(x) for x in names), "seeds")


_CR = """cr AS (SELECT g.k, g.regime, g.threshold, any_value(g.n) AS n, count(s.score) AS kept, 1 - count(s.score) / any_value(g.n)::DOUBLE AS review_rate, avg(s.hit::INT) AS retained_coverage FROM (
 SELECT * FROM (SELECT k, regime, count(*) AS n FROM scored GROUP BY ALL) JOIN (SELECT DISTINCT k, score AS threshold FROM scored UNION SELECT k, '-inf'::DOUBLE FROM scored) USING (k)) g
 LEFT JOIN scored s ON s.k = g.k AND s.regime = g.regime AND s.score <= g.threshold GROUP BY g.k, g.regime, g.threshold)"""


def _t6_sql() -> str:
    rates = ", ".join(f"coalesce(printf('%.1f %%', round(100 * min(review_rate) FILTER (WHERE retained_coverage >= {t} AND kept >= 48), 6)), 'unreachable') AS rate_for_{round(t * 100)}" for t in (0.9, 0.95))
    budgets = ", ".join(
        f"CASE WHEN {b} - max(review_rate) FILTER (WHERE review_rate <= {b}) <= 0.01 THEN coalesce(printf('%.3f', round(arg_max(retained_coverage, review_rate) FILTER (WHERE review_rate <= {b} AND retained_coverage IS NOT NULL), 6)), 'n/a') ELSE 'not attainable' END AS coverage_at_{round(b * 100)}" for b in (0.05, 0.1, 0.2)
    )
    return f", {_CR} SELECT k, regime, {rates}, {budgets} FROM cr GROUP BY k, regime"


@query("rp_t6", _t6_sql())
def rp_t6(spark, sf_dir):
    """Operating points by regime: unreachable where no review rate gives the coverage, not attainable where no threshold
    reviews about as much as the budget."""
    curve = escalation.curve_by_group(C.scored(spark, sf_dir), "regime")
    rate = F.col("review_rate")
    rates = {t: escalation.rate_for_coverage(t, 48) for t in (0.9, 0.95)}
    cells = [F.when(x.isNull(), "unreachable").otherwise(F.concat(ledger.fixed_text(r(100 * x)), F.lit(" %"))).alias(f"rate_for_{round(t * 100)}") for t, x in rates.items()]
    for b in (0.05, 0.1, 0.2):
        near = F.lit(b) - F.max(F.when(rate <= b, rate)) <= 0.01
        at = F.max_by("retained_coverage", F.when((rate <= b) & F.col("retained_coverage").isNotNull(), rate))
        cells.append(F.when(near, F.when(at.isNull(), "n/a").otherwise(ledger.fixed_text(r(at), 3))).otherwise("not attainable").alias(f"coverage_at_{round(b * 100)}"))
    return curve.groupBy("k", "regime").agg(*cells)


@query("rp_t7", """, ours AS (SELECT region, 'error' AS metric, printf('%.1f', round(avg(mae), 4)) AS v FROM runs WHERE arm = 'C' GROUP BY region UNION ALL SELECT region, 'retrains', sum(n_retrains)::BIGINT::VARCHAR FROM runs WHERE arm = 'C' GROUP BY region UNION ALL SELECT region, 'coverage', printf('%.3f', round(min(coverage), 6)) FROM runs WHERE arm = 'C' GROUP BY region),
theirs(metric, region, v) AS (VALUES ('error', 'north', '38000.5'), ('retrains', 'north', '12')), al2 AS (SELECT metric, 'ours_' || region AS c, v FROM ours UNION ALL SELECT m.metric, 'theirs_' || g.region, coalesce(t.v, 'awaiting') FROM (SELECT DISTINCT metric FROM ours) m, (VALUES ('north'), ('south')) g(region) LEFT JOIN theirs t ON t.metric = m.metric AND t.region = g.region)
SELECT metric, max(v) FILTER (WHERE c = 'ours_north') AS ours_north, max(v) FILTER (WHERE c = 'ours_south') AS ours_south, max(v) FILTER (WHERE c = 'theirs_north') AS theirs_north, max(v) FILTER (WHERE c = 'theirs_south') AS theirs_south FROM al2 GROUP BY metric""")
def rp_t7(spark, sf_dir):
    """Our headline figures beside another team's, which come from their file or are awaited."""
    runs = C.runs(spark, sf_dir).filter("arm = 'C'").groupBy("region").agg(
        ledger.fixed_text(r(F.avg("mae"), 4)).alias("error"), F.sum("n_retrains").cast("string").alias("retrains"), ledger.fixed_text(r(F.min("coverage")), 3).alias("coverage")
    )
    ours = runs.unpivot("region", ["error", "retrains", "coverage"], "metric", "v")
    schema = "metric string, region string, v string"
    theirs = external.optional_csv(spark, _csv(spark, [("error", "north", "38000.5"), ("retrains", "north", "12")], schema, "team"), schema)
    awaited = ours.select("metric", "region").join(theirs, ["metric", "region"], "left").select("metric", F.concat(F.lit("theirs_"), "region").alias("c"), F.coalesce("v", F.lit("awaiting")).alias("v"))
    both = ours.select("metric", F.concat(F.lit("ours_"), "region").alias("c"), "v").unionByName(awaited)
    return both.groupBy("metric").pivot("c", [f"{t}_{g}" for t in ("ours", "theirs") for g in ("north", "south")]).agg(F.max("v"))


# Selection.

_CHOSEN = f"""ch AS (SELECT l.region, l.model AS leader, coalesce((SELECT arg_min(o.model, o.place) FROM {_PICK} o WHERE o.region = l.region AND o.place > 1 AND o.mean - l.mean <= greatest(coalesce(l.sd, 0), coalesce(o.sd, 0)) AND o.cost < l.cost), l.model) AS model FROM {_PICK} l WHERE l.place = 1)"""


def _chosen(spark, sf_dir):
    """region, leader, model: the best mean, or the first cheaper one within a deviation of it."""
    w = Window.partitionBy("region").orderBy("mean", "model")
    rows = C.runs(spark, sf_dir).groupBy("region", "model").agg(r(F.avg("mae"), 2).alias("mean"), r(F.stddev_samp("mae"), 2).alias("sd"), r(F.avg("width"), 4).alias("cost"))
    rows = rows.withColumn("place", F.row_number().over(w)).withColumns({f"l_{c}": F.first(c).over(w) for c in ("model", "mean", "sd", "cost")})
    near = F.col("mean") - F.col("l_mean") <= F.greatest(F.coalesce("l_sd", F.lit(0.0)), F.coalesce("sd", F.lit(0.0)))
    cheaper = F.when((F.col("place") > 1) & near & (F.col("cost") < F.col("l_cost")), F.col("place"))
    return rows, rows.groupBy("region").agg(F.first("l_model").alias("leader"), F.coalesce(F.min_by("model", cheaper), F.first("l_model")).alias("model"))


@query("top_pick", f", {_CHOSEN} SELECT region, model FROM ch")
def top_pick(spark, sf_dir):
    return _chosen(spark, sf_dir)[1].select("region", "model")


@query("rp_fsel", f""", {_CHOSEN} SELECT p.region, p.model, CASE WHEN p.sd IS NULL THEN printf('%.1f', round(p.mean, 1)) ELSE printf('%.1f ± %.1f', round(p.mean, 1), round(p.sd, 1)) END AS error, p.place,
 CASE WHEN p.model <> ch.model THEN '' WHEN ch.model = ch.leader THEN 'lowest mean' ELSE 'within a deviation of ' || ch.leader || ', and cheaper' END AS pick,
 (SELECT CASE WHEN count(DISTINCT model) = 1 THEN 'selected: ' || min(model) ELSE 'no single model' END FROM ch) AS verdict FROM {_PICK} p JOIN ch USING (region)""")
def rp_fsel(spark, sf_dir):
    """Models by region with the pick and its reason, and whether all regions agree."""
    rows, chosen = _chosen(spark, sf_dir)
    verdict = chosen.agg(F.when(F.count_distinct("model") == 1, F.concat(F.lit("selected: "), F.min("model"))).otherwise("no single model")).first()[0]
    text = F.when(F.col("sd").isNull(), ledger.fixed_text(r("mean", 1))).otherwise(F.concat(ledger.fixed_text(r("mean", 1)), F.lit(" ± "), ledger.fixed_text(r("sd", 1))))
    joined = rows.join(chosen.select("region", "leader", F.col("model").alias("chosen")), "region").withColumn("verdict", F.lit(verdict))
    reason = F.when(F.col("chosen") == F.col("leader"), "lowest mean").otherwise(F.concat(F.lit("within a deviation of "), "leader", F.lit(", and cheaper")))
    return joined.select("region", "model", text.alias("error"), F.col("place").cast("long").alias("place"), F.when(F.col("model") == F.col("chosen"), reason).otherwise("").alias("pick"), "verdict")


# Audit and residuals.

_A0 = """a0 AS (SELECT event_id AS arrival, k, CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN event_id % 31 = 0 THEN NULL ELSE value END AS value, event_id % 31 = 0 AND value IS NOT NULL OR value IS NULL AND event_id % 31 = 0 AS broken FROM ev),
a1 AS (SELECT * FROM a0 UNION ALL SELECT * FROM a0 WHERE arrival % 50 = 0 UNION ALL SELECT arrival + 1000000, k, ts, 1.5, false FROM a0 WHERE arrival % 70 = 1),
a2 AS (SELECT DISTINCT arrival, k, ts, value FROM a1 WHERE ts IS NOT NULL), a3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, ts ORDER BY arrival) AS r FROM a2) WHERE r = 1),
g3 AS (SELECT k, epoch_us(ts) + 1799999999 - (epoch_us(ts) + 1799999999) % 1800000000 AS slot FROM a3 WHERE value IS NOT NULL GROUP BY ALL)"""
_CHECKS = {
    "rows read": "SELECT k, count(*)::VARCHAR AS v FROM a1 GROUP BY k",
    "required columns present": "SELECT DISTINCT k, 'yes' AS v FROM a1",
    "unreadable values": "SELECT k, count(*) FILTER (WHERE broken)::VARCHAR AS v FROM a1 GROUP BY k",
    "unreadable times": "SELECT k, count(*) FILTER (WHERE ts IS NULL)::VARCHAR AS v FROM a1 GROUP BY k",
    "out of order": "SELECT k, count(*) FILTER (WHERE ts < b)::VARCHAR AS v FROM (SELECT k, ts, lag(ts) OVER (PARTITION BY k ORDER BY arrival) AS b FROM (SELECT DISTINCT arrival, k, ts FROM a1 WHERE ts IS NOT NULL)) GROUP BY k",
    "exact duplicates": "SELECT k, (count(*) - count(DISTINCT (arrival, ts, value)))::VARCHAR AS v FROM a1 WHERE ts IS NOT NULL GROUP BY k",
    "conflicting rows": "SELECT k, count(*) FILTER (WHERE c > 1)::VARCHAR AS v FROM (SELECT k, count(*) OVER (PARTITION BY k, ts) AS c FROM a2) GROUP BY k",
    "missing values": "SELECT k, count(*) FILTER (WHERE value IS NULL)::VARCHAR AS v FROM a3 GROUP BY k",
    "irregular steps": "SELECT k, count(*) FILTER (WHERE d <> 1800000000)::VARCHAR AS v FROM (SELECT k, slot - lag(slot) OVER (PARTITION BY k ORDER BY slot) AS d FROM g3) GROUP BY k",
    "negative values": "SELECT k, count(*) FILTER (WHERE value < 0)::VARCHAR AS v FROM a3 GROUP BY k",
    "range of values": "SELECT k, printf('%.1f to %.1f', min(value), max(value)) AS v FROM a3 GROUP BY k",
    "first and last": "SELECT k, strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') AS v FROM a3 GROUP BY k",
    "rows after cleaning": "SELECT k, count(*)::VARCHAR AS v FROM a3 GROUP BY k",
    "half hours with data": "SELECT k, count(*)::VARCHAR AS v FROM g3 GROUP BY k",
    "empty half hours": "SELECT k, ((max(slot) - min(slot)) // 1800000000 + 1 - count(*))::VARCHAR AS v FROM g3 GROUP BY k",
    "kinds of rows": "SELECT 'all' AS k, string_agg(k || ' (' || n || ')', ', ' ORDER BY k) AS v FROM (SELECT k, count(*) AS n FROM a3 GROUP BY k)",
}


@query("rp_audit", f", {_A0} " + " UNION ALL ".join(f"SELECT k, '{name}' AS \"check\", v FROM ({sql})" for name, sql in _CHECKS.items()))
def rp_audit(spark, sf_dir):
    """Sixteen checks of each region's raw readings, as text."""
    raw = clean.require(scans._dirty(spark, sf_dir), ["arrival", "k", "ts", "value"])
    dated = clean.coerced(raw, ["value"], ["ts"])
    once = dated.dropDuplicates()
    kept, _ = written(clean.keep_first(once, ["k", "ts"], "arrival"), "kept")
    grid = S.regrid(kept, "k", "ts", "value")
    n = lambda c: F.count_if(c).cast("string")
    value = F.col("value")
    one = F.count("*").cast("string")
    parts = {
        "rows read": raw.groupBy("k").agg(one.alias("v")),
        "required columns present": raw.select("k", F.lit("yes").alias("v")).distinct(),
        "unreadable values": raw.groupBy("k").agg(n(value.isNotNull() & value.try_cast("double").isNull()).alias("v")),
        "unreadable times": raw.groupBy("k").agg(n(F.col("ts").try_cast("timestamp_ntz").isNull()).alias("v")),
        "out of order": clean.out_of_order(dated.select("arrival", "k", "ts").distinct(), "k", "ts", "arrival").select("k", F.col("out_of_order").cast("string").alias("v")),
        "exact duplicates": dated.groupBy("k").agg(F.count("*").alias("a")).join(once.groupBy("k").agg(F.count("*").alias("b")), "k").select("k", (F.col("a") - F.col("b")).cast("string").alias("v")),
        "conflicting rows": once.withColumn("c", F.count("*").over(Window.partitionBy("k", "ts"))).groupBy("k").agg(n(F.col("c") > 1).alias("v")),
        "missing values": kept.groupBy("k").agg(n(value.isNull()).alias("v")),
        "irregular steps": grid.withColumn("d", F.col("slot") - F.lag("slot").over(Window.partitionBy("k").orderBy("slot"))).groupBy("k").agg(n(F.col("d") != S.HALF_HOUR).alias("v")),
        "negative values": kept.groupBy("k").agg(n(value < 0).alias("v")),
        "range of values": kept.groupBy("k").agg(F.concat(ledger.fixed_text(F.min("value")), F.lit(" to "), ledger.fixed_text(F.max("value"))).alias("v")),
        "first and last": kept.groupBy("k").agg(F.concat(F.date_format(F.min("ts"), "yyyy-MM-dd"), F.lit(" to "), F.date_format(F.max("ts"), "yyyy-MM-dd")).alias("v")),
        "rows after cleaning": kept.groupBy("k").agg(one.alias("v")),
        "half hours with data": grid.groupBy("k").agg(one.alias("v")),
        "empty half hours": grid.groupBy("k").agg((F.expr(f"(max(slot) - min(slot)) div {S.HALF_HOUR}") + 1 - F.count("*")).cast("string").alias("v")),
        "kinds of rows": kept.groupBy("k").agg(F.count("*").alias("n")).agg(F.lit("all").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: F.concat(x["k"], F.lit(" ("), x["n"], F.lit(")"))), ", ").alias("v")),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select("k", F.lit(name).alias("check"), "v")
        out = rows if out is None else out.unionByName(rows)
    return out


def _spread_sql(value: str, group: str) -> str:
    return f"SELECT split, max(m) - min(m) AS v FROM (SELECT split, {group} AS g, avg({value}) AS m FROM rs GROUP BY ALL) GROUP BY split"


_QC = [(f"{name}_{side}", _spread_sql(v, g)) for name, g in (("month", "month(day)"), ("weekday", "isodow(day)")) for side, v in (("before", "y"), ("after", "e"))]
_QC += [(f"autocorr_{n}_{side}", f"SELECT split, corr(v, u) AS v FROM (SELECT split, {v} AS v, lag({v}, {n}) OVER (PARTITION BY split ORDER BY day) AS u FROM rs) WHERE u IS NOT NULL GROUP BY split") for n in (1, 7) for side, v in (("before", "y"), ("after", "e"))]


@query("rp_resid_qc", f", {scans._PROFILE}, rs AS (SELECT day, y, y - expected AS e, CASE WHEN day < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split FROM res) " + " UNION ALL ".join(f"SELECT split, '{name}' AS measure, round(v, 4) AS v FROM ({sql})" for name, sql in _QC))
def rp_resid_qc(spark, sf_dir):
    """Monthly amplitude, weekday spread and autocorrelation before and after the training span's profile is taken out."""
    days, fitted = scans._fit(spark, sf_dir)
    rows, _ = written(profile.apply(days, fitted).withColumn("split", F.when(F.col("day") < F.lit("1999-01-01").cast("date"), "train").otherwise("test")), "residuals")
    w, out = Window.partitionBy("split").orderBy("day"), None
    for side, v in (("before", "y"), ("after", "residual")):
        parts = [(f"{name}_{side}", rows.groupBy("split", g.alias("g")).agg(F.avg(v).alias("m")).groupBy("split").agg((F.max("m") - F.min("m")).alias("v"))) for name, g in (("month", F.month("day")), ("weekday", F.weekday("day")))]
        lagged = rows.withColumns({f"u{n}": F.lag(v, n).over(w) for n in (1, 7)})
        parts += [(f"autocorr_{n}_{side}", lagged.filter(f"u{n} IS NOT NULL").groupBy("split").agg(F.corr(v, f"u{n}").alias("v"))) for n in (1, 7)]
        for name, part in parts:
            part = part.select("split", F.lit(name).alias("measure"), r("v", 4).alias("v"))
            out = part if out is None else out.unionByName(part)
    return out


_WK = f"""hs AS (SELECT slot, y, split, {scans._SD} AS d, isodow(ts) - 1 AS wd, (hour(ts) * 2 + minute(ts) // 30)::INT AS hh FROM (SELECT *, dayofyear(ts) AS doy, (year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0)) AS leap FROM (SELECT slot, round(avg(y), 6) AS y, min(split) AS split, make_timestamp(slot) AS ts FROM s GROUP BY slot))),
ht AS (SELECT * FROM hs WHERE split = 'train'),
hl AS (SELECT q.d, l.level FROM (SELECT unnest(range(1, 366))::DOUBLE AS d) q LEFT JOIN (SELECT d, avg(y) AS level FROM ht WHERE d <> 59.5 GROUP BY d) l USING (d)),
hf AS (SELECT d, coalesce(level, v0 + (v1 - v0) * (d - p0) / nullif(p1 - p0, 0), v0, v1) AS level FROM (SELECT d, level, last_value(level IGNORE NULLS) OVER b AS v0, first_value(level IGNORE NULLS) OVER a AS v1,
  last_value(CASE WHEN level IS NOT NULL THEN d END IGNORE NULLS) OVER b AS p0, first_value(CASE WHEN level IS NOT NULL THEN d END IGNORE NULLS) OVER a AS p1 FROM hl WINDOW b AS (ORDER BY d ROWS UNBOUNDED PRECEDING), a AS (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),
hm AS (SELECT a.d, avg(b.level) AS smooth FROM hf a JOIN hf b ON ((b.d - a.d + 15)::INT % 365 + 365) % 365 <= 30 GROUP BY a.d),
ha AS (SELECT d, smooth / (SELECT avg(smooth) FROM hm) AS f FROM hm),
hw AS (SELECT wd, hh, avg(y / ((a.f + b.f) / 2)) AS level FROM ht JOIN ha a ON a.d = floor(ht.d) JOIN ha b ON b.d = ceil(ht.d) GROUP BY wd, hh),
hr AS (SELECT slot, y, (a.f + b.f) / 2 * level AS expected FROM hs JOIN ha a ON a.d = floor(hs.d) JOIN ha b ON b.d = ceil(hs.d) JOIN hw USING (wd, hh))"""


@query("ev_profile_weekly", f", {_WK} SELECT slot, round(expected, 4) AS expected, round(y - expected, 4) AS residual FROM hr")
def ev_profile_weekly(spark, sf_dir):
    """The half-hourly mean over all series without its annual and weekly profile; half hours of the week that the training
    span lacks are left out before, as the profile refuses them."""
    rows = C.stream(spark, sf_dir).groupBy("slot").agg(r(F.avg("y")).alias("y"), F.min("split").alias("split")).withColumn("ts", S.at("slot"))
    fitted = profile.fit(rows.filter("split = 'train'"), by_slot=True)
    known = profile._keyed(rows, "ts", True).withColumnRenamed("slot", "half").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "y", "ts", "weekday", "half")
    known = known.join(fitted.weekly.select("weekday", F.col("slot").alias("half")), ["weekday", "half"], "left_semi").select("us", "ts", "y")
    out = profile.apply(known, fitted)
    return out.select(F.col("us").alias("slot"), r("expected", 4).alias("expected"), r("residual", 4).alias("residual"))


# Figures.

_SYN = "SELECT 'synthetic ' || kind AS panel, kind AS k, t AS at, round(20 + 5 * sin(2 * pi() * t / 48) + CASE kind WHEN 'none' THEN 0 WHEN 'sudden' THEN CASE WHEN t >= 500 THEN 8 ELSE 0 END WHEN 'gradual' THEN 8 * least(1, greatest(0, (t - 500) / 500.0)) ELSE CASE WHEN t >= 666 AND t < 1333 THEN 8 ELSE 0 END END, 6) AS y, CASE kind WHEN 'none' THEN false WHEN 'sudden' THEN t = 500 WHEN 'gradual' THEN t IN (500, 1000) ELSE t IN (666, 1333) END AS marked FROM (SELECT unnest(range(2000)) AS t), (VALUES ('none'), ('sudden'), ('gradual'), ('recurring')) v(kind)"


@query("rp_f2", f"SELECT 'stream' AS panel, s.k, slot AS at, y, a.us IS NOT NULL AS marked FROM s LEFT JOIN alarm a ON a.k = s.k AND a.us = s.slot UNION ALL {_SYN}")
def rp_f2(spark, sf_dir):
    """Panels of series with what is marked in them: alarms in the streams, change points in the synthetic series."""
    alarms = C.alarms(spark, sf_dir).select("k", F.col("us").alias("slot"), F.lit(True).alias("m"))
    out = C.ev30(spark, sf_dir).join(alarms, ["k", "slot"], "left").select(F.lit("stream").alias("panel"), "k", F.col("slot").alias("at"), "y", F.coalesce("m", F.lit(False)).alias("marked"))
    for kind in ("none", "sudden", "gradual", "recurring"):
        rows, points = S.synthetic(spark, kind, 2000)
        out = out.unionByName(rows.select(F.lit(f"synthetic {kind}").alias("panel"), F.lit(kind).alias("k"), F.col("t").alias("at"), r("y").alias("y"), F.col("t").isin(points).alias("marked")))
    return out


_ROLL48 = _roll("abs(y - p)", "fc", 48)


@query("rp_f3", f", {sequential._H} SELECT 'curve' AS part, NULL::VARCHAR AS k, slot AS at, round(avg(rolling), 6) AS mean, round(stddev_samp(rolling), 6) AS sd FROM ({_ROLL48}) WHERE rolling IS NOT NULL GROUP BY slot UNION ALL SELECT 'rug', k, day, NULL, NULL FROM tg JOIN ends USING (k) WHERE day >= a AND day < b")
def rp_f3(spark, sf_dir):
    """The arms' rolling error, mean and deviation over series, and a rug of the days on which they refit."""
    rows = C.forecasts(spark, sf_dir).withColumn("rolling", windows.rolling_mean(metrics.error(), 48)).filter("rolling IS NOT NULL")
    curve = rows.groupBy("slot").agg(r(F.avg("rolling")).alias("mean"), r(F.stddev_samp("rolling")).alias("sd"))
    curve = curve.select(F.lit("curve").alias("part"), F.lit(None).cast("string").alias("k"), F.col("slot").alias("at"), "mean", "sd")
    none = F.lit(None).cast("double")
    return curve.unionByName(sequential.ad_triggers(spark, sf_dir).select(F.lit("rug").alias("part"), "k", F.col("day").alias("at"), none.alias("mean"), none.alias("sd")))


@query("rp_f4", "SELECT 'span' AS part, k, min(slot) AS at, max(slot) + 1800000000 AS stop, NULL::DOUBLE AS coverage FROM (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY pos) AS run FROM (SELECT *, (regime IS DISTINCT FROM lag(regime) OVER (PARTITION BY k ORDER BY pos))::INT AS c FROM lab)) WHERE regime = 'drift' GROUP BY k, run UNION ALL SELECT 'curve', k, slot, NULL, round(CASE WHEN n = 48 THEN m END, 6) FROM (SELECT k, slot, count(*) OVER w AS n, avg((y BETWEEN lower AND upper)::INT) OVER w AS m FROM iv WINDOW w AS (PARTITION BY k ORDER BY pos ROWS 47 PRECEDING)) WHERE n = 48")
def rp_f4(spark, sf_dir):
    """Rolling coverage of each series and the spans of drift behind it."""
    spans = windows.islands(C.labelled(spark, sf_dir), "regime").filter("regime = 'drift'")
    spans = spans.select(F.lit("span").alias("part"), "k", F.col("start").alias("at"), "stop", F.lit(None).cast("double").alias("coverage"))
    rolling = windows.rolling_mean(metrics.covered().cast("double"), 48)
    curve = C.intervals(spark, sf_dir).select(F.lit("curve").alias("part"), "k", F.col("slot").alias("at"), F.lit(None).cast("long").alias("stop"), r(rolling).alias("coverage"))
    return spans.unionByName(curve.filter("coverage IS NOT NULL"))


@query("rp_f5", f", {_CR}, pt AS (SELECT k, regime, review_rate, max(kept) AS kept, arg_max(retained_coverage, threshold) AS c FROM cr GROUP BY k, regime, review_rate) SELECT g.k, g.regime, g.rate, round(CASE WHEN arg_max(kept, review_rate) >= 48 THEN arg_max(c, review_rate) END, 6) AS coverage FROM (SELECT k, regime, i / 1000.0::DOUBLE AS rate FROM (SELECT DISTINCT k, regime FROM scored), (SELECT unnest(range(1001)) AS i)) g JOIN pt ON pt.k = g.k AND pt.regime = g.regime AND (c IS NOT NULL OR kept = 0) AND review_rate <= g.rate + 1e-12 GROUP BY g.k, g.regime, g.rate")
def rp_f5(spark, sf_dir):
    """Retained coverage by regime on a grid of review rates of a thousandth each: as of the greatest attainable rate, null
    where fewer than 48 forecasts are kept."""
    scored = C.scored(spark, sf_dir)
    points = escalation.curve_by_group(scored, "regime").groupBy("k", "regime", F.col("review_rate").alias("at")).agg(F.max("kept").alias("kept"), F.max_by("retained_coverage", "threshold").alias("c"))
    grid = scored.select("k", "regime").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(1000)))).select("k", "regime", (F.col("i") / 1000.0).alias("rate"))
    none = F.lit(None)
    both = points.select("k", "regime", "at", F.struct("kept", "c").alias("point"), none.cast("double").alias("rate")).unionByName(
        grid.select("k", "regime", (F.col("rate") + 1e-12).alias("at"), none.cast("struct<kept: bigint, c: double>").alias("point"), "rate")
    )
    w = Window.partitionBy("k", "regime").orderBy("at", F.col("rate").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last", F.last("point", ignorenulls=True).over(w)).filter("rate IS NOT NULL AND last IS NOT NULL")
    return seen.select("k", "regime", "rate", r(F.when(F.col("last.kept") >= 48, F.col("last.c"))).alias("coverage"))


_BAND = S.DAY // 8


@query("rp_f6", f"SELECT 'click' AS side, us FROM alarm a WHERE k = 'click' AND NOT EXISTS (SELECT 1 FROM alarm b WHERE b.k = 'view' AND abs(a.us - b.us) <= {_BAND}) UNION ALL SELECT 'view', us FROM alarm a WHERE k = 'view' AND NOT EXISTS (SELECT 1 FROM alarm b WHERE b.k = 'click' AND abs(a.us - b.us) <= {_BAND})")
def rp_f6(spark, sf_dir):
    """Alarms of either side that the other side has none near: an equi join on cells of the band's width and their neighbours."""
    rows = C.alarms(spark, sf_dir)
    out = None
    for mine, other in (("click", "view"), ("view", "click")):
        a = rows.filter(F.col("k") == mine).withColumn("cell", F.expr(f"us div {_BAND}"))
        b = rows.filter(F.col("k") == other).select(F.col("us").alias("o"), F.explode(F.expr(f"sequence(us div {_BAND} - 1, us div {_BAND} + 1)")).alias("cell"))
        one = a.join(b, (a.cell == b.cell) & (F.abs(a.us - b.o) <= _BAND), "left_anti").select(F.lit(mine).alias("side"), "us")
        out = one if out is None else out.unionByName(one)
    return out


@query("rp_agaci_diag")
def rp_agaci_diag(spark, sf_dir):
    """The adaptive intervals' daily widths beside the cap that replaces an infinite radius: twice the greatest error in the
    buffer before each forecast. near_cap: share of widths within a tenth of the widest interval that the cap allows."""
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(-conformal.BUFFER, -1)
    caps = C.forecasts(spark, sf_dir).filter("split <> 'train'").select("k", "slot", (2 * F.max(metrics.error()).over(w)).alias("cap"))
    width = F.col("upper") - F.col("lower")
    rows = sequential.uq_agaci(spark, sf_dir).withColumn("width", width).join(caps, ["k", "slot"])
    near = (F.col("width") >= 0.9 * 2 * F.col("cap")).cast("double")
    return rows.groupBy("k", F.to_date(S.at("slot")).alias("day")).agg(r(F.percentile("width", 0.5)).alias("median"), r(F.min("width")).alias("low"), r(F.max("width")).alias("high"), r(F.max("cap")).alias("cap"), r(F.avg(near)).alias("near_cap"))


@query("rp_ui_findings", "SELECT region, 'best' AS finding, printf('%s: %.1f', arg_min(model, (m, model)), min(m)) AS headline FROM (SELECT region, model, round(avg(mae), 2) AS m FROM runs GROUP BY ALL) GROUP BY region UNION ALL SELECT region, 'retraining', CASE WHEN max(m) FILTER (WHERE arm = 'C') < max(m) FILTER (WHERE arm = 'A') THEN 'triggered retraining helps' ELSE 'triggered retraining does not help' END FROM (SELECT region, arm, round(avg(mae), 2) AS m FROM runs GROUP BY ALL) GROUP BY region UNION ALL SELECT region, 'cost', printf('%d retrains over %d runs', sum(n_retrains)::BIGINT, count(*)) FROM runs GROUP BY region")
def rp_ui_findings(spark, sf_dir):
    """Headlines for each region: the best model, whether triggered retraining helps, what it costs."""
    runs = C.runs(spark, sf_dir)
    best = runs.groupBy("region", "model").agg(r(F.avg("mae"), 2).alias("m")).groupBy("region").agg(F.lit("best").alias("finding"), F.concat(F.min_by("model", F.struct("m", "model")), F.lit(": "), ledger.fixed_text(F.min("m"))).alias("headline"))
    arms = runs.groupBy("region", "arm").agg(r(F.avg("mae"), 2).alias("m")).groupBy("region")
    helps = F.max(F.when(F.col("arm") == "C", F.col("m"))) < F.max(F.when(F.col("arm") == "A", F.col("m")))
    gain = arms.agg(F.lit("retraining").alias("finding"), F.when(helps, "triggered retraining helps").otherwise("triggered retraining does not help").alias("headline"))
    cost = runs.groupBy("region").agg(F.lit("cost").alias("finding"), F.format_string("%d retrains over %d runs", F.sum("n_retrains"), F.count("*")).alias("headline"))
    return best.unionByName(gain).unionByName(cost)


# Ledger rows.

_ROWS = f"""fr AS (SELECT k, NULL::VARCHAR AS regime, metric_name, metric_value FROM (SELECT k, avg(abs(y - p)) AS mae, avg(abs(y - p)) / 2 AS pinball FROM fc GROUP BY k) UNPIVOT (metric_value FOR metric_name IN (mae, pinball))),
rr AS (SELECT k, regime, metric_name, metric_value FROM (SELECT k, regime, avg(abs(y - p)) AS mae, avg((y BETWEEN lower AND upper)::INT) AS coverage, avg(upper - lower) AS width FROM ivl GROUP BY ALL) UNPIVOT (metric_value FOR metric_name IN (mae, coverage, width))),
dr AS (SELECT k, NULL::VARCHAR AS regime, metric_name, metric_value FROM (SELECT k, count(*)::DOUBLE AS raw, (count(*) FILTER (WHERE label <> 'Ignored'))::DOUBLE AS accepted, (count(*) FILTER (WHERE label = 'Match'))::DOUBLE AS matched, (count(*) FILTER (WHERE label = 'Unmatch'))::DOUBLE AS unmatched FROM al GROUP BY k) UNPIVOT (metric_value FOR metric_name IN (raw, accepted, matched, unmatched)) UNION ALL SELECT k, NULL, 'delay_' || event_id, delay FROM al WHERE label = 'Match')"""


@query("ux_rows", f", {_GREEDY}, {_ROWS} SELECT kind, k, regime, metric_name, round(metric_value, 6) AS metric_value FROM (SELECT 'forecast' AS kind, * FROM fr UNION ALL SELECT 'regime', * FROM rr UNION ALL SELECT 'detection', * FROM dr)")
def ux_rows(spark, sf_dir):
    parts = {
        "forecast": ledger.forecast_rows(C.forecasts(spark, sf_dir), ["k"]),
        "regime": ledger.regime_rows(C.labelled_intervals(spark, sf_dir), ["k"]),
        "detection": ledger.detection_rows(sequential._matches(spark, sf_dir), ["k"]),
    }
    out = None
    for kind, rows in parts.items():
        rows = rows.select(F.lit(kind).alias("kind"), "k", "regime", "metric_name", r("metric_value").alias("metric_value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("ux_record_run", f", {_GREEDY}, {_ROWS} SELECT method, split_id, metric_name, count(*) AS n, round(sum(metric_value), 4) AS total FROM (SELECT 'naive' AS method, 'forecast_v1' AS split_id, * FROM fr UNION ALL SELECT 'deviation', 'detect_deviation_v1', * FROM dr) GROUP BY ALL")
def ux_record_run(spark, sf_dir):
    """Two runs recorded in a ledger and read back: one a forecast, one a detection; what is both or neither is refused."""
    folder = shared_folder(spark, "ledger")
    forecasts, matches = C.forecasts(spark, sf_dir), sequential._matches(spark, sf_dir)
    for both in ({}, {"forecasts": forecasts, "matches": matches}):
        try:
            ledger.record(**both)
        except ValueError:
            continue
        raise AssertionError("a run that is both or neither was recorded")
    for method, name, run in (("naive", "forecast_v1", {"forecasts": forecasts}), ("deviation", ledger.split_id("detect", "deviation"), {"matches": matches})):
        none = F.lit(None)
        rows = ledger.record(**run).select(
            F.lit("a").alias("group"), F.lit(method).alias("method"), F.lit("events").alias("dataset"), F.col("k").alias("region"), none.cast("int").alias("seed"), F.lit(ledger.config_hash({"method": method})).alias("config_hash"), F.lit(name).alias("split_id"),
            "metric_name", "metric_value", "regime", F.lit(0).cast("long").alias("n_retrains"), F.lit(0).cast("long").alias("train_samples"), F.lit(0.0).alias("wall_clock_s"), S.at(F.lit(S.stamp("2024-02-01"))).alias("timestamp"),
        )
        ledger.append(rows, folder)
    return ledger.read(spark, folder).groupBy("method", "split_id", "metric_name").agg(F.count("*").alias("n"), r(F.sum("metric_value"), 4).alias("total"))


@query("ux_trigger_ids", "SELECT kind, split_id, n FROM (VALUES ('adapt', 'adapt_adwin_v1', 1), ('uq', 'uq_adwin_v1', 1), ('uq', 'uq_v1', 1), ('uq', 'uq_kswin_v1', 0), ('escalation', 'escalation_adwin_v1', 1), ('escalation', 'escalation_v1', 1), ('escalation', 'escalation_adwin_score_v1', 0)) v(kind, split_id, n) WHERE n = 1")
def ux_trigger_ids(spark, sf_dir):
    """Of rows logged under all sorts of names, those that a detector's readers accept: its own and the former ones."""
    logged = spark.createDataFrame([(x,) for x in ("adapt_adwin_v1", "uq_adwin_v1", "uq_v1", "uq_kswin_v1", "escalation_adwin_v1", "escalation_v1", "escalation_adwin_score_v1")], "split_id string")
    out = None
    for kind in ("adapt", "uq", "escalation"):
        rows = logged.filter(F.col("split_id").isin(*ledger.readable_ids(ledger.split_id(kind, "adwin")))).select(F.lit(kind).alias("kind"), "split_id", F.lit(1).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("ux_rescore", "SELECT regime, k, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(avg((y BETWEEN lower AND upper)::INT), 6) AS coverage FROM ivl GROUP BY ALL")
def ux_rescore(spark, sf_dir):
    """Forecasts that were saved without labels, labelled and scored anew."""
    saved, _ = written(C.intervals(spark, sf_dir), "saved")
    rows = regimes.global_regimes(saved, C.overlapping(spark, sf_dir))
    return rows.groupBy("regime", "k").agg(F.count("*").alias("n"), r(metrics.mae()).alias("mae"), r(metrics.coverage()).alias("coverage"))


# Functions.


@query("fn_complex", "SELECT k, round(sqrt(c * c + q * q), 6) AS modulus, round(atan2(q, c), 6) AS argument, round(c * c - q * q, 6) AS re2, round(2 * c * q, 6) AS im2 FROM (SELECT k, avg(cos(2 * pi() * (pos % 48) / 48)) AS c, avg(sin(2 * pi() * (pos % 48) / 48)) AS q FROM s WHERE y > 50 GROUP BY k)")
def fn_complex(spark, sf_dir):
    """The mean of unit numbers, its modulus, argument and square."""
    angle = 2 * F.pi() * F.pmod("pos", F.lit(48)) / 48
    mean = C.stream(spark, sf_dir).filter("y > 50").groupBy("k").agg(F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("q"))
    c, q = F.col("c"), F.col("q")
    return mean.select("k", r(F.sqrt(c * c + q * q)).alias("modulus"), r(F.atan2(q, c)).alias("argument"), r(c * c - q * q).alias("re2"), r(2 * c * q).alias("im2"))


@query("fn_array", "SELECT k, day, len(a) AS n, a[1] AS first, a[-1] AS last, round(list_sum(a[1:3]), 6) AS head, len(list_distinct(a)) AS different, list_contains(a, a[1]) AS own FROM (SELECT k, slot - slot % 86400000000 AS day, list(y ORDER BY y) AS a FROM s GROUP BY ALL)")
def fn_array(spark, sf_dir):
    """A day's values as an array: sorted, cut, summed up."""
    rows = C.stream(spark, sf_dir).groupBy("k", (F.col("slot") - F.col("slot") % S.DAY).alias("day")).agg(F.array_sort(F.collect_list("y")).alias("a"))
    total = F.aggregate(F.slice("a", 1, 3), F.lit(0.0), lambda s, x: s + x)
    return rows.select("k", "day", F.size("a").alias("n"), F.get("a", F.lit(0)).alias("first"), F.element_at("a", -1).alias("last"), r(total).alias("head"), F.size(F.array_distinct("a")).alias("different"), F.array_contains("a", F.get("a", F.lit(0))).alias("own"))


@query("fn_random", "SELECT true AS repeats, true AS differs, true AS centred")
def fn_random(spark, sf_dir):
    """Seeded normal noise: one seed gives one series, another seed another one, and both are centred."""
    draw = lambda seed: S.synthetic(spark, "none", 20_000, 1.0, seed)[0]
    clean_rows = S.synthetic(spark, "none", 20_000)[0].withColumnRenamed("y", "clean")
    rows = draw(1).withColumnRenamed("y", "a").join(draw(1).withColumnRenamed("y", "b"), "t").join(draw(2).withColumnRenamed("y", "c"), "t").join(clean_rows, "t")
    noise = F.col("a") - F.col("clean")
    centred = (F.abs(F.avg(noise)) < 0.05) & (F.abs(F.stddev_pop(noise) - 1) < 0.05)
    return rows.agg(F.bool_and(F.col("a") == F.col("b")).alias("repeats"), (F.count_if(F.col("a") == F.col("c")) < 10).alias("differs"), centred.alias("centred"))
