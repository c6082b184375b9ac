"""Queries on order-dependent operators: detectors, matching, replay, retraining, streaming."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.operators import adapt, boosting, conformal, detectors, forecast, harmonic, injection, matching, metrics, regimes, spread, tuning
from tidemark.plans import streams as C
from tidemark.plans.registry import query
from tidemark.plans.reports import _cell, _cells, _coverage_table, _text
from tidemark.plans.scans import r
from tidemark.sources import series as S
from tidemark.sources.shared import written
from tidemark.sources.shipping import ship_package
from tidemark.streaming import stateful, structured

_R = C.REFRACTORY
_KEPT = f"kept AS (SELECT k, min(us) AS us FROM alarm GROUP BY k UNION ALL SELECT d.k, min(a.us) FROM kept d JOIN alarm a ON a.k = d.k AND a.us >= d.us + {_R} GROUP BY d.k)"


@query("sq_debounce", f", {_KEPT} SELECT a.k, a.us, d.us IS NOT NULL AS accepted FROM alarm a LEFT JOIN kept d USING (k, us)")
def sq_debounce(spark, sf_dir):
    return matching.debounced(C.alarms(spark, sf_dir), refractory=_R).select("k", "us", "accepted")


def _matches(spark, sf_dir):
    ship_package(spark)
    return matching.match_alarms(C.alarms(spark, sf_dir), C.key_windows(spark, sf_dir), _R)


# Greedy one-to-one matching as a recursion over the events of a key, in order, with the alarms used so far.
_GREEDY = f"""{_KEPT},
ord AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, drift_start, event_id) AS i FROM kwin),
gm AS (SELECT DISTINCT k, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS hit FROM ord
 UNION ALL SELECT k, i, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, hit FROM (
  SELECT g.k, o.i, any_value(g.used) AS used, min(d.us) FILTER (WHERE d.us >= o.drift_start AND d.us < o.match_end AND NOT list_contains(g.used, d.us)) AS hit
  FROM gm g JOIN ord o ON o.k = g.k AND o.i = g.i + 1 LEFT JOIN kept d ON d.k = g.k GROUP BY g.k, o.i)),
ma AS (SELECT g.k, g.hit AS us, 'Match' AS label, o.event_id, o.tier, (g.hit - o.drift_start) / {float(S.DAY)} AS delay FROM gm g JOIN ord o USING (k, i) WHERE hit IS NOT NULL),
al AS (SELECT * FROM ma UNION ALL SELECT k, us, CASE WHEN us IN (SELECT us FROM kept d WHERE d.k = a.k) THEN 'Unmatch' ELSE 'Ignored' END, NULL, NULL, NULL FROM alarm a WHERE NOT EXISTS (SELECT 1 FROM ma WHERE ma.k = a.k AND ma.us = a.us))"""


@query("ev_match", f", {_GREEDY} SELECT k, us, label, event_id, tier, round(delay, 6) AS delay_days FROM al")
def ev_match(spark, sf_dir):
    return _matches(spark, sf_dir).withColumn("delay_days", r("delay_days"))


@query("sq_greedy_match", f", {_GREEDY} SELECT k, us, event_id FROM al WHERE label = 'Match'")
def sq_greedy_match(spark, sf_dir):
    return _matches(spark, sf_dir).filter("label = 'Match'").select("k", "us", "event_id")


@query("snk_artifacts", f", {_GREEDY} SELECT 'accepted' AS kind, count(*) FILTER (WHERE label <> 'Ignored') AS n FROM al UNION ALL SELECT 'raw', count(*) FROM al UNION ALL SELECT 'assigned', count(*) FILTER (WHERE label = 'Match') FROM al")
def snk_artifacts(spark, sf_dir):
    from tidemark.sources.shared import written

    rows, _ = written(_matches(spark, sf_dir), "matches")
    out = rows.agg(F.count("*").alias("raw"), F.count_if(F.col("label") != "Ignored").alias("accepted"), F.count_if(F.col("label") == "Match").alias("assigned"))
    return out.unpivot([], ["raw", "accepted", "assigned"], "kind", "n")


@query("src_changepoints", f", {_KEPT} SELECT k, us, make_timestamp(us)::DATE AS day, us % {S.DAY} = 0 AS midnight FROM kept")
def src_changepoints(spark, sf_dir):
    kept = matching.debounced(C.alarms(spark, sf_dir), refractory=_R).filter("accepted")
    return kept.select("k", "us", F.to_date(S.at("us")).alias("day"), (F.col("us") % S.DAY == 0).alias("midnight"))


@query("agg_event_metrics", f""", {_GREEDY} SELECT k, count(*) AS raw, count(*) FILTER (WHERE label <> 'Ignored') AS accepted, count(*) FILTER (WHERE label = 'Match') AS matched, count(*) FILTER (WHERE label = 'Unmatch') AS unmatched,
 round(avg(delay), 6) AS mean_delay, round(count(*) FILTER (WHERE label = 'Match') / nullif(count(*) FILTER (WHERE label <> 'Ignored'), 0)::DOUBLE, 6) AS precision,
 round(count(*) FILTER (WHERE label = 'Match') / any_value(e.events)::DOUBLE, 6) AS recall, round(count(*) FILTER (WHERE label = 'Match' AND tier = 1) / any_value(nullif(e.t1, 0))::DOUBLE, 6) AS recall_t1
 FROM al JOIN (SELECT k, count(*) AS events, count(*) FILTER (WHERE tier = 1) AS t1 FROM kwin GROUP BY k) e USING (k) GROUP BY k""")
def agg_event_metrics(spark, sf_dir):
    out = matching.event_metrics(_matches(spark, sf_dir), C.key_windows(spark, sf_dir))
    return out.withColumns({c: r(c) for c in ("mean_delay", "precision", "recall", "recall_t1")})


@query("rsh_wide_delay", f", {_GREEDY} SELECT k, 'delay_' || event_id AS metric_name, round(delay, 6) AS metric_value FROM al WHERE label = 'Match'")
def rsh_wide_delay(spark, sf_dir):
    rows = _matches(spark, sf_dir).filter("label = 'Match'")
    return rows.select("k", F.concat(F.lit("delay_"), "event_id").alias("metric_name"), r("delay_days").alias("metric_value"))


@query("ev_rows", f", {_GREEDY} SELECT k, 'accepted_per_year' AS metric_name, round(count(*) FILTER (WHERE label <> 'Ignored') / (30 / 365.0), 6) AS metric_value FROM al GROUP BY k UNION ALL SELECT k, 'raw', count(*)::DOUBLE FROM al GROUP BY k")
def ev_rows(spark, sf_dir):
    wide = _matches(spark, sf_dir).groupBy("k").agg(r(F.count_if(F.col("label") != "Ignored") / (30 / 365.0)).alias("accepted_per_year"), F.count("*").cast("double").alias("raw"))
    return wide.unpivot("k", ["accepted_per_year", "raw"], "metric_name", "metric_value")


# Detectors.


def _ph():
    return detectors.PageHinkley(min_instances=20, delta=0.05, threshold=60.0, alpha=0.99)


_PH = """ph AS (SELECT DISTINCT k, -1::BIGINT AS pos, 0 AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 'inf'::DOUBLE AS least, '-inf'::DOUBLE AS most, false AS fired FROM s
 UNION ALL SELECT k, pos, n, mean, up, down, least, most, n >= 20 AND (up - least > 60 OR most - down > 60) FROM (
  SELECT k, pos, n, mean, up, down, least(pl, up) AS least, greatest(pm, down) AS most FROM (
   SELECT k, pos, n, mean, pl, pm, 0.99::DOUBLE * pu + (y - mean) - 0.05::DOUBLE AS up, 0.99::DOUBLE * pd + (y - mean) + 0.05::DOUBLE AS down FROM (
    SELECT s.k, s.pos, s.y, CASE WHEN fired THEN 1 ELSE n + 1 END AS n, CASE WHEN fired THEN s.y ELSE mean + (s.y - mean) / (n + 1) END AS mean, CASE WHEN fired THEN 0 ELSE up END AS pu, CASE WHEN fired THEN 0 ELSE down END AS pd,
     CASE WHEN fired THEN 'inf'::DOUBLE ELSE least END AS pl, CASE WHEN fired THEN '-inf'::DOUBLE ELSE most END AS pm FROM ph JOIN s ON s.k = ph.k AND s.pos = ph.pos + 1))))"""


@query("sq_page_hinkley", f", {_PH} SELECT k, pos FROM ph WHERE fired")
def sq_page_hinkley(spark, sf_dir):
    ship_package(spark)
    return detectors.alarms(C.stream(spark, sf_dir), _ph).select("k", "pos")


@query("sq_detect_loop", f", {_PH} SELECT k, count(*) FILTER (WHERE fired) AS alarms FROM ph WHERE pos >= 0 GROUP BY k HAVING count(*) FILTER (WHERE fired) > 0")
def sq_detect_loop(spark, sf_dir):
    ship_package(spark)
    return detectors.alarms(C.stream(spark, sf_dir), _ph).groupBy("k").agg(F.count("*").alias("alarms"))


@query("sq_traces", f", {_PH} SELECT k, pos, CASE WHEN n >= 20 THEN round(greatest(up - least, most - down), 6) END AS statistic FROM ph WHERE pos >= 0")
def sq_traces(spark, sf_dir):
    ship_package(spark)
    return detectors.traces(C.stream(spark, sf_dir), _ph).select("k", "pos", r("statistic").alias("statistic"))


@query("sq_adwin")
def sq_adwin(spark, sf_dir):
    ship_package(spark)
    return detectors.alarms(C.stream(spark, sf_dir), lambda: detectors.Adwin(delta=0.3, clock=16, min_window_length=16)).select("k", "pos", "us")


@query("sq_kswin")
def sq_kswin(spark, sf_dir):
    ship_package(spark)
    return detectors.alarms(C.stream(spark, sf_dir), lambda: detectors.Kswin(alpha=0.01, window_size=144, stat_size=48)).select("k", "pos", "us")


# Detectors where the truth is known: shifts put into the streams' own residuals.

_INJECTED = f"""er AS (SELECT k, pos, y - p AS e FROM fc),
rs AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS pos, round(e / sd, 6) AS e FROM er JOIN (SELECT k, stddev_pop(e) AS sd FROM er GROUP BY k) USING (k) WHERE sd > 0),
sz AS (SELECT k, count(*) // 48 AS nb, count(*) // 48 * 48 AS n FROM rs GROUP BY k),
inj AS (SELECT t.k, kind, seed, sz.n, t.pos, round(o.e + 4.0 * CASE kind WHEN 'sudden' THEN (t.pos >= sz.n // 4)::INT WHEN 'gradual' THEN least(1.0, greatest(0.0, (t.pos - sz.n // 4) / greatest(1, least(1000, sz.n // 4))::DOUBLE))
  WHEN 'recurring' THEN (t.pos >= sz.n // 3 AND t.pos < 2 * sz.n // 3)::INT ELSE 0.0 END, 6) AS y
  FROM rs t JOIN sz ON sz.k = t.k AND t.pos < sz.n, unnest(range(1, 6)) AS u(seed), (VALUES ('none'), ('sudden'), ('gradual'), ('recurring')) v(kind), rs o
  WHERE o.k = t.k AND o.pos = (31 * (t.pos // 48) * (t.pos // 48) + 17 * (t.pos // 48) * seed + 7 * seed + 3) % nb * 48 + t.pos % 48),
sx AS (SELECT k || '|' || kind || '|' || seed AS k, pos, y FROM inj),
{_PH.replace("FROM s\n", "FROM sx\n").replace("JOIN s ON", "JOIN sx s ON")},
hd AS (SELECT k || '|' || kind || '|' || seed AS name, k, kind, seed, any_value(n) AS n FROM inj GROUP BY k, kind, seed),
ch AS (SELECT name, a, least(n - 1, b + least(336, n // 6)) AS b FROM (SELECT name, n, n // 4 AS a, n // 4 AS b FROM hd WHERE kind = 'sudden' UNION ALL SELECT name, n, n // 4, n // 4 + greatest(1, least(1000, n // 4)) FROM hd WHERE kind = 'gradual'
  UNION ALL SELECT name, n, n // 3, n // 3 FROM hd WHERE kind = 'recurring' UNION ALL SELECT name, n, 2 * n // 3, 2 * n // 3 FROM hd WHERE kind = 'recurring')),
al AS (SELECT k AS name, pos FROM ph WHERE fired),
mt AS (SELECT name, a, min(pos) - a AS delay FROM ch JOIN al USING (name) WHERE pos BETWEEN a AND b GROUP BY name, a),
sc AS (SELECT k, kind, seed, n, coalesce(m, 0) AS matched, coalesce(c, 0) - coalesce(m, 0) AS missed, coalesce(x, 0) - coalesce(m, 0) AS false_alarms, delay FROM hd
  LEFT JOIN (SELECT name, count(*) AS m, avg(delay) AS delay FROM mt GROUP BY ALL) USING (name) LEFT JOIN (SELECT name, count(*) AS c FROM ch GROUP BY ALL) USING (name) LEFT JOIN (SELECT name, count(*) AS x FROM al GROUP BY ALL) USING (name))"""


def _injected(spark, sf_dir):
    return injection.injected(injection.standard_residuals(C.forecasts(spark, sf_dir)))


def _injected_scores(spark, sf_dir, detectors_of):
    """Scores of each detector, by name, on every injected series."""
    ship_package(spark)
    series, _ = written(_injected(spark, sf_dir), "injected")
    heads = series.groupBy("k", "kind", "seed").agg(F.max("n").alias("n")).withColumn("changes", injection.changes(F.col("kind"), F.col("n")))
    rows = series.select(F.concat_ws("|", "k", "kind", "seed").alias("k"), "pos", F.col("pos").alias("slot"), "y")
    found = None
    for name, make in detectors_of.items():
        parts = F.split("k", r"\|")
        key = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), "|")
        one = detectors.alarms(rows, make).select(F.lit(name).alias("detector"), key.alias("k"), F.element_at(parts, -2).alias("kind"), F.element_at(parts, -1).cast("int").alias("seed"), "pos")
        found = one if found is None else found.unionByName(one)
    each = heads.withColumn("detector", F.explode(F.array(*map(F.lit, detectors_of))))
    return injection.scored(each, found, ["detector", "k", "kind", "seed"]).drop("false_per_year")


def _ph_scores(spark, sf_dir):
    return _injected_scores(spark, sf_dir, {"page_hinkley": _ph})


@query("src_injected", f", {_INJECTED} SELECT k, kind, seed, n, pos, y FROM inj")
def src_injected(spark, sf_dir):
    """The streams' residuals, drawn anew by blocks, with a shift at known places."""
    return _injected(spark, sf_dir)


@query("sq_injected_match", f", {_INJECTED} SELECT k, kind, seed, n, matched, missed, false_alarms, round(delay, 6) AS delay FROM sc")
def sq_injected_match(spark, sf_dir):
    return _ph_scores(spark, sf_dir).drop("detector").withColumn("delay", r("delay"))


@query("sq_synth_match")
def sq_synth_match(spark, sf_dir):
    """The selected detectors against the changes put into the streams."""
    return _injected_scores(spark, sf_dir, detectors.SELECTED)


@query("ev_detect", f", {_INJECTED} SELECT kind, round(avg(delay), 6) AS ev_delay, sum(missed)::BIGINT AS ev_missed, sum(false_alarms)::BIGINT AS false_alarms FROM sc GROUP BY kind")
def ev_detect(spark, sf_dir):
    rows = _ph_scores(spark, sf_dir)
    return rows.groupBy("kind").agg(r(F.avg("delay")).alias("ev_delay"), F.sum("missed").alias("ev_missed"), F.sum("false_alarms").alias("false_alarms"))


_CONFIG = "alpha=0.99, delta=0.05, min_instances=20, threshold=60"
_T1 = f"""SELECT 'page_hinkley' AS detector, kind, {_text("delay", 0)} AS delay, round(avg(false_alarms / n * 10000), 1) AS false_per_10k, sum(missed)::BIGINT AS missed, '{_CONFIG}' AS config, count(DISTINCT seed) AS seeds FROM sc GROUP BY kind"""


def _detection_table(rows):
    """detector, kind, delay (mean and deviation over the series that have one), false alarms for 10,000 rows, missed changes,
    seeds: detection on series of a known truth."""
    per = F.col("false_alarms") / F.col("n") * 10_000
    out = rows.groupBy("detector", "kind").agg(_cell("delay", 0), r(F.avg(per), 1).alias("false_per_10k"), F.sum("missed").alias("missed"), F.countDistinct("seed").alias("seeds"))
    return _cells(out, delay=("delay", 0))


@query("rp_t1", f", {_INJECTED} {_T1}")
def rp_t1(spark, sf_dir):
    """Page-Hinkley on the streams' residuals with known changes, by kind of change."""
    return _detection_table(_ph_scores(spark, sf_dir)).withColumn("config", F.lit(_CONFIG))


@query("rp_t1_year", f", {_INJECTED}, t1 AS ({_T1}) SELECT t1.*, per_year FROM t1 LEFT JOIN (SELECT kind, round(avg(false_alarms / n * 17520), 4) AS per_year FROM sc WHERE kind <> 'none' GROUP BY kind) USING (kind)")
def rp_t1_year(spark, sf_dir):
    """rp_t1 with the false alarms of a year of half-hours; series without a change have none that counts for a budget."""
    scores = written(_ph_scores(spark, sf_dir), "scores")[0]
    year = scores.filter("kind <> 'none'").groupBy("kind").agg(r(F.avg(F.col("false_alarms") / F.col("n") * 17_520), 4).alias("per_year"))
    return _detection_table(scores).withColumn("config", F.lit(_CONFIG)).join(year, "kind", "left")


@query("sq_tuning_early_stop")
def sq_tuning_early_stop(spark, sf_dir):
    """Every configuration on the series without a shift; those without a false alarm go on to each kind of shift."""
    ship_package(spark)
    return tuning.sweep_series(_injected(spark, sf_dir), tuning.grid())


def _swept(spark, sf_dir, configs):
    ship_package(spark)
    return written(tuning.sweep_rows(_injected(spark, sf_dir), configs), "swept")[0]


_RATES = [*(f"fa_per_year_{k}" for k in injection.KINDS), *(f"delay_{k}" for k in injection.KINDS[1:]), "most_fa_none", "fa_per_year", "mean_delay"]
_WINNER = ["fa_per_year", "mean_delay", "fa_per_year_none", "most_fa_none"]


def _summary(spark, sf_dir, configs):
    rows = tuning.summarised(_swept(spark, sf_dir, configs))
    return rows.select("detector", "params", "eligible", "fail_reason", *(r(c).alias(c) for c in _RATES))


def _winners(spark, sf_dir, configs, names):
    rows = tuning.winners(tuning.summarised(_swept(spark, sf_dir, configs)), names)
    return rows.select("detector", "params", "status", *(r(c).alias(c) for c in _WINNER))


@query("rp_tuning")
def rp_tuning(spark, sf_dir):
    """The best eligible configuration of each detector, from the whole sweep's rows."""
    return _winners(spark, sf_dir, tuning.grid(), tuple(tuning.MAKE))


@query("rp_tuning_summary")
def rp_tuning_summary(spark, sf_dir):
    """Every configuration: false alarms and delay by kind, and the reason of the row that ended it."""
    return _summary(spark, sf_dir, tuning.grid())


# The same of Page-Hinkley alone, whose recursion SQL has: without drift first, then the configurations that are left.
_PH_GRID = [c for c in tuning.grid() if c[0] == "page_hinkley"]
_PH_VALUES = ", ".join(f"({i}, '{json.dumps(p, sort_keys=True)}', {p['min_instances']}, {p['delta']!r}::DOUBLE, {p['threshold']!r}::DOUBLE, {p['alpha']!r}::DOUBLE)" for i, (_, p) in enumerate(_PH_GRID))


def _ph_runs(name: str, jobs: str) -> str:
    """SQL of Page-Hinkley's recursion by (series, configuration) of jobs; name has what it fired."""
    return f"""{name} AS (SELECT k, config, -1::BIGINT AS pos, 0 AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 'inf'::DOUBLE AS least, '-inf'::DOUBLE AS most, false AS fired FROM {jobs}
 UNION ALL SELECT k, config, pos, n, mean, up, down, least, most, n >= min_n AND (up - least > threshold OR most - down > threshold) FROM (
  SELECT *, least(pl, up) AS least, greatest(pm, down) AS most FROM (
   SELECT k, config, pos, n, mean, pl, pm, min_n, threshold, alpha * pu + (y - mean) - delta AS up, alpha * pd + (y - mean) + delta AS down FROM (
    SELECT s.k, p.config, s.pos, s.y, min_n, delta, threshold, alpha, CASE WHEN fired THEN 1 ELSE n + 1 END AS n, CASE WHEN fired THEN s.y ELSE mean + (s.y - mean) / (n + 1) END AS mean, CASE WHEN fired THEN 0 ELSE up END AS pu, CASE WHEN fired THEN 0 ELSE down END AS pd,
     CASE WHEN fired THEN 'inf'::DOUBLE ELSE least END AS pl, CASE WHEN fired THEN '-inf'::DOUBLE ELSE most END AS pm FROM {name} p JOIN cf USING (config) JOIN sx s ON s.k = p.k AND s.pos = p.pos + 1))))"""


def _ph_scored(name: str, fired: str, jobs: str) -> str:
    """SQL of a row for each job: what each change takes, what is missed, false or over the budget."""
    return f"""{name} AS (SELECT hd.k, hd.kind, hd.seed, j.config, coalesce(c, 0) - coalesce(m, 0) AS missed, coalesce(x, 0) - coalesce(m, 0) AS false_alarms, (coalesce(x, 0) - coalesce(m, 0)) / hd.n * 17520 AS fy, delay
 FROM {jobs} j JOIN hd ON hd.name = j.k LEFT JOIN (SELECT name, count(*) AS c FROM ch GROUP BY ALL) t ON t.name = j.k
 LEFT JOIN (SELECT k AS name, config, count(*) AS x FROM {fired} WHERE fired GROUP BY ALL) f ON f.name = j.k AND f.config = j.config
 LEFT JOIN (SELECT name, config, count(*) AS m, avg(delay) AS delay FROM (SELECT ch.name, p.config, a, min(pos) - a AS delay FROM ch JOIN {fired} p ON p.k = ch.name AND fired AND pos BETWEEN a AND b GROUP BY ch.name, p.config, a) GROUP BY ALL) h ON h.name = j.k AND h.config = j.config)"""


def _ph_kinds() -> str:
    """SQL of the sweep's rows, kind by kind: only what did not fail on a kind goes on to the next."""
    parts, left = [], "SELECT config FROM cf"
    for i, kind in enumerate(injection.KINDS):
        parts.append(f"job{i} AS (SELECT name AS k, config FROM hd, ({left}) WHERE kind = '{kind}')")
        parts += [_ph_runs(f"run{i}", f"job{i}"), _ph_scored(f"sco{i}", f"run{i}", f"job{i}")]
        left = f"SELECT config FROM sco{i} GROUP BY config HAVING NOT max({'false_alarms > 0' if kind == 'none' else f'missed > 0 OR fy > {tuning.BUDGET}'})"
    union = " UNION ALL ".join(f"SELECT *, {i} AS place FROM sco{i}" for i in range(len(injection.KINDS)))
    return ",\n".join(parts) + f",\nswp AS ({union})"


_PH_SUMMARY = f"""cf(config, params, min_n, delta, threshold, alpha) AS (VALUES {_PH_VALUES}),
{_INJECTED}, {_ph_kinds()},
rsn AS (SELECT config, arg_min(CASE WHEN place = 0 THEN 'false alarm without drift' WHEN missed > 0 THEN 'missed ' || kind ELSE 'over the budget on ' || kind END, place * 1000 + seed) AS reason
 FROM swp WHERE CASE WHEN place = 0 THEN false_alarms > 0 ELSE missed > 0 OR fy > {tuning.BUDGET} END AND (config, place * 1000 + seed, k) IN (SELECT config, min(o), min_by(k, (o, k)) FROM (SELECT config, k, place * 1000 + seed AS o FROM swp WHERE CASE WHEN place = 0 THEN false_alarms > 0 ELSE missed > 0 OR fy > {tuning.BUDGET} END) GROUP BY config) GROUP BY config),
smy AS (SELECT 'page_hinkley' AS detector, params, reason IS NULL AS eligible, coalesce(reason, '') AS fail_reason, {", ".join(f"avg(fy) FILTER (WHERE kind = '{k}') AS fa_per_year_{k}" for k in injection.KINDS)},
 {", ".join(f"avg(delay) FILTER (WHERE kind = '{k}') AS delay_{k}" for k in injection.KINDS[1:])}, max(fy) FILTER (WHERE kind = 'none') AS most_fa_none, CASE WHEN reason IS NULL THEN avg(fy) END AS fa_per_year, CASE WHEN reason IS NULL THEN avg(delay) FILTER (WHERE kind <> 'none') END AS mean_delay
 FROM swp JOIN cf USING (config) LEFT JOIN rsn USING (config) GROUP BY params, reason)"""


@query("rp_tuning_summary_ph", f", {_PH_SUMMARY} SELECT detector, params, eligible, fail_reason, {', '.join(f'round({c}, 6) AS {c}' for c in _RATES)} FROM smy")
def rp_tuning_summary_ph(spark, sf_dir):
    """rp_tuning_summary of Page-Hinkley's configurations."""
    return _summary(spark, sf_dir, _PH_GRID)


@query("rp_tuning_ph", f""", {_PH_SUMMARY} SELECT d.detector, params, CASE WHEN params IS NULL THEN 'no_eligible_configuration' ELSE 'selected' END AS status, {', '.join(f'round({c}, 6) AS {c}' for c in _WINNER)}
 FROM (SELECT 'page_hinkley' AS detector) d LEFT JOIN (SELECT * FROM smy WHERE eligible ORDER BY fa_per_year, mean_delay NULLS LAST, params LIMIT 1) USING (detector)""")
def rp_tuning_ph(spark, sf_dir):
    """rp_tuning of Page-Hinkley's configurations."""
    return _winners(spark, sf_dir, _PH_GRID, ("page_hinkley",))


#: Simulated sequences for each key and alarm set; days between alarms whose share is ranked.
SIMULATIONS = 5000
EDGE = (14.0, 16.0)


def _alarm_sets(spark, sf_dir):
    """k, alarm_set, day, least: all alarms (no minimum gap) and the accepted ones (the refractory period), in days."""
    rows = matching.debounced(C.alarms(spark, sf_dir), refractory=_R)
    raw = rows.select("k", F.lit("raw").alias("alarm_set"), (F.col("us") / float(S.DAY)).alias("day"), F.lit(0.0).alias("least"))
    kept = rows.filter("accepted").select("k", F.lit("accepted").alias("alarm_set"), (F.col("us") / float(S.DAY)).alias("day"), F.lit(_R / S.DAY).alias("least"))
    return raw.unionByName(kept)


def simulated(sets):
    """k, alarm_set, id, gap_mean, gap_cv, gap_min, gap_share of random alarm times; sets has k, alarm_set, n, span, least.

    Sorted uniform draws on the line shortened by the minimum gaps, shifted apart again. Sets of under three alarms have none.
    """
    import pandas as pd

    def draw(one: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        n, span, least = int(one["n"].iloc[0]), float(one["span"].iloc[0]), float(one["least"].iloc[0])
        free, random, parts = max(0.0, span - (n - 1) * least), np.random.default_rng(0), []
        for _ in range(0, SIMULATIONS, 500):
            at = np.sort(random.uniform(0, free, (500, n)), axis=1) + least * np.arange(n)
            gaps = np.diff(at, axis=1)
            mean = gaps.mean(axis=1)
            parts.append((mean, gaps.std(axis=1) / mean, gaps.min(axis=1), ((gaps >= EDGE[0]) & (gaps < EDGE[1])).mean(axis=1)))
        columns = map(np.concatenate, zip(*parts, strict=True))
        out = pd.DataFrame(dict(zip(("gap_mean", "gap_cv", "gap_min", "gap_share"), columns, strict=True)))
        return out.assign(k=one["k"].iloc[0], alarm_set=one["alarm_set"].iloc[0], id=range(SIMULATIONS))

    return sets.filter("n >= 3").groupBy("k", "alarm_set").applyInPandas(draw, "k string, alarm_set string, id long, gap_mean double, gap_cv double, gap_min double, gap_share double")


def _set_sizes(spark, sf_dir, sets):
    spans = C.stream(spark, sf_dir).groupBy("k").agg(((F.max("slot") - F.min("slot")) / float(S.DAY)).alias("span"))
    return sets.groupBy("k", "alarm_set").agg(F.count("*").alias("n"), F.first("least").alias("least")).join(spans, "k")


@query("ev_simulate")
def ev_simulate(spark, sf_dir):
    """Random alarm times for each key and alarm set, as many, over the same span and with the same minimum gap."""
    return simulated(_set_sizes(spark, sf_dir, _alarm_sets(spark, sf_dir)))


def ranked(stats, null):
    """stats with cv_rank and share_rank: the share of the set's own simulations at or below its value, null if it has none."""
    sims = null.select("k", "alarm_set", F.col("gap_cv").alias("sim_cv"), F.col("gap_share").alias("sim_share"))
    rank = lambda sim, value: F.avg((F.col(sim) <= F.col(value)).cast("double"))
    groups = ["k", "alarm_set", "gap_mean", "gap_cv", "gap_share"]
    return stats.join(sims, ["k", "alarm_set"], "left").groupBy(*groups).agg(rank("sim_cv", "gap_cv").alias("cv_rank"), rank("sim_share", "gap_share").alias("share_rank"))


@query("ev_periodicity")
def ev_periodicity(spark, sf_dir):
    """Each alarm set's gap variation and share of gaps of 14 to 16 days beside those of its own simulations."""
    sets = _alarm_sets(spark, sf_dir)
    stats = None
    for name in ("raw", "accepted"):
        one = metrics.gap_stats(sets.filter(F.col("alarm_set") == name), "k", "day", *EDGE).withColumn("alarm_set", F.lit(name))
        stats = one if stats is None else stats.unionByName(one)
    return ranked(stats, simulated(_set_sizes(spark, sf_dir, sets)))


# Intervals and forecasts in order.


@query("uq_agaci")
def uq_agaci(spark, sf_dir):
    ship_package(spark)
    return conformal.agaci_intervals(C.forecasts(spark, sf_dir).filter("split = 'test'"), C.calibration(spark, sf_dir))


@query("rp_t5_adaptive")
def rp_t5_adaptive(spark, sf_dir):
    """rp_t5 for adaptively aggregated intervals."""
    placed = C.placed(spark, sf_dir)
    scale = placed.filter("split = 'train'").groupBy("k").agg(F.avg("y").alias("scale"))
    labelled = regimes.global_regimes(uq_agaci(spark, sf_dir), C.overlapping(spark, sf_dir))
    return _coverage_table(spread.haloed(labelled, 47), scale)


@query("sq_replay")
def sq_replay(spark, sf_dir):
    rows = uq_agaci(spark, sf_dir)
    return rows.groupBy("k").agg(F.count("*").alias("n"), metrics.coverage().alias("coverage"), metrics.width().alias("width"))


_ACI = """ca AS (SELECT k, 0::BIGINT AS i, 0.1::DOUBLE AS a FROM (SELECT DISTINCT k FROM iv) UNION ALL
 SELECT ca.k, ca.i + 1, a + 0.01::DOUBLE * (0.1::DOUBLE - CASE WHEN q.y BETWEEN q.lower AND q.upper THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) FROM ca JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS i FROM iv) q ON q.k = ca.k AND q.i = ca.i + 1)"""


@query("sq_aci_alpha", f", {_ACI} SELECT k, i, round(a, 9) AS alpha FROM ca WHERE i > 0")
def sq_aci_alpha(spark, sf_dir):
    """The level's recursion is a running sum of hits and misses: no fold is needed."""
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("pos")
    step = 0.01 * (0.1 - F.when(metrics.covered(), 0.0).otherwise(1.0))
    rows = C.intervals(spark, sf_dir).select("k", F.row_number().over(w).cast("long").alias("i"), F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("d"))
    return rows.select("k", "i", r(0.1 + F.col("d"), 9).alias("alpha"))


@query("sq_aci_buffer", "SELECT k, pos, n, round(top, 6) AS most FROM (SELECT k, pos, split, count(*) OVER w AS n, max(abs(y - p)) OVER w AS top FROM fc WHERE split <> 'train' WINDOW w AS (PARTITION BY k ORDER BY pos ROWS BETWEEN 336 PRECEDING AND 1 PRECEDING)) WHERE split = 'test'")
def sq_aci_buffer(spark, sf_dir):
    """The bounded buffer of errors as a window frame."""
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("pos").rowsBetween(-336, -1)
    rows = C.forecasts(spark, sf_dir).filter("split <> 'train'")
    rows = rows.select("k", "pos", "split", F.count("*").over(w).alias("n"), r(F.max(metrics.error()).over(w)).alias("most"))
    return rows.filter("split = 'test'").drop("split")


_BOA = """bt AS (SELECT k, y, row_number() OVER (PARTITION BY k ORDER BY pos) AS i FROM s WHERE split = 'test'),
bo AS (SELECT DISTINCT k, 0::BIGINT AS i, 0.5::DOUBLE AS w0, 0.5::DOUBLE AS w1, 0.0::DOUBLE AS r0, 0.0::DOUBLE AS r1, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1 FROM bt
 UNION ALL SELECT k, i, CASE WHEN e0 = 0 AND e1 = 0 THEN w0 ELSE x0 / (x0 + x1) END, CASE WHEN e0 = 0 AND e1 = 0 THEN w1 ELSE x1 / (x0 + x1) END, r0, r1, v0, v1 FROM (
  SELECT *, exp(l0 - greatest(l0, l1)) AS x0, exp(l1 - greatest(l0, l1)) AS x1 FROM (
   SELECT *, CASE WHEN e0 > 0 THEN e0 * r0 + ln(e0) ELSE '-inf'::DOUBLE END AS l0, CASE WHEN e1 > 0 THEN e1 * r1 + ln(e1) ELSE '-inf'::DOUBLE END AS l1 FROM (
    SELECT k, i, w0, w1, e0, e1, v0, v1, r0 + g0 - e0 * g0 * g0 AS r0, r1 + g1 - e1 * g1 * g1 AS r1 FROM (
     SELECT *, CASE WHEN v0 > 0 THEN 1 / sqrt(v0) ELSE 0 END AS e0, CASE WHEN v1 > 0 THEN 1 / sqrt(v1) ELSE 0 END AS e1 FROM (
      SELECT k, i, w0, w1, r0, r1, g0, g1, v0 + 2.2::DOUBLE * g0 * g0 AS v0, v1 + 2.2::DOUBLE * g1 * g1 AS v1 FROM (
       SELECT k, i, w0, w1, r0, r1, v0, v1, slope * mean AS g0, slope * (mean - 100) AS g1 FROM (
        SELECT bo.k, bt.i, w0, w1, r0, r1, v0, v1, 100::DOUBLE * w1 AS mean, CASE WHEN bt.y < 100::DOUBLE * w1 THEN 1 ELSE 0 END - 0.05::DOUBLE AS slope FROM bo JOIN bt ON bt.k = bo.k AND bt.i = bo.i + 1))))))))"""


@query("sq_boa", f", {_BOA} SELECT k, round(w0, 9) AS w0, round(w1, 9) AS w1 FROM bo JOIN (SELECT k, max(i) AS i FROM bt GROUP BY k) USING (k, i)")
def sq_boa(spark, sf_dir):
    """Weights after aggregating two constant experts over each key's test values."""
    import pandas as pd

    ship_package(spark)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        model = conformal.Boa(2, 0.05)
        for y in rows.sort_values("pos")["y"]:
            model.update((0.0, 100.0), y)
        return pd.DataFrame([(rows["k"].iloc[0], *model.weights)], columns=["k", "w0", "w1"])

    rows = C.stream(spark, sf_dir).filter("split = 'test'").groupBy("k").applyInPandas(run, "k string, w0 double, w1 double")
    return rows.select("k", r("w0", 9).alias("w0"), r("w1", 9).alias("w1"))


def _replayed(spark, sf_dir, make):
    ship_package(spark)
    return forecast.replay(C.stream(spark, sf_dir), make, 700)


#: Rows of a key that harmonic regressions are fitted on.
_FIRST = 700
_TERMS = ["1.0::DOUBLE", *(f"{f}(2 * pi() * {h} * pos / {period})" for period, most in harmonic.PERIODS.items() for h in range(1, most + 1) for f in ("sin", "cos"))]
# Normal equations as a list of rows with y's column last, brought to the unit matrix one column at a time.
_LEAST = f"""dx AS (SELECT k, y, [{", ".join(_TERMS)}] AS x FROM s WHERE pos < {_FIRST}),
nx AS (SELECT k, i, j, sum(x[i] * CASE WHEN j > {len(_TERMS)} THEN y ELSE x[j] END) AS v FROM dx, range(1, {len(_TERMS) + 1}) a(i), range(1, {len(_TERMS) + 2}) b(j) GROUP BY k, i, j),
gj AS (SELECT k, 0 AS c, list(r ORDER BY i) AS m FROM (SELECT k, i, list(v ORDER BY j) AS r FROM nx GROUP BY k, i) GROUP BY k
 UNION ALL SELECT k, c + 1, list_transform(m, lambda r, i: CASE WHEN i = c + 1 THEN list_transform(r, lambda v: v / m[c + 1][c + 1]) ELSE list_transform(r, lambda v, j: v - r[c + 1] * m[c + 1][j] / m[c + 1][c + 1]) END) FROM gj WHERE c < {len(_TERMS)})"""


@query("fc_dhr_beta", f", {_LEAST} SELECT k, unnest(range(0, {len(_TERMS)})) AS term, unnest(list_transform(m, lambda r: round(r[{len(_TERMS) + 1}], 6))) AS beta FROM gj WHERE c = {len(_TERMS)}")
def fc_dhr_beta(spark, sf_dir):
    """Coefficients of the regression on Fourier terms, by least squares from sums over a key's first rows."""
    rows = C.placed(spark, sf_dir).filter(F.col("pos") < _FIRST)
    found = harmonic.coefficients(rows, harmonic.design(F.col("pos")))
    return found.select("k", F.posexplode("beta").alias("at", "b")).select("k", F.col("at").cast("long").alias("term"), r("b").alias("beta"))


@query("fc_dhr_arima")
def fc_dhr_arima(spark, sf_dir):
    rows = harmonic.forecasts(C.placed(spark, sf_dir), _FIRST)
    return rows.groupBy("k").agg(F.count("*").alias("n"), metrics.mae().alias("mae"))


@query("fc_nhits")
def fc_nhits(spark, sf_dir):
    return _replayed(spark, sf_dir, forecast.BlockRidge).groupBy("k").agg(F.count("*").alias("n"), metrics.mae().alias("mae"))


@query("fc_xgb")
def fc_xgb(spark, sf_dir):
    """Boosted trees fitted by Spark on all lags and the calendar, recursive within a block of a day; gaps stay gaps."""
    rows = boosting.forecasts(S.with_gaps(C.ev30(spark, sf_dir)), S.stamp("2024-01-24"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), metrics.mae().alias("mae"))


# Retraining.


def _history(spark, sf_dir):
    return C.stream(spark, sf_dir).withColumn("day", F.col("slot") - F.col("slot") % S.DAY)


_H = f"h AS (SELECT k, slot - slot % {S.DAY} AS day FROM s), ends AS (SELECT k, min(day) AS a, max(day) AS b FROM h GROUP BY k), tg AS (SELECT DISTINCT k, us - us % {S.DAY} AS day FROM alarm)"


@query("ad_30d", f", {_H} SELECT k, unnest(generate_series(a + 6 * {S.DAY}, b - {S.DAY}, 7 * {S.DAY})) AS day FROM ends")
def ad_30d(spark, sf_dir):
    return adapt.EveryDays(7).boundaries(_history(spark, sf_dir), None)


@query("ad_never", "SELECT k, slot AS day FROM s WHERE false")
def ad_never(spark, sf_dir):
    return adapt.NeverRetrain().boundaries(_history(spark, sf_dir), None)


@query("ad_triggers", f", {_H} SELECT k, day FROM tg JOIN ends USING (k) WHERE day >= a AND day < b")
def ad_triggers(spark, sf_dir):
    triggers = C.alarms(spark, sf_dir).select("k", (F.col("us") - F.col("us") % S.DAY).alias("day"))
    return adapt.OnTrigger().boundaries(_history(spark, sf_dir), triggers)


@query("ad_full", f", {_H} SELECT t.k, t.day, count(h.day) AS train_rows FROM (SELECT k, day FROM tg JOIN ends USING (k) WHERE day < b) t LEFT JOIN h ON h.k = t.k AND h.day <= t.day GROUP BY t.k, t.day")
def ad_full(spark, sf_dir):
    return adapt.training_rows(_history(spark, sf_dir), ad_triggers(spark, sf_dir), None)


@query("ad_recent", f", {_H} SELECT t.k, t.day, count(h.day) AS train_rows FROM (SELECT k, day FROM tg JOIN ends USING (k) WHERE day < b) t LEFT JOIN h ON h.k = t.k AND h.day <= t.day AND h.day > t.day - 5 * {S.DAY} GROUP BY t.k, t.day")
def ad_recent(spark, sf_dir):
    return adapt.training_rows(_history(spark, sf_dir), ad_triggers(spark, sf_dir), 5)


@query("snk_retrains", f", {_H} SELECT k, day FROM tg JOIN ends USING (k) WHERE day >= a AND day < b")
def snk_retrains(spark, sf_dir):
    from tidemark.sources.shared import written

    return written(ad_triggers(spark, sf_dir), "retrains")[0]


# Structured Streaming.


@query("stream_windowed_mean", "SELECT k, us - us % 1800000000 AS start, round(avg(value), 6) AS y, count(value) AS n FROM ev GROUP BY ALL")
def stream_windowed_mean(spark, sf_dir):
    S.table(spark, sf_dir, "events")
    out = structured.windowed_mean(structured.events(spark, sf_dir), "event_type", "ts", "value")
    return structured.run_to_end(out, "complete").select("k", F.unix_micros("start").alias("start"), r("y").alias("y"), "n")


# Page-Hinkley over the readings as they are, by key.
_READINGS = """, raw AS (SELECT k, us, value AS y, row_number() OVER (PARTITION BY k ORDER BY us, event_id) - 1 AS pos FROM ev WHERE value IS NOT NULL)"""
_STREAMED = """sp AS (SELECT DISTINCT k, -1::BIGINT AS pos, -1::BIGINT AS us, 0 AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 'inf'::DOUBLE AS least, '-inf'::DOUBLE AS most, false AS fired FROM raw
 UNION ALL SELECT k, pos, us, n, mean, up, down, least, most, n >= 20 AND (up - least > 200 OR most - down > 200) FROM (
  SELECT k, pos, us, n, mean, up, down, least(pl, up) AS least, greatest(pm, down) AS most FROM (
   SELECT k, pos, us, n, mean, pl, pm, 0.99::DOUBLE * pu + (y - mean) - 0.05::DOUBLE AS up, 0.99::DOUBLE * pd + (y - mean) + 0.05::DOUBLE AS down FROM (
    SELECT s.k, s.pos, s.us, s.y, CASE WHEN fired THEN 1 ELSE n + 1 END AS n, CASE WHEN fired THEN s.y ELSE mean + (s.y - mean) / (n + 1) END AS mean, CASE WHEN fired THEN 0 ELSE up END AS pu, CASE WHEN fired THEN 0 ELSE down END AS pd,
     CASE WHEN fired THEN 'inf'::DOUBLE ELSE least END AS pl, CASE WHEN fired THEN '-inf'::DOUBLE ELSE most END AS pm FROM sp JOIN raw s ON s.k = sp.k AND s.pos = sp.pos + 1))))"""


@query("stream_detect", f"{_READINGS}, {_STREAMED} SELECT k, us FROM sp WHERE fired")
def stream_detect(spark, sf_dir):
    ship_package(spark)
    S.table(spark, sf_dir, "events")
    found = structured.detect(structured.events(spark, sf_dir), lambda: detectors.PageHinkley(20, 0.05, 200.0, 0.99), "event_type", "ts", "value")
    return structured.run_to_end(found)


@query("stream_detect_ordered", f"""{_READINGS.replace("IS NOT NULL)", "IS NOT NULL AND us IS NOT NULL AND k IS NOT NULL AND us <= (SELECT max(us) // 1000 * 1000 - 3600000000 FROM ev WHERE value IS NOT NULL AND us IS NOT NULL AND k IS NOT NULL))")}, {_STREAMED} SELECT k, us FROM sp WHERE fired""")
def stream_detect_ordered(spark, sf_dir):
    """Alarms in the order of event time, up to an hour behind the last reading: state with timers, fed as the watermark passes."""
    S.table(spark, sf_dir, "events")
    params = {"min_instances": 20, "delta": 0.05, "threshold": 200.0, "alpha": 0.99}
    with stateful.keeping_state(spark):
        found = stateful.detect_ordered(structured.events(spark, sf_dir), params, "event_type", "ts", "event_id", "value")
        return structured.run_to_end(found).select("k", "us")


@query("stream_sessions", """, tm AS (SELECT k, us, us - lag(us) OVER (PARTITION BY k ORDER BY us) AS gap FROM ev WHERE us IS NOT NULL),
 sn AS (SELECT k, us, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM tm)
 SELECT k, min(us) AS start, max(us) + 1800000000 AS stop, count(*) AS n FROM sn GROUP BY k, g""")
def stream_sessions(spark, sf_dir):
    """Sessions of each kind of event, those still open at the end too."""
    S.table(spark, sf_dir, "events")
    out = structured.sessions(structured.events(spark, sf_dir), "event_type", "ts")
    return structured.run_to_end(out, "complete").select("k", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("stop"), "n")
