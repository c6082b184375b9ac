"""Hand-computed cases for the time-series operators."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import adapt, clean, conformal, detectors, escalation, forecast, harmonic, ledger, matching, metrics, profile, regimes, tuning, windows
from tidemark.sources import series as S

H = S.HALF_HOUR


def us(text):
    return S.stamp(text)


def events(spark, *rows):
    return S.catalogue(spark, rows)


def test_regrid_closes_on_the_right_and_keeps_gaps(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, m), v) for m, v in ((0, 1.0), (1, 2.0), (30, 4.0))] + [("a", dt.datetime(2024, 1, 1, 1, 31), 5.0)]
    raw = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    grid = S.with_gaps(S.regrid(raw, "k", "ts", "value")).orderBy("slot").collect()
    start = us("2024-01-01")
    assert [(r.slot - start, r.y) for r in grid] == [(0, 1.0), (H, 3.0), (2 * H, None), (3 * H, None), (4 * H, 5.0)]


def test_event_windows(spark):
    w = {r.event_id: r for r in regimes.event_windows(events(spark, ("D", "2020-03-01", "2020-03-01", "day", "x", 1), ("R", "2020-04-01", "2020-05-17", "date_range", "x", 2))).collect()}
    assert (w["D"].pre_start, w["D"].drift_end, w["D"].post_end, w["D"].match_end) == tuple(map(us, ("2020-02-23", "2020-03-02", "2020-03-09", "2020-03-09")))
    assert (w["R"].pre_start, w["R"].drift_end, w["R"].post_end, w["R"].match_end) == tuple(map(us, ("2020-03-25", "2020-05-18", "2020-05-25", "2020-05-25")))


def test_global_regimes(spark):
    w = regimes.event_windows(events(spark, ("E1", "2020-03-10", "2020-03-10", "day", "x", 1), ("E2", "2020-04-10", "2020-04-10", "day", "x", 1)))
    stamps = ["2020-03-01", "2020-03-09", "2020-03-10", "2020-03-17T23:30", "2020-03-18", "2020-04-09", "2020-04-10", "2020-05-01"]
    rows = spark.createDataFrame([("a", us(t)) for t in stamps], "k string, slot long")
    got = {r.slot: (r.regime, r.event_id) for r in regimes.global_regimes(rows, w).collect()}
    assert [got[us(t)][0] for t in stamps][:3] == ["pre_drift", "pre_drift", "drift"]
    assert got[us("2020-03-18")] == ("post_drift", "E1") and got[us("2020-04-10")] == ("drift", "E2") and got[us("2020-05-01")] == ("post_drift", "E2")
    local = {r.slot: r.regime for r in regimes.local_regimes(rows, w).collect()}
    assert us("2020-03-01") not in local and local[us("2020-03-09")] == "pre_drift" and local[us("2020-04-09")] == "pre_drift"


def test_debounce_keeps_the_boundary(spark):
    at = [us("2020-03-02"), us("2020-03-03"), us("2020-03-16"), us("2020-03-29T23:30"), us("2020-03-30")]
    rows = spark.createDataFrame([("a", t) for t in at], "k string, us long")
    kept = sorted(r.us for r in matching.debounced(rows).filter("accepted").collect())
    assert kept == [at[0], at[2], at[4]]


def test_matching_and_metrics(spark):
    w = regimes.event_windows(events(spark, ("E1", "2020-03-01", "2020-03-01", "day", "x", 1), ("E2", "2020-06-01", "2020-06-01", "day", "x", 2))).withColumn("k", F.lit("a"))
    alarms = spark.createDataFrame([("a", us(t)) for t in ("2020-03-03", "2020-03-04", "2020-06-05", "2020-09-01")], "k string, us long")
    found = matching.match_alarms(alarms, w)
    assert {(r.label, r.event_id) for r in found.collect()} == {("Match", "E1"), ("Match", "E2"), ("Unmatch", None), ("Ignored", None)}
    m = matching.event_metrics(found, w).first()
    assert (m.raw, m.accepted, m.matched, m.unmatched, m.recall, m.recall_t1) == (4, 3, 2, 1, 1.0, 1.0)
    assert m.precision == pytest.approx(2 / 3) and m.mean_delay == pytest.approx(3.0)


def test_synthetic_matching_includes_the_last_position():
    found = matching.match_positions([100], [436, 437], 1000)
    assert (found["matched"], found["false_alarms"], found["delay"]) == (1, 1, 336)
    assert matching.match_positions([100], [437], 1000)["missed"] == 1


@pytest.mark.parametrize(("n", "alpha", "want"), [(99, 0.1, 90), (19, 0.1, 18)])
def test_conformal_rank(spark, n, alpha, want):
    assert spark.range(1).select(conformal.rank(F.lit(n), alpha).alias("r")).first().r == want


def test_conformal_radius(spark):
    assert [conformal.radius_of([1, 2, 3], a) for a in (0, -0.2, 1, 1.3, 0.1, 0.5)] == [math.inf, math.inf, 0, 0, math.inf, 2]
    scores = [-3, 7, 1, -12, 5, 9, -2, 4, 8, -6, 10, 11, -13, 14, 15, -16, 17, 18, -19]
    rows = spark.createDataFrame([("a", float(s)) for s in scores], "k string, score double")
    assert conformal.radii(rows, 0.1).first().radius == 18.0


def test_escalation_curve(spark):
    rows = [(0.5, 1), (1.0, 2), (-1.5, 2), (10.0, 3), (10.0, 4)]
    frame = spark.createDataFrame([("a", y, 0.0 - w, 0.0 + w) for y, w in rows], "k string, y double, lower double, upper double")
    scored = frame.select("k", escalation.width_score().alias("score"), metrics.covered().alias("hit"))
    curve = escalation.curve(scored).orderBy("threshold").collect()
    assert [r.threshold for r in curve] == [-math.inf, 2, 4, 6, 8]
    assert [round(r.review_rate, 9) for r in curve] == [1, 0.8, 0.4, 0.2, 0]
    assert [r.retained_coverage for r in curve] == [None, 1, 1, 3 / 4, 3 / 5]


def test_rolling_coverage(spark):
    rows = spark.createDataFrame([("a", i, i * H, float(y), -1.0, 1.0) for i, y in enumerate([0, 0, 5, 5, 0])], "k string, pos long, slot long, y double, lower double, upper double")
    got = rows.select("pos", windows.rolling_mean(metrics.covered().cast("double"), 2).alias("c")).orderBy("pos").collect()
    assert [r.c for r in got] == [None, 1, 0.5, 0, 0.5]


def test_complete_windows(spark):
    def count(slots, flags):
        rows = spark.createDataFrame([("a", i, s * H, f) for i, (s, f) in enumerate(zip(slots, flags, strict=True))], "k string, pos long, slot long, f boolean")
        return rows.select(windows.eligible(F.col("f"), F.col("slot"), 48).alias("e")).filter("e").count()

    assert [count(range(n), [True] * n) for n in (30, 48, 60)] == [0, 1, 13]
    assert count(range(120), [True] * 60 + [False] * 10 + [True] * 50) == 16
    assert count([*range(30), *range(31, 100)], [True] * 99) == 22


def test_agaci_levels_and_buffer():
    model = conformal.AgAci([16, 17, 18, 19], 0.1, (0.0, 0.01, 0.05), window=4)
    model.interval(0.0)
    model._radii = [5.0, 5.0, 5.0]
    model.observe(0.0, 6.0)
    assert model.levels == pytest.approx([0.10, 0.10 - 0.009, 0.10 - 0.045])
    assert list(model.buffer) == [17, 18, 19, 6]


def test_boa_first_update():
    model = conformal.Boa(2, 0.05)
    model.update((0.0, 10.0), 2.0)
    assert model.weights[0] == pytest.approx(1 / (1 + math.exp(-9.5 / math.sqrt(2.2 * 4.75**2))), rel=1e-6)
    assert sum(model.weights) == pytest.approx(1)


def test_gap_stats_and_rayleigh(spark):
    rows = spark.createDataFrame([("a", float(d)) for d in (0, 14, 28, 50)], "k string, d double")
    g = metrics.gap_stats(rows, "k", "d", 14, 16).first()
    assert g.n == 3 and g.gap_share == pytest.approx(2 / 3)
    mondays = spark.createDataFrame([("a", 7 * i) for i in range(20)] + [("b", i) for i in range(70)], "k string, d long")
    r = {x.k: x for x in metrics.rayleigh(mondays, "k", "d", 7).collect()}
    assert r["a"].r == pytest.approx(1) and r["a"].p < 1e-6 and r["b"].r < 1e-9 and r["b"].p == pytest.approx(1)


def test_simulated_alarms_follow_their_own_set(spark):
    from tidemark.plans import sequential

    sets = spark.createDataFrame([("a", "raw", 5, 30.0, 0.0), ("a", "accepted", 4, 60.0, 14.0), ("b", "raw", 2, 30.0, 0.0)], "k string, alarm_set string, n long, span double, least double")
    null = sequential.simulated(sets)
    got = {(r.k, r.alarm_set): r for r in null.groupBy("k", "alarm_set").agg(F.count("*").alias("n"), F.min("gap_min").alias("least"), F.avg("gap_mean").alias("mean"), F.avg("gap_share").alias("share")).collect()}
    assert set(got) == {("a", "raw"), ("a", "accepted")} and all(r.n == 5000 for r in got.values())
    # Mean gap of n uniform alarms: span / (n + 1), on the line shortened by the minimum gaps.
    assert got["a", "raw"].mean == pytest.approx(30 / 6, rel=0.03) and got["a", "raw"].least < 1
    assert got["a", "accepted"].mean == pytest.approx(14 + 18 / 5, rel=0.03) and got["a", "accepted"].least >= 14 - 1e-9
    stats = spark.createDataFrame([("a", "raw", 5.0, 99.0, 1.0), ("a", "accepted", 17.0, 0.0, 0.0), ("b", "raw", 1.0, None, 0.0)], "k string, alarm_set string, gap_mean double, gap_cv double, gap_share double")
    ranks = {(r.k, r.alarm_set): (r.cv_rank, r.share_rank) for r in sequential.ranked(stats, null).collect()}
    assert ranks["a", "raw"] == (1.0, 1.0) and ranks["b", "raw"] == (None, None)
    none_in_edge = null.filter("k = 'a' AND alarm_set = 'accepted' AND gap_share = 0").count() / 5000
    assert ranks["a", "accepted"] == (0.0, none_in_edge)


def test_seasonal_naive(spark):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([10, 20, 11, 21, 12, 22, 0, 0])], "k string, pos long, y double")
    got = rows.select("pos", forecast.seasonal_naive(season=2).alias("p")).orderBy("pos").collect()
    assert [r.p for r in got][-2:] == [12, 22]
    assert forecast.SeasonalNaive(2).fit([10, 20, 11, 21, 12, 22]).predict(3) == [12, 22, 12]


def test_forecasts_do_not_see_the_future(spark):
    def run(tail):
        rows = spark.createDataFrame([("a", i, i * H, float(i % 48) if i < 800 else tail) for i in range(848)], "k string, pos long, slot long, y double")
        return [r.p for r in harmonic.forecasts(rows, 752).orderBy("pos").collect()]

    found = run(1.0)
    assert len(found) == 96 and found == run(99.0)


def test_profile_of_a_weekly_shape(spark):
    shape = [100, 110, 120, 130, 140, 60, 70]
    days = [(dt.datetime(2019, 1, 1) + dt.timedelta(days=i)) for i in range(1461)]
    rows = spark.createDataFrame([(d, float(shape[d.weekday()])) for d in days], "ts timestamp_ntz, y double")
    out = profile.apply(rows, profile.fit(rows)).agg(F.max(F.abs("residual")).alias("m")).first()
    assert out.m < 2.0  # smoothing over 31 days leaves a little of the weekly shape
    leap = spark.createDataFrame([(dt.datetime(2020, 2, 29),), (dt.datetime(2020, 3, 1),), (dt.datetime(2020, 12, 31),), (dt.datetime(2021, 12, 31),)], "ts timestamp_ntz")
    assert [r.d for r in leap.select(profile.season_day(F.col("ts")).alias("d")).collect()] == [59.5, 60.0, 365.0, 365.0]


def test_synthetic_series_and_change_points(spark):
    for kind, want in (("sudden", [5000]), ("gradual", [5000, 6000]), ("recurring", [6666, 13333])):
        assert S.synthetic(spark, kind, 20_000)[1] == want
    a, b = (S.synthetic(spark, "sudden", 5000, 1.0, 3)[0].repartition(n).agg(F.sum("y")).first()[0] for n in (1, 5))
    assert a == pytest.approx(b)


@pytest.mark.parametrize(("name", "kind", "low", "high"), [("page_hinkley", "sudden", 40, 75), ("adwin", "sudden", 130, 140), ("kswin", "sudden", 20, 60)])
def test_detection_delays_on_the_benchmark(name, kind, low, high):
    n, t = 20_000, np.arange(20_000)
    delays, false = [], 0
    for seed in range(1, 3):
        y = 20 + 5 * np.sin(2 * np.pi * t / 48) + np.where(t >= n // 4, 8.0, 0.0) + np.random.default_rng(seed).normal(0, 1, n)
        found = matching.match_positions([n // 4], detectors.SELECTED[name]().detect(y), n)
        delays.append(found["delay"])
        false += found["false_alarms"]
    assert low <= np.mean(delays) <= high and false == 0


def test_tuning_runs_the_grid_under_its_gates(spark):
    names = [name for name, _ in tuning.grid()]
    assert [names.count(x) for x in ("adwin", "kswin", "page_hinkley")] == [144, 126, 234]
    assert all(tuning.MAKE[name](**params).statistic is None for name, params in tuning.grid())
    good = ("page_hinkley", {"min_instances": 20, "delta": 1e-4, "threshold": 600.0, "alpha": 0.9995, "mode": "both"})
    jumpy, deaf = (("page_hinkley", good[1] | {"threshold": x}) for x in (20.0, 1e9))
    assert good in tuning.grid()
    rows = tuning.sweep(spark, [good, jumpy, deaf]).collect()
    kinds = lambda config: {r.kind: (r.runs, r.eligible) for r in rows if r.params == json.dumps(config[1], sort_keys=True)}
    assert kinds(good) == {k: (5, True) for k in tuning.KINDS}
    assert kinds(jumpy) == {"none": (5, False)} and kinds(deaf) == {"none": (5, False), "sudden": (5, False)}


def test_an_alarm_makes_the_detector_fresh():
    y = list(np.random.default_rng(0).normal(0, 1, 400)) + list(np.random.default_rng(1).normal(9, 1, 400))
    make = lambda: detectors.PageHinkley(20, 0.005, 20.0, 0.9999)
    hits = make().detect(y)
    assert hits and make().detect(y[hits[0] + 1 :]) == [h - hits[0] - 1 for h in hits[1:]]


def test_retraining_rows(spark):
    history = spark.createDataFrame([("a", d * S.DAY) for d in range(100) for _ in range(48)], "k string, day long")
    every = adapt.EveryDays(30)
    marks = every.boundaries(history, None)
    assert sorted(r.day // S.DAY for r in marks.collect()) == [29, 59, 89]
    assert adapt.accounting(history, marks, 30).first()[1:] == (3, 3 * 30 * 48)
    triggers = spark.createDataFrame([("a", d * S.DAY) for d in (10, 99)], "k string, day long")
    assert [r.day // S.DAY for r in adapt.OnTrigger().boundaries(history, triggers).collect()] == [10]
    assert adapt.accounting(history, adapt.OnTrigger().boundaries(history, triggers), None).first()[1:] == (1, 11 * 48)


def test_ledger(spark, tmp_path):
    assert ledger.config_hash({"b": 1, "a": 2}) == ledger.config_hash({"a": 2, "b": 1}) and len(ledger.config_hash({})) == 12
    rows = spark.createDataFrame([("m/A/fixed", 1, 5.0), ("m/A/fixed", 2, 7.0), ("m/B", 2, None)], "method string, timestamp long, v double")
    assert ledger.latest_runs(rows, ["method"]).count() == 2
    assert rows.select(*ledger.split_method()).collect()[2].uq is None


def test_texts_of_values_midway(spark):
    """As SQL's printf: by the exact binary value, to the even digit from exactly midway; a group of 1,250 and more has no commas."""
    import duckdb

    values = [1.25, 0.15, 26.95, 28.25, 28.35, 0.75, 0.0, -0.04, 1250.25, 1234567.85, 0.0625, 0.9975]
    rows = spark.createDataFrame([(v, v, 2) for v in values], "m double, sd double, n int")
    for digits in (1, 3):
        want = [duckdb.execute(f"SELECT printf('%.{digits}f ± %.{digits}f', ?::DOUBLE, ?::DOUBLE)", [v, v]).fetchone()[0] for v in values]
        assert [x[0] for x in rows.select(ledger.mean_sd_text("m", "sd", "n", digits)).collect()] == want


def test_texts_without_digits(spark):
    """As SQL's printf: no point without digits, also where there is one run or none; to the even digit from midway."""
    import duckdb

    values = [0.0, 0.4, 0.5, 1.5, 2.5, 23.5, 24.0, -0.4, -7.5, 999.5, 1250.0, 1234567.85]
    rows = spark.createDataFrame([(v, v, n) for v in values for n in (2, 1, 0)], "m double, sd double, n int")
    want = [duckdb.execute(f"SELECT printf('%.0f ± {sd}', {', '.join(['?::DOUBLE'] * len(of))})", of).fetchone()[0] for v in values for sd, of in (("%.0f", [v, v]), ("n/a", [v]))]
    got = [x[0] for x in rows.select(ledger.mean_sd_text("m", "sd", "n", 0)).collect()]
    assert [x for i, x in enumerate(got) if i % 3 < 2] == want and set(got[2::3]) == {"n/a"}


def test_cells_of_the_reports_equal_their_sql(spark):
    """rp_t4's digits: mean and deviation of several runs, of one and of none, midway values among them."""
    import duckdb

    from tidemark.plans import reports

    runs = [("a", 23.0), ("a", 24.0), ("b", 24.5), ("c", None), ("d", -0.125), ("d", -0.125), ("e", 1250.0), ("e", 3.25), ("e", None)]
    rows, values = spark.createDataFrame(runs, "k string, v double"), ", ".join(f"('{k}', {'NULL' if v is None else v}::DOUBLE)" for k, v in runs)
    for digits in (0, 1, 2):
        got = reports._cells(rows.groupBy("k").agg(reports._cell("v", digits)), cell=("v", digits)).orderBy("k").collect()
        want = duckdb.execute(f"SELECT k, {reports._text('v', digits)} FROM (VALUES {values}) t(k, v) GROUP BY k ORDER BY k").fetchall()
        assert [tuple(x) for x in got] == want


def test_missing_columns_and_values_fail(spark):
    with pytest.raises(ValueError, match="missing"):
        clean.require(spark.range(1), ["x"])
    with pytest.raises(Exception, match="missing value"):
        spark.createDataFrame([(1.0, None)], "y double, p double").agg(metrics.mae()).collect()


def test_stage_plan():
    from tidemark.plans import stages

    chosen, left = stages.select(stages.STAGES)
    assert [s.name for s in chosen] == ["data", "detect", "escalation", "produce"] and len(left) == 4
    assert [s.name for s in stages.select(stages.STAGES, ["adapt", "data"])[0]] == ["data", "adapt"]
    with pytest.raises(ValueError, match="unknown"):
        stages.select(stages.STAGES, ["x"])

    def fail():
        raise RuntimeError("no")

    plan = [stages.Stage("a", run=fail), stages.Stage("b", ("a",), run=lambda: None), stages.Stage("c", run=lambda: None)]
    assert [o for _, o in stages.execute(plan, keep_going=True)] == ["failed: no", "skipped", "done"]
    assert [o for _, o in stages.execute(plan)] == ["failed: no", "skipped", "skipped"]


def test_levels():
    assert conformal.check_level(0.1) == 0.1
    for bad in (0, 1, -0.5, 2):
        with pytest.raises(ValueError, match="level"):
            conformal.check_level(bad)
