"""Arms that refit, folds, locks and files from outside."""

import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from tidemark.operators import adapt, folds, forecast, ledger, regimes
from tidemark.sources import external, shared
from tidemark.sources import series as S

H, DAY = S.HALF_HOUR, S.DAY
START = S.stamp("2020-03-03")


def sizes():
    """A forecaster that says how many values it was fitted on; a local class, which executors get by value."""

    class Fits(forecast.Forecaster):
        def fit(self, y):
            self.n = len(y)
            return self

        def predict(self, n):
            return [float(self.n)] * n

        def observe(self, y):
            pass

    return Fits


def half_hours(spark, days, start="2020-03-02", key="a"):
    rows = [(key, i, S.stamp(start) + i * H, (S.stamp(start) + i * H) // DAY * DAY, float(i)) for i in range(48 * days)]
    return spark.createDataFrame(rows, "k string, pos long, slot long, day long, y double")


def test_a_trigger_refits_at_the_end_of_its_day(spark):
    series = half_hours(spark, 6)
    days = [S.stamp(d) for d in ("2020-03-01", "2020-03-04", "2020-03-04", "2020-03-07")]
    triggers = spark.createDataFrame([("a", d) for d in days], "k string, day long")
    boundaries = adapt.OnTrigger().boundaries(series, triggers)
    rows = {r.slot: r for r in adapt.arm_forecasts(series, boundaries, sizes(), START).collect()}
    assert len(rows) == 5 * 48 and min(rows) == START
    last_old, first_new = rows[S.stamp("2020-03-04T23:30")], rows[S.stamp("2020-03-05")]
    assert (last_old.p, last_old.model) == (48.0, None)
    # Fitted on all up to the end of the trigger's day; the trigger on the last day does nothing.
    assert (first_new.p, first_new.model, first_new.train_rows) == (144.0, S.stamp("2020-03-04"), 144)
    assert {r.model for r in rows.values()} == {None, S.stamp("2020-03-04")}
    recent = adapt.arm_forecasts(series, boundaries, sizes(), START, 2).filter(f"slot = {S.stamp('2020-03-05')}").first()
    assert recent.train_rows == 96
    cost = adapt.arm_costs(adapt.arm_forecasts(series, boundaries, sizes(), START)).first()
    assert (cost.n_retrains, cost.train_samples, cost.retrained) == (1, 144, [S.stamp("2020-03-04")]) and cost.fit_seconds > 0


def test_an_arm_without_boundaries_or_history(spark):
    series = half_hours(spark, 3).unionByName(half_hours(spark, 1, "2020-03-05", "b"))
    none = adapt.NeverRetrain().boundaries(series, None)
    rows = adapt.arm_forecasts(series, none, sizes(), START).collect()
    assert {r.k for r in rows} == {"a"} and len(rows) == 96
    assert adapt.arm_forecasts(series.limit(0), none, sizes(), START).collect() == []


def test_recursive_forecasts_feed_their_lags():
    y = [1.0, 1.0]
    while len(y) < 15:
        y.append(y[-1] + y[-2])
    model = forecast.LinearAr(lags=2, penalty=1e-9).fit(y[:12])
    assert [round(x, 2) for x in model.predict(3)] == y[12:]
    model.observe(y[12:13])
    assert round(model.predict(1)[0], 2) == y[13]


def test_folds_see_each_key_in_order(spark):
    rows = spark.createDataFrame([(k, (i * 7) % 50, i) for k in "abc" for i in range(50)], "k string, pos long, v long").repartition(5)

    def start():
        seen = []

        def step(pos, v):
            assert not seen or seen[-1] < pos
            seen.append(pos)
            return (len(seen),) if len(seen) == 50 else None

        return step

    assert sorted(map(tuple, folds.folded(rows, ["pos"], start, "k string, n long").collect())) == [("a", 50), ("b", 50), ("c", 50)]
    assert folds.folded(rows.limit(0), ["pos"], start, "k string, n long").collect() == []


def test_regimes_equal_a_search_of_every_event(spark):
    import random

    rng = random.Random(1)
    events = []
    for i in range(12):
        a = rng.randrange(60)
        events.append((f"E{i}", f"2020-{3 + a // 30:02d}-{1 + a % 30:02d}", f"2020-{3 + a // 30:02d}-{min(30, 1 + a % 30 + rng.randrange(4)):02d}", "date_range", "x", 1))
    w = regimes.event_windows(S.catalogue(spark, events)).collect()
    slots = [S.stamp("2020-02-20") + n * 7 * H for n in range(700)]
    series = spark.createDataFrame([("a", t) for t in slots], "k string, slot long")
    table = spark.createDataFrame(w)
    found = {r.slot: (r.regime, r.event_id) for r in regimes.global_regimes(series, table).collect()}
    near = {r.slot: (r.regime, r.event_id) for r in regimes.local_regimes(series, table).collect()}
    for t in slots:
        inside = [(e.drift_start, e.event_id) for e in w if e.drift_start <= t < e.drift_end]
        past = [(-e.drift_start, e.event_id) for e in w if e.drift_end <= t]
        want = ("drift", min(inside)[1]) if inside else ("post_drift", min(past)[1]) if past else ("pre_drift", min((e.drift_start, e.event_id) for e in w)[1])
        assert found[t] == want
        kinds = [(1 if e.drift_start <= t < e.drift_end else 2 if t < e.drift_start else 3, e.drift_start, e.event_id) for e in w if e.pre_start <= t < e.post_end]
        assert near.get(t) == ((("drift", "pre_drift", "post_drift")[min(kinds)[0] - 1], min(kinds)[2]) if kinds else None)
    assert regimes.global_regimes(series, table.limit(0)).collect() == regimes.local_regimes(series, table.limit(0)).collect() == []


def test_a_lock_is_held_by_one(spark, tmp_path):
    path, inside, most = f"file://{tmp_path}/x.lock", [], []

    def hold(n):
        with shared.locked(spark, path):
            inside.append(n)
            time.sleep(0.1)
            most.append(len(inside))
            inside.remove(n)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(hold, range(8)))
    assert most == [1] * 8
    assert not shared.exists(spark, path)
    with shared.locked(spark, path), pytest.raises(TimeoutError), shared.locked(spark, path, 0.2):
        pass


def test_files_from_outside(spark, tmp_path):
    path = f"{tmp_path}/x.csv"
    assert external.optional_csv(spark, path, "a string, b long").collect() == []
    (tmp_path / "x.csv").write_text("a,b\nq,1\n")
    assert [tuple(r) for r in external.optional_csv(spark, path, "a string, b long").collect()] == [("q", 1)]
    first = external.cached_csv(spark, path, "a string, b long")
    assert external.cached_csv(spark, path, "a string, b long") is first


def test_a_run_is_a_forecast_or_a_detection(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0)], "k string, y double, p double")
    assert {r.metric_name: r.metric_value for r in ledger.record(forecasts=rows).collect()} == {"mae": 1.0, "pinball": 0.5}
    for both in ({}, {"forecasts": rows, "matches": rows}):
        with pytest.raises(ValueError, match="either"):
            ledger.record(**both)
    assert ledger.split_id("uq", "adwin", "score") == "uq_adwin_score_v1" and ledger.readable_ids("uq_adwin_v1") == ("uq_adwin_v1", "uq_v1")
