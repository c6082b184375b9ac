import random
from collections import deque

import numpy as np
import pytest

from tidemark.operators import detectors, injection, matching, tuning


def kswin_by_the_book(alpha, size, stat, values):
    """The test written out: a window as a list, samples from it, a merge of two sorted lists."""
    alarms, critical, window, draw = [], detectors.ks_critical(stat, alpha), deque(maxlen=size), random.Random(42)
    for place, x in enumerate(values):
        window.append(x)
        if len(window) < size:
            continue
        whole = list(window)
        old, new = draw.sample(whole[: size - stat], stat), whole[-stat:]
        most = max(abs(sum(a <= v for a in old) - sum(a <= v for a in new)) for v in old + new)
        if most >= critical and most / stat > 0.1:
            alarms.append(place)
            window, draw = deque(maxlen=size), random.Random(42)
    return alarms


def shifted(seed, n=600):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 1, n), rng.normal(2, 1, n), rng.normal(0, 1, n // 2)]).round(1)


@pytest.mark.parametrize(("size", "stat"), [(100, 30), (90, 45), (60, 10)])
def test_kswin_alone_and_in_banks(size, stat):
    values, alphas, rng = shifted(1), [1e-4, 1e-9, 0.01, 0.01], random.Random(2)
    want = [kswin_by_the_book(a, size, stat, values.tolist()) for a in alphas]
    assert any(want) and [detectors.Kswin(a, size, stat).detect(values) for a in alphas] == want
    bank, found, at = detectors.KswinBank(alphas, size, stat), [], 0
    while at < len(values):
        step = rng.choice([1, 7, 200, 500])
        found += bank.feed(values[at : at + step])
        at += step
    assert [sorted(p for i, p in found if i == level) for level in range(len(alphas))] == want


def test_page_hinkley_in_a_bank():
    values = shifted(3)
    configs = [{"min_instances": n, "delta": d, "threshold": t, "alpha": a, "mode": m} for n in (20, 50) for d in (1e-4, 0.05) for t in (20.0, 60.0) for a in (0.99, 0.9999) for m in ("both", "up", "down")]
    bank = detectors.PageHinkleyBank(configs)
    found = bank.feed(values[:777]) + bank.feed(values[777:])
    assert [[p for j, p in found if j == i] for i in range(len(configs))] == [detectors.PageHinkley(**c).detect(values) for c in configs]


@pytest.fixture
def residuals(spark):
    rng = random.Random(4)
    rows = [(k, i, round(rng.gauss(0, 1), 6)) for k, n in (("a|b", 500), ("c", 47), ("d", 48)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, pos long, e double").repartition(3)


def test_injected_series(residuals):
    rows, df = residuals
    e = {(k, i): x for k, i, x in rows}
    got = {(r.k, r.kind, r.seed, r.pos): (r.n, r.y) for r in injection.injected(df, seeds=(1, 2)).collect()}
    assert len(got) == (480 + 48) * 4 * 2 and {k for k, *_ in got} == {"a|b", "d"}
    for (k, kind, seed, pos), (n, y) in got.items():
        blocks, b = n // 48, pos // 48
        base = e[k, (31 * b * b + 17 * b * seed + 7 * seed + 3) % blocks * 48 + pos % 48]
        part = {"none": 0, "sudden": pos >= n // 4, "gradual": min(1, max(0, (pos - n // 4) / (n // 4))), "recurring": n // 3 <= pos < 2 * n // 3}[kind]
        assert y == pytest.approx(base + 4 * part, abs=2e-6)


def test_scores_equal_matching_by_position(spark):
    rng, n = random.Random(5), 1200
    series, alarms, want = [], [], {}
    for number, kind in enumerate(injection.KINDS * 3):
        hits = sorted(rng.sample(range(n), rng.choice([0, 3, 40])))
        points = {"none": [], "sudden": [300], "gradual": [300, 600], "recurring": [400, 800]}[kind]
        found = matching.match_positions(points, hits, n, tolerance=200, gradual=(300, 600) if kind == "gradual" else None, grace=200)
        want[number] = (found["matched"], found["missed"], found["false_alarms"], found["delay"])
        series.append((number, kind, n))
        alarms += [(number, h) for h in hits]
    from pyspark.sql import functions as F

    heads = spark.createDataFrame(series, "id int, kind string, n long").withColumn("changes", injection.changes(F.col("kind"), F.col("n")))
    out = injection.scored(heads, spark.createDataFrame(alarms, "id int, pos long"), ["id"])
    assert {r.id: (r.matched, r.missed, r.false_alarms, r.delay) for r in out.collect()} == want


def test_sweep_over_injected_series(residuals):
    """Gates: a detector that never fires misses every shift; a jumpy one ends on the series without a shift."""
    deaf, jumpy = ("page_hinkley", {"threshold": 1e9}), ("page_hinkley", {"threshold": 0.1, "min_instances": 2})
    rows = tuning.sweep_series(injection.injected(residuals[1]), [deaf, jumpy]).collect()
    kinds = {(r.params, r.kind): r for r in rows}
    assert len(rows) == 3 and not any(r.eligible for r in rows)
    assert {k for _, k in kinds} == {"none", "sudden"} and next(r for r in rows if r.kind == "sudden").missed == 10


def test_summary_and_winners_of_a_sweep(spark):
    schema = "detector string, params string, k string, kind string, seed int, missed long, false_alarms long, false_per_year double, delay double"
    none = [("d", p, "a", "none", s, 0, 0, 0.0, None) for p in "123" for s in (1, 2)] + [("d", "4", "a", "none", 2, 0, 1, 17.0, None), ("d", "4", "b", "none", 1, 0, 0, 0.0, None)]
    drift = [("d", "1", "a", k, 1, 0, 0, 1.0, 8.0) for k in tuning.KINDS[1:]] + [("d", "2", "a", k, 1, 0, 0, 1.0, 4.0) for k in tuning.KINDS[1:]]
    # Both fail on a later kind: the earlier seed's row gives the reason.
    drift += [("d", "3", "a", "sudden", 1, 0, 0, 0.0, 2.0), ("d", "3", "a", "gradual", 2, 1, 0, 0.0, None), ("d", "3", "a", "gradual", 1, 0, 5, 9.0, 3.0)]
    found = tuning.summarised(spark.createDataFrame(none + drift, schema))
    rows = {r.params: r for r in found.collect()}
    assert {p: r.fail_reason for p, r in rows.items()} == {"1": "", "2": "", "3": "over the budget on gradual", "4": "false alarm without drift"}
    assert rows["3"].fa_per_year_gradual == 4.5 and rows["3"].fa_per_year_recurring is None and rows["3"].mean_delay is None
    assert (rows["1"].fa_per_year, rows["1"].mean_delay, rows["4"].most_fa_none) == (0.6, 8.0, 17.0)
    best = {r.detector: (r.params, r.mean_delay, r.status) for r in tuning.winners(found, ["d", "e"]).collect()}
    assert best == {"d": ("2", 4.0, "selected"), "e": (None, None, "no_eligible_configuration")}
    assert [r.status for r in tuning.winners(found.limit(0), ["d"]).collect()] == ["no_eligible_configuration"]


def test_a_broken_sweep_goes_on(residuals, tmp_path):
    """A table of one group is lost: only its configurations run again, and the rows are those of an unbroken sweep."""
    import shutil

    configs = [("page_hinkley", {"threshold": t, "min_instances": 20}) for t in (0.1, 60.0, 1e9)]
    series, _ = tuning.written(injection.injected(residuals[1], seeds=(1, 2)), "series")
    path, key = str(tmp_path / "jobs"), lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    whole = key(tuning.sweep_into(path, series, configs, group=1))
    assert whole == key(tuning.sweep_rows(series, configs))
    shutil.rmtree(f"{path}/part=1")
    kept = series.sparkSession.read.option("basePath", path).parquet(f"{path}/part=0", f"{path}/part=2")
    assert tuning.unfinished(configs, kept) == configs[1:2]
    assert key(tuning.sweep_into(path, series, configs, group=1)) == whole


def test_no_residuals(spark):
    empty = spark.createDataFrame([], "k string, pos long, e double")
    assert injection.injected(empty).collect() == []
