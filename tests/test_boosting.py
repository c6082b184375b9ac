import math
import random

import pytest

from tidemark.operators import boosting
from tidemark.sources import series as S

W = S.HALF_HOUR
START = 60 * W


def grid(spark, rows):
    return spark.createDataFrame(rows, "k string, slot long, y double").repartition(3)


def test_recursion_by_hand(spark):
    """Every fifth value is high. One tree of one split copies the value five slots earlier, each key on its own scale; a
    block of seven needs two of its own forecasts, and the next block sees values instead, which all are low."""
    keys = (("a", 0.0, 10.0), ("b", 100.0, 2.0))
    rows = [(k, i * W, low + (high if i % 5 == 0 else 0.0)) for k, low, high in keys for i in range(60)]
    rows += [(k, i * W, low) for k, low, _ in keys for i in range(60, 75)]
    rows += [("late", i * W, 1.0) for i in range(61, 65)]
    series = boosting.scaled(grid(spark, rows), START)
    model = boosting.fit(series, lags=(5,), trees=1, depth=1, step=1.0, share=1.0)
    found = {(r.k, r.slot // W): r.p for r in boosting.recursive(series, model, lags=(5,), block=7).collect()}
    # 60 and, from the forecast for 60, 65; from 67 on all that is seen is low.
    assert set(found) == {(k, i) for k, *_ in keys for i in range(60, 75)}
    for k, low, high in keys:
        assert all(abs(found[k, i] - (low + (high if i in (60, 65) else 0.0))) < 1e-9 for i in range(60, 75))


def test_features(spark):
    """Lags over gaps and before the first slot are MISSING, pieces do not matter, and the calendar is the slot's own."""
    start = S.stamp("2024-02-05")
    rows = [("a", start + i * W, None if i == -2 else float(i)) for i in range(-6, 3)]
    series = boosting.scaled(grid(spark, rows), start)
    few, one = ({r.place: list(r.features) for r in boosting.lag_rows(series, (1, 3), n).collect()} for n in (3, 100))
    z = {r.place: r.z for r in series.collect()}
    assert few == one and len(one) == 9
    assert one[-6] == [boosting.MISSING, boosting.MISSING, 21.0, 0.0, 6.0, 2.0]
    assert one[-1] == [boosting.MISSING, z[-4], 23.0, 30.0, 6.0, 2.0]
    assert one[1] == [z[0], boosting.MISSING, 0.0, 30.0, 0.0, 2.0]


def test_missing_values_take_their_own_branch(spark):
    rng = random.Random(3)
    y, rows = None, []
    for i in range(1, 400):
        y = rng.choice([None, 1.0, 2.0]) if y is not None else 9.0
        rows.append(("a", i * W, y))
    series = boosting.scaled(grid(spark, rows), 360 * W)
    model = boosting.fit(series, lags=(1,), trees=3, depth=2, share=1.0)
    found = {r.slot: r.p for r in boosting.recursive(series, model, lags=(1,), block=1).collect()}
    before = {s: v for _, s, v in rows}
    gaps = [s for s in found if before[s - W] is None]
    assert gaps and all(abs(found[s] - 9.0) < 0.5 for s in gaps)
    assert all(found[s] < 5 for s in found if s not in gaps)


def test_learns_a_season_and_stops(spark):
    rng = random.Random(1)
    rows = [("a", i * W, None if rng.random() < 0.1 else 100 + 20 * math.sin(2 * math.pi * i / 48) + rng.gauss(0, 1)) for i in range(1, 849)]
    start = 801 * W
    series = boosting.scaled(grid(spark, rows), start)
    model = boosting.fit(series, lags=(1, 2, 48), trees=8)
    found = boosting.recursive(series, model, lags=(1, 2, 48)).collect()
    known = [y for _, s, y in rows if s < start and y is not None]
    mean = sum(known) / len(known)
    assert len(found) == sum(y is not None for _, s, y in rows if s >= start)
    assert sum(abs(r.p - r.y) for r in found) < len(found) * 4 < sum(abs(mean - r.y) for r in found)


def test_nothing_to_learn_from(spark):
    with pytest.raises(ValueError, match="no values"):
        boosting.fit(boosting.scaled(grid(spark, [("a", i * W, None) for i in range(5)]), START))
    flat = boosting.scaled(grid(spark, [("a", i * W, 3.0) for i in range(90)]), START)
    found = boosting.recursive(flat, boosting.fit(flat, lags=(1,), trees=2), lags=(1,), block=4).collect()
    assert len(found) == 30 and all(abs(r.p - 3.0) < 1e-9 for r in found)
