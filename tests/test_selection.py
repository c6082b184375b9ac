import random

from tidemark.operators import conformal, selection


def test_equals_sorting(spark):
    rng = random.Random(1)
    series = {
        "plain": [rng.gauss(0, 1) for _ in range(3_000)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 3.5]) for _ in range(500)],
        "wide": [s * 10.0 ** rng.uniform(-30, 30) for s in (-1, 1) for _ in range(50)] + [1.7e308, -1.7e308, 5e-324, 0.0, 1e-323],
        "one": [7.0],
        "odd": [None, float("nan"), float("inf"), 4.0, 3.0],
    }
    df = spark.createDataFrame([(k, v, "x") for k, vs in series.items() for v in vs], "k string, v double, rank string").repartition(5)
    wanted = [(k, r) for k in series for r in (1, 2, 55, 499, 3_000, 3_001, 0)]
    found = {(r.k, r["rank"]): r.value for r in selection.kth_smallest(df, spark.createDataFrame([*wanted, wanted[0]], "k string, rank long")).collect()}
    kept = {k: sorted(v for v in vs if v is not None and abs(v) < float("inf")) for k, vs in series.items()}
    assert found == {(k, r): kept[k][r - 1] for k, r in wanted if 1 <= r <= len(kept[k])}


def test_radii_equal_the_sorted_ones(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, rng.gauss(0, 3)) for k, n in (("a", 400), ("b", 9), ("c", 3)) for _ in range(n)], "k string, score double")
    assert sorted(selection.radii(df, 0.1).collect()) == sorted(conformal.radii(df, 0.1).collect())


def test_quantiles(spark):
    import numpy as np

    rng = random.Random(3)
    series = {"a": [rng.gauss(0, 1) for _ in range(701)], "b": [2.0], "c": [1.0, 1.0, 5.0]}
    df = spark.createDataFrame([(k, v) for k, vs in series.items() for v in vs], "k string, v double")
    for q in (0.0, 0.37, 0.99, 1.0):
        found = {r.k: r.q for r in selection.quantiles(df, q).collect()}
        assert set(found) == set(series) and all(abs(found[k] - np.quantile(vs, q)) < 1e-12 for k, vs in series.items())


def test_nothing_to_select(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert selection.kth_smallest(empty, spark.createDataFrame([("a", 1)], "k string, rank long")).collect() == []
