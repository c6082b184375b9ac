import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import clean, spread, windows


def skewed(spark, n=3_000):
    """One key holds most rows; orders are distinct in a key and have holes."""
    rng = random.Random(5)
    rows = [(k, i * 3 + rng.randrange(3), rng.choice([None, 1, 2, 3]), rng.gauss(0, 1)) for k, m in (("hot", n), ("b", 40), ("c", 1), (None, 7)) for i in range(m)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, at long, v int, x double").repartition(6)


def test_pieces_are_even_ranges(spark):
    cut = spread.ranged(skewed(spark), "at", pieces=8)
    sizes = [r["count"] for r in cut.groupBy("_piece").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 1_000
    spans = cut.filter("k = 'hot'").groupBy("_piece").agg(F.min("at").alias("a"), F.max("at").alias("b")).orderBy("_piece").collect()
    assert len(spans) > 3 and all(p.b < q.a for p, q in zip(spans, spans[1:], strict=False))


def test_running_numbers_and_lags_equal_whole_windows(spark):
    rows = skewed(spark)
    w = Window.partitionBy("k").orderBy("at")
    want = rows.select("k", "at", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), (F.row_number().over(w) - 1).alias("pos"), F.lag("v").over(w).alias("before"))
    wanted = {tuple(r) for r in want.collect()}
    for pieces in (1, 7, 50):
        summed = spread.running(rows, {"s": F.col("v")}, "at", pieces=pieces)
        both = spread.lagged(spread.numbered(summed, "at", pieces=pieces), {"before": "v"}, "at", pieces=pieces)
        assert both.columns == ["k", "at", "v", "x", "s", "pos", "before"]
        assert {tuple(r) for r in both.select("k", "at", "s", "pos", "before").collect()} == wanted
    empty = rows.limit(0)
    assert spread.numbered(empty, "at").collect() == [] and spread.lagged(empty, {"b": "v"}, "at").collect() == []


def test_windows_over_pieces_equal_whole_windows(spark):
    rows = spread.numbered(skewed(spark), "at").filter("k IS NOT NULL")
    want = {tuple(r) for r in rows.select("k", "at", F.round(windows.rolling_mean(F.col("x"), 20), 9)).collect()}
    for size in (5, 64, 10_000):
        cut = spread.haloed(rows, 19, size)
        mean = F.round(windows.rolling_mean(F.col("x"), 20, spread.by_piece()), 9)
        found = spread.own(cut.withColumn("m", mean)).select("k", "at", "m").collect()
        assert len(found) == len(want) and {tuple(r) for r in found} == want
    pieces = spread.haloed(rows, 19, 64).groupBy("k", "_piece").count()
    assert pieces.count() > 40 and pieces.agg(F.max("count")).first()[0] <= 64 + 19


def test_audit_of_a_skewed_key(spark):
    rng = random.Random(9)
    times = [i + rng.choice([0, 0, 0, -5, 4]) for i in range(2_000)]
    rows = [("a", i, t) for i, t in enumerate(times)] + [("b", 1, 5), ("b", 2, None), ("b", 3, 4)]
    df = spark.createDataFrame(rows, "k string, arrival long, s long").select("k", "arrival", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts")).repartition(5)
    late = sum(b < a for a, b in zip(times, times[1:], strict=False))
    assert {r.k: r.out_of_order for r in clean.out_of_order(df, "k", "ts", "arrival").collect()} == {"a": late, "b": 0}
    distinct = sorted(set(times))
    steps = [(b * 1_000_000, (b - a) * 1_000_000) for a, b in zip(distinct, distinct[1:], strict=False) if b - a != 1]
    assert sorted((r.us, r.step) for r in clean.cadence(df.filter("k = 'a'"), "k", "ts", 1_000_000).collect()) == steps


def test_counts_by_score(spark):
    df = spark.createDataFrame([("a", float(s), s % 3 == 0) for s in [5, 1, 1, 2, 9, 9, 9]] + [("b", 1.0, True)], "k string, s double, hit boolean")
    found = windows.cumulative_by_score(df, "s", F.col("hit")).collect()
    assert sorted(map(tuple, found)) == [("a", 1.0, 2, 0), ("a", 2.0, 3, 0), ("a", 5.0, 4, 0), ("a", 9.0, 7, 3), ("b", 1.0, 1, 1)]


def test_worst_day_lies_inside_one_regime(spark):
    """48 half-hours without a gap and of one regime make a complete window; of pieces, too."""
    from tidemark.plans.reports import _coverage_table
    from tidemark.sources.series import HALF_HOUR

    rows = []
    for i in range(300):
        slot = (i + (1 if i >= 200 else 0)) * HALF_HOUR
        missed = 100 <= i < 112 or 240 <= i
        rows.append(("a", i, slot, 9.0 if missed else 0.5, 0.0, 1.0, "drift" if 60 <= i < 200 else "post_drift" if i >= 200 else "pre_drift"))
    df = spark.createDataFrame(rows, "k string, pos long, slot long, y double, lower double, upper double, regime string")
    scale = spark.createDataFrame([("a", 4.0)], "k string, scale double")
    for size in (50, 1_000):
        found = {x.regime: x for x in _coverage_table(spread.haloed(df, 47, size), scale).collect()}
        assert {n: x.complete_windows for n, x in found.items()} == {"pre_drift": 60 - 47, "drift": 140 - 47, "post_drift": 100 - 47}
        assert {n: x.worst_24h for n, x in found.items()} == {"pre_drift": 1.0, "drift": 0.75, "post_drift": 0.0}
        assert found["drift"].norm_width == 0.25 and found["drift"].coverage == round(128 / 140, 6)
