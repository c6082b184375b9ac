import random

from tidemark.operators import matching
from tidemark.sources.series import DAY


def accepted_by_hand(times, refractory):
    last, out = None, []
    for t in sorted(set(times)):
        if last is None or t >= last + refractory:
            last = t
            out.append(t)
    return out


def test_debounce_equals_a_walk(spark):
    rng = random.Random(4)
    keys = {"hot": [rng.randrange(20_000) for _ in range(3_000)], "b": [5, 5, 5, 15, 14], "one": [7], None: [1, 2, 30], "chain": list(range(0, 640, 10))}
    rows = spark.createDataFrame([(k, t) for k, ts in keys.items() for t in ts] + [("b", None)], "k string, us long").repartition(7)
    for refractory in (1, 10, 500):
        found = matching.debounced(rows, refractory=refractory).collect()
        assert sorted(map(repr, {(r.k, r.us) for r in found})) == sorted(map(repr, {*((k, t) for k, ts in keys.items() for t in ts), ("b", None)}))
        assert sum(r.n for r in found) == sum(map(len, keys.values())) + 1
        for k, ts in keys.items():
            assert sorted(r.us for r in found if r.k == k and r.accepted) == accepted_by_hand(ts, refractory)
    assert {r.us for r in matching.debounced(rows, refractory=0).collect() if r.k == "b" and r.accepted} == {5, 14, 15}
    assert matching.debounced(rows.limit(0), refractory=5).collect() == []


def test_match_equals_a_walk(spark):
    rng = random.Random(6)
    alarms = {k: sorted(rng.sample(range(40 * DAY), n)) for k, n in (("a", 25), ("b", 4), ("quiet", 0), ("free", 3))}
    events = {k: [(f"E{i}", rng.choice([1, 2]), s := rng.randrange(30 * DAY), s + rng.randrange(1, 9 * DAY)) for i in range(n)] for k, n in (("a", 12), ("b", 9), ("quiet", 2))}
    a = spark.createDataFrame([(k, t) for k, ts in alarms.items() for t in ts], "k string, us long")
    w = spark.createDataFrame([(k, *e) for k, es in events.items() for e in es], "k string, event_id string, tier int, drift_start long, match_end long")
    want = set()
    for k, ts in alarms.items():
        left = list(ts)
        for name, tier, start, stop in sorted(events.get(k, []), key=lambda e: (e[1], e[2], e[0])):
            hit = next((t for t in left if start <= t < stop), None)
            if hit is not None:
                left.remove(hit)
                want.add((k, hit, "Match", name, tier, (hit - start) / DAY))
        want |= {(k, t, "Unmatch", None, None, None) for t in left}
    assert {tuple(r) for r in matching.greedy_match(a, w).collect()} == want
    assert {r.label for r in matching.greedy_match(a, w.limit(0)).collect()} == {"Unmatch"}
    assert matching.greedy_match(a.limit(0), w).collect() == []
