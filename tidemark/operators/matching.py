"""Alarms against events: refractory period, greedy one-to-one matching, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import spread
from tidemark.operators.regimes import REFRACTORY
from tidemark.sources.series import DAY
from tidemark.sources.shared import written

MATCH_SCHEMA = "k string, us long, label string, event_id string, tier int, delay_days double"


def _pointers(times: DataFrame, refractory: int) -> DataFrame:
    """k, us, n, pos, next: an alarm's place in its key and that of the first alarm a refractory period or more later, null if
    there is none. One running count over the alarms and over the times at which they let others pass gives both."""
    marks = times.select("k", F.struct(F.col("us").alias("at"), F.lit(1).alias("is_alarm")).alias("at"), "us", "n").unionByName(
        times.select("k", F.struct((F.col("us") + refractory).alias("at"), F.lit(0).alias("is_alarm")).alias("at"), "us", F.lit(0).cast("long").alias("n"))
    )
    counted = spread.running(marks, {"seen": F.col("at.is_alarm").cast("long")}, "at")
    alarm = F.col("at.is_alarm") == 1
    placed = counted.groupBy("k", "us").agg(F.sum("n").alias("n"), F.max(F.when(alarm, F.col("seen") - 1)).alias("pos"), F.max(F.when(~alarm, F.col("seen"))).alias("next"))
    sizes = times.groupBy(F.col("k").alias("_k")).agg(F.count("*").alias("_size"))
    known = placed.join(sizes, F.col("k").eqNullSafe(F.col("_k"))).drop("_k")
    return known.withColumn("next", F.when(F.col("next") < F.col("_size"), F.col("next"))).drop("_size")


def _reached(chain: DataFrame) -> DataFrame:
    """k, pos of the places that pointers reach from place 0, by doubling: what is found jumps as far as all that was found
    before it, and every jump is then put behind itself. Twice the places are known after each step."""
    jumps = chain.filter("next IS NOT NULL").select("k", "pos", "next")
    found = chain.filter("pos = 0").select("k", "pos")
    while True:
        j = jumps.select(F.col("k").alias("_k"), F.col("pos").alias("_pos"), F.col("next").alias("_next"))
        new, _ = written(found.join(j, F.col("k").eqNullSafe(F.col("_k")) & (F.col("pos") == F.col("_pos"))).select("k", F.col("_next").alias("pos")), "reached")
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        jumps, _ = written(jumps.join(j, F.col("k").eqNullSafe(F.col("_k")) & (F.col("next") == F.col("_pos"))).select("k", "pos", F.col("_next").alias("next")), "jumps")


def debounced(alarms: DataFrame, key: str = "k", time: str = "us", refractory: int = REFRACTORY) -> DataFrame:
    """key, time, accepted, n: an alarm is accepted unless it comes less than the refractory period after an accepted one; of
    equal times, which are one row of n alarms, one at most is accepted. Without a refractory period all are; an alarm without
    a time never is.

    A key's alarms are spread over tasks: each points to the first that may follow it, and the chain of pointers is followed
    in as many steps as doublings it takes to get to its end.
    """
    times = alarms.groupBy(F.col(key).alias("k"), F.col(time).alias("us")).agg(F.count("*").alias("n"))
    if refractory <= 0:
        return times.select(F.col("k").alias(key), F.col("us").alias(time), F.col("us").isNotNull().alias("accepted"), "n")
    times, _ = written(times, "times")
    chain, _ = written(_pointers(times.filter("us IS NOT NULL"), refractory), "pointers")
    hit = _reached(chain).select(F.col("k").alias("_k"), F.col("pos").alias("_pos"))
    flagged = chain.join(hit, F.col("k").eqNullSafe(F.col("_k")) & (F.col("pos") == F.col("_pos")), "left").select("k", "us", F.col("_pos").isNotNull().alias("accepted"), "n")
    timeless = times.filter("us IS NULL").select("k", "us", F.lit(False).alias("accepted"), "n")
    return flagged.unionByName(timeless).select(F.col("k").alias(key), F.col("us").alias(time), "accepted", "n")


def greedy_match(accepted: DataFrame, windows: DataFrame, key: str = "k", time: str = "us") -> DataFrame:
    """key, us, label, event_id, tier, delay_days: events by (tier, start, id) take their first unused alarm in
    [drift_start, match_end); alarms left over are Unmatch. windows has the columns of event_windows and the key. A key's
    accepted alarms have distinct times, its events distinct ids.

    Alarms meet events by key and day. Of an event's alarms only the first can be taken, or as many more as the key has other
    events; these few are what a key's matching sees.
    """
    import pandas as pd

    def match(near: pd.DataFrame) -> pd.DataFrame:
        rows, used = [], set()
        for (tier, start, event), alarms in near.sort_values("us").groupby(["tier", "drift_start", "event_id"]):
            hit = next((t for t in alarms["us"].tolist() if t not in used), None)
            if hit is not None:
                used.add(hit)
                rows.append((near["k"].iloc[0], hit, "Match", event, tier, (hit - start) / DAY))
        out = pd.DataFrame(rows, columns=["k", "us", "label", "event_id", "tier", "delay_days"])
        return out.astype({"tier": "Int32"})

    a = accepted.select(F.col(key).alias("k"), F.col(time).alias("us"))
    w = windows.select("k", "event_id", "tier", "drift_start", "match_end", F.count("*").over(Window.partitionBy("k")).alias("_events"))
    days = w.withColumn("_day", F.explode(F.sequence(F.floor(F.col("drift_start") / DAY), F.floor((F.col("match_end") - 1) / DAY))))
    dated = a.withColumn("_day", F.floor(F.col("us") / DAY))
    near = dated.join(days, ["k", "_day"]).filter(F.col("us").between(F.col("drift_start"), F.col("match_end") - 1))
    turn = F.row_number().over(Window.partitionBy("k", "event_id").orderBy("us"))
    few = near.withColumn("_turn", turn).filter("_turn <= _events").select("k", "us", "event_id", "tier", "drift_start")
    matched, _ = written(few.groupBy("k").applyInPandas(match, MATCH_SCHEMA), "matched")
    none = F.lit(None)
    rest = a.join(matched.select("k", "us"), ["k", "us"], "left_anti")
    return matched.unionByName(rest.select("k", "us", F.lit("Unmatch").alias("label"), none.cast("string").alias("event_id"), none.cast("int").alias("tier"), none.cast("double").alias("delay_days")))


def match_alarms(alarms: DataFrame, windows: DataFrame, refractory: int = REFRACTORY) -> DataFrame:
    """All alarms with a label: Ignored within the refractory period, else Match or Unmatch."""
    flagged = debounced(alarms, refractory=refractory)
    matched = greedy_match(flagged.filter("accepted"), windows)
    ignored = flagged.filter("NOT accepted").select("k", "us", F.lit("Ignored").alias("label"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("int").alias("tier"), F.lit(None).cast("double").alias("delay_days"))
    return matched.unionByName(ignored)


def event_metrics(matches: DataFrame, windows: DataFrame) -> DataFrame:
    """Per key: raw, accepted, matched and unmatched alarms, precision, recall over the key's events, mean delay; null for 0/0."""
    accepted = F.count_if(F.col("label") != "Ignored")
    matched = F.count_if(F.col("label") == "Match")
    counts = matches.groupBy("k").agg(
        F.count("*").alias("raw"), accepted.alias("accepted"), matched.alias("matched"), F.count_if(F.col("label") == "Unmatch").alias("unmatched"),
        F.count_if((F.col("label") == "Match") & (F.col("tier") == 1)).alias("matched_t1"), F.avg("delay_days").alias("mean_delay"),
    )
    events = windows.groupBy("k").agg(F.count("*").alias("events"), F.count_if(F.col("tier") == 1).alias("events_t1"))
    return counts.join(events, "k", "left").select(
        "k", "raw", "accepted", "matched", "unmatched", "mean_delay",
        (F.col("matched") / F.nullif("accepted", F.lit(0))).alias("precision"),
        (F.col("matched") / F.nullif("events", F.lit(0))).alias("recall"),
        (F.col("matched_t1") / F.nullif("events_t1", F.lit(0))).alias("recall_t1"),
    )


def match_positions(points: list[int], alarms: list[int], n: int, tolerance: int = 336, gradual: tuple[int, int] | None = None, grace: int = 336) -> dict:
    """Synthetic streams: each change point takes its first unused alarm in [point, min(n - 1, point + tolerance)]; a
    gradual change is one event from its start to its end plus grace. Delays, misses and false alarms."""
    events = [(gradual[0], min(n - 1, gradual[1] + grace))] if gradual else [(p, min(n - 1, p + tolerance)) for p in sorted(set(points))]
    left, delays = sorted(set(alarms)), []
    for start, stop in events:
        hit = next((a for a in left if start <= a <= stop), None)
        if hit is not None:
            left.remove(hit)
            delays.append(hit - start)
    return {
        "matched": len(delays),
        "missed": len(events) - len(delays),
        "false_alarms": len(left),
        "delay": sum(delays) / len(delays) if delays else None,
        "false_per_10k": len(left) / n * 1e4,
        "false_per_year": len(left) / n * 17_520,
    }
