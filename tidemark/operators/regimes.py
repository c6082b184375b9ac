"""Documented events: windows, regimes and match windows.

Regimes are looked up, not searched: a catalogue becomes disjoint spans of time, each with the regime and the event that
hold there, which a series finds by its day. A catalogue of more than MAX_EVENTS events is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.series import DAY, micros

BUFFER_DAYS = 7
MATCH_DAYS = 7
REFRACTORY = 14 * DAY
MAX_EVENTS = 10_000


def event_windows(events: DataFrame, regions: list[str] | None = None, buffer_days: int = BUFFER_DAYS) -> DataFrame:
    """event_id, tier, region, drift_start, drift_end (one day behind the last), pre_start, post_end, match_end; in microseconds."""
    rows = events if regions is None else events.filter(F.col("region").isin(regions))
    start = micros(F.col("start_date").cast("timestamp"))
    end = micros(F.col("end_date").cast("timestamp")) + DAY
    single = F.when(F.col("date_precision") == "day", start + DAY).otherwise(end)
    return rows.select(
        "event_id", "tier", "region", "date_precision", start.alias("drift_start"), end.alias("drift_end"),
        (start - buffer_days * DAY).alias("pre_start"), (end + buffer_days * DAY).alias("post_end"), (single + MATCH_DAYS * DAY).alias("match_end"),
    )


def overlapping(windows: DataFrame, series: DataFrame, slot: str = "slot") -> DataFrame:
    """Events whose drift window overlaps the series' time span, which is one row."""
    span = series.agg(F.min(slot).alias("_a"), F.max(slot).alias("_b"))
    return windows.join(F.broadcast(span), (F.col("drift_start") <= F.col("_b")) & (F.col("drift_end") > F.col("_a"))).drop("_a", "_b")


Event = tuple[str, int, int, int, int]  # event_id, drift_start, drift_end, pre_start, post_end


def _events(windows: DataFrame) -> list[Event]:
    rows = windows.select("event_id", "drift_start", "drift_end", "pre_start", "post_end").limit(MAX_EVENTS + 1).collect()
    if len(rows) > MAX_EVENTS:
        raise ValueError(f"more than {MAX_EVENTS} events")
    return [tuple(r) for r in rows]


def _spans(events: list[Event], bounds: list[int], at: Callable[[int], tuple[str, str] | None]) -> list[tuple[int, int, int, str, str]]:
    """(day, start, stop, regime, event_id) of the spans between bounds, one row for each day that a span touches."""
    out = []
    for start, stop in zip(bounds, bounds[1:], strict=False):
        found = at(start)
        if found is not None:
            out += [(day, start, stop, *found) for day in range(start // DAY, (stop - 1) // DAY + 1)]
    return out


def _looked_up(series: DataFrame, spans: list[tuple[int, int, int, str, str]], slot: str, how: str) -> DataFrame:
    table = series.sparkSession.createDataFrame(spans, "_day long, _start long, _stop long, regime string, event_id string")
    t = F.col(slot)
    rows = series.withColumn("_at", F.floor(t / DAY).cast("long"))
    return rows.join(table, (F.col("_at") == F.col("_day")) & (t >= F.col("_start")) & (t < F.col("_stop")), how)


def global_regimes(series: DataFrame, windows: DataFrame, slot: str = "slot") -> DataFrame:
    """series with regime and event_id: drift inside an event (the earliest), else post_drift after one (the latest
    started), else pre_drift (the first event). Without events no row has a regime, and none is left."""
    events = _events(windows)
    if not events:
        return series.withColumns({"regime": F.lit(""), "event_id": F.lit("")}).limit(0)

    def at(t: int) -> tuple[str, str]:
        inside = [(start, i) for i, start, end, *_ in events if start <= t < end]
        past = [(-start, i) for i, start, end, *_ in events if end <= t]
        if inside:
            return "drift", min(inside)[1]
        return ("post_drift", min(past)[1]) if past else ("pre_drift", min((start, i) for i, start, *_ in events)[1])

    bounds = sorted({x for e in events for x in e[1:3]})
    rows = _looked_up(series, _spans(events, bounds, at), slot, "left")
    before, after = at(bounds[0] - 1), at(bounds[-1])
    outside = F.col(slot) < bounds[0]
    edge = [F.when(outside, before[n]).otherwise(after[n]) for n in (0, 1)]
    return rows.select(*series.columns, F.coalesce("regime", edge[0]).alias("regime"), F.coalesce("event_id", edge[1]).alias("event_id"))


def local_regimes(series: DataFrame, windows: DataFrame, slot: str = "slot") -> DataFrame:
    """As global_regimes, but only rows inside an event's windows: drift, then pre_drift, then post_drift; others go."""
    events = _events(windows)

    def at(t: int) -> tuple[str, str] | None:
        near = [(1 if start <= t < end else 2 if t < start else 3, start, i) for i, start, end, first, last in events if first <= t < last]
        if not near:
            return None
        kind, _, i = min(near)
        return ("drift", "pre_drift", "post_drift")[kind - 1], i

    bounds = sorted({x for e in events for x in e[1:]})
    return _looked_up(series, _spans(events, bounds, at), slot, "inner").select(*series.columns, "regime", "event_id")


def position_regimes(series: DataFrame, points: list[int], margin: int = 336) -> DataFrame:
    """regime by position: pre_drift before the first change point, drift for margin rows from each, else post_drift."""
    if not points:
        return series.withColumn("regime", F.lit("pre_drift"))
    pos = F.col("pos")
    drift = F.lit(False)
    for p in points:
        drift |= (pos >= p) & (pos < p + margin)
    return series.withColumn("regime", F.when(pos < min(points), "pre_drift").when(drift, "drift").otherwise("post_drift"))
