"""Queries by name and the SQL that each should equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def steady(sql: str) -> str:
    """round(x, n) as round(x + 1e-(n + 3), n), as the queries round: sums differ in their last bits between engines, and
    without the shift a value midway between two roundings could go either way."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, comma, i = 1, -1, start + 6
        while depth:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = i
            i += 1
        places = int(sql[comma + 1 : i - 1])
        out.append(f"{sql[at:start]}round({steady(sql[start + 6 : comma])} + 1e-{places + 3}, {places})")
        at = i
    return "".join(out) + sql[at:]


def query(name: str, sql: str | None = None):
    """Register a query; sql is a SELECT over the canonical streams of plans.streams (None: SQL does not express it)."""

    def put(f):
        from tidemark.plans.streams import PRELUDE

        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = steady(f"{PRELUDE}\n{sql}")
        return f

    return put


def load_all() -> None:
    from tidemark.plans import arms, evaluation, reports, scans, sequential, surface, tables  # noqa: F401
