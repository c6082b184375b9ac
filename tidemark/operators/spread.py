"""One series as the work of many tasks: a key's order is cut into pieces, and what a piece needs of those before it is
either a small summary that is handed on, or a copy of the rows next to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written

#: Places of a piece, where rows are dealt by their places.
PIECE = 1024


def ranged(rows: DataFrame, order: str, key: str = "k", pieces: int | None = None) -> DataFrame:
    """rows in a written table, with _piece: ranges of (key, order), rising with it, of about as many rows each. Rows that
    are equal in both share a piece. pieces is the session's number of shuffle partitions unless it is given."""
    number = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written at once: a partition's number holds for the one job that makes the ranges.
    return written(rows.repartitionByRange(number, key, order).withColumn("_piece", F.spark_partition_id()), "pieces")[0]


def _joined(rows: DataFrame, handed: DataFrame, key: str) -> DataFrame:
    """rows with handed's columns of their key and piece; null keys are one key."""
    other = handed.withColumnsRenamed({key: "_key", "_piece": "_at"})
    return rows.join(other, rows[key].eqNullSafe(other["_key"]) & (rows["_piece"] == other["_at"])).drop("_key", "_at")


def running(rows: DataFrame, sums: dict[str, Column], order: str, key: str = "k", pieces: int | None = None) -> DataFrame:
    """rows with the running sum of each of sums, a row itself included, in a key's order, which should have no ties (where
    it has, tied rows come in any order). Nulls count as nothing, and order's nulls come first.

    Sums of a piece are handed on: one row for each key and piece, so no task holds a key's rows.
    """
    cut = ranged(rows.withColumns({f"_{n}": c for n, c in sums.items()}), order, key, pieces)
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(key, "_piece").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    handed = totals.select(key, "_piece", *(F.sum(f"_{n}").over(before).alias(f"_b_{n}") for n in sums))
    inside = Window.partitionBy("_piece", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    added = {n: F.coalesce(F.sum(f"_{n}").over(inside), zero) + F.coalesce(f"_b_{n}", zero) for n in sums}
    return _joined(cut, handed, key).select(*rows.columns, *(c.alias(n) for n, c in added.items()))


def numbered(rows: DataFrame, order: str = "slot", key: str = "k", pieces: int | None = None) -> DataFrame:
    """rows with pos, a row's place in its key's order, from 0."""
    return running(rows, {"pos": F.lit(1).cast("long")}, order, key, pieces).withColumn("pos", F.col("pos") - 1)


def lagged(rows: DataFrame, values: dict[str, str], order: str, key: str = "k", pieces: int | None = None) -> DataFrame:
    """rows with the value that a column had one row earlier in the key's order, for each new name and column of values;
    null for a key's first row. order should have no ties; its nulls come first. A piece hands its last row on."""
    cut = ranged(rows, order, key, pieces)
    taken = F.struct(*(F.col(c).alias(n) for n, c in values.items()))
    last = cut.groupBy(key, "_piece").agg(F.max(F.struct(F.col(order).alias("_o"), taken.alias("_v"))).alias("_last"))
    handed = last.select(key, "_piece", F.lag("_last._v").over(Window.partitionBy(key).orderBy("_piece")).alias("_handed"))
    inside = Window.partitionBy("_piece", key).orderBy(order)
    before = F.when(F.row_number().over(inside) == 1, F.col("_handed")).otherwise(F.lag(taken).over(inside))
    found = _joined(cut, handed, key).withColumn("_before", before)
    return found.select(*rows.columns, *(F.col(f"_before.{n}").alias(n) for n in values))


def haloed(rows: DataFrame, reach: int, size: int = PIECE, place: Column | str = "pos") -> DataFrame:
    """rows with _piece (size places each) and _own; a piece also has copies, not its own, of the reach places before it.
    Windows over (key, _piece) that look back reach rows at most are right for a piece's own rows, if places have no holes.
    Rows without a place have no piece and are left out."""
    at = F.col(place) if isinstance(place, str) else place
    home, last = F.floor(at / size), F.floor((at + reach) / size)
    dealt = rows.withColumn("_home", home.cast("long")).withColumn("_piece", F.explode(F.sequence("_home", last.cast("long"))))
    return dealt.withColumn("_own", F.col("_piece") == F.col("_home")).drop("_home")


def own(rows: DataFrame) -> DataFrame:
    """The rows of haloed without the copies."""
    return rows.filter("_own").drop("_piece", "_own")


#: What windows over pieces are partitioned by.
def by_piece(key: str = "k") -> Sequence[str]:
    return [key, "_piece"]
