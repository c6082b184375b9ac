"""Interval data and the streams that the operators run on.

A raw table has one row per reading: key, ts, value. A gridded series has a row per (key, slot), slot being the end of
a half-open interval (slot - width, slot] in microseconds since 1970; positions count a series' rows from 0.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.shared import written

HALF_HOUR = 1_800_000_000
DAY = 86_400_000_000

#: Columns of a raw interval file.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("REGION", T.StringType()),
        T.StructField("SETTLEMENTDATE", T.TimestampNTZType()),
        T.StructField("TOTALDEMAND", T.DoubleType()),
        T.StructField("RRP", T.DoubleType()),
        T.StructField("PERIODTYPE", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def at(us: Column | str) -> Column:
    """The timestamp without zone of microseconds since 1970."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def rounded(column: Column | str, places: int = 6) -> Column:
    """column to so many places; a shift far below them keeps values midway from depending on a sum's last bit."""
    return F.round((F.col(column) if isinstance(column, str) else column) + F.lit(10.0 ** -(places + 3)), places)


def stamp(text: str) -> int:
    """Microseconds since 1970 of an ISO date or timestamp."""
    return int((dt.datetime.fromisoformat(text) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def read_csv_folder(spark: SparkSession, folder: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """All CSV files of a folder, header checked against the schema; file and place tell a row's order: places are not
    numbered through, but rise within a file, also where it is read in several parts."""
    raw = spark.read.option("enforceSchema", "false").schema(schema).csv(folder, header=True, mode="FAILFAST")
    return raw.withColumn("file", F.col("_metadata.file_name")).withColumn("place", F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row")))


_LOADED: dict[tuple[str, str, str], DataFrame] = {}


def loaded(spark: SparkSession, sf_dir: str, region: str, known: Sequence[str], read: Callable[[SparkSession, str, str], DataFrame]) -> DataFrame:
    """read(spark, sf_dir, region), written once to the shared folder and the same DataFrame ever after; ValueError for a
    region that is not known."""
    if region not in known:
        raise ValueError(f"unknown region {region!r}, known are {list(known)}")
    key = (spark.sparkContext.applicationId, sf_dir, region)
    if key not in _LOADED:
        _LOADED[key] = written(read(spark, sf_dir, region), "loaded")[0]
    return _LOADED[key]


def regrid(raw: DataFrame, key: str, ts: str, value: str, width: int = HALF_HOUR) -> DataFrame:
    """k, slot, y: the mean of each key's readings in each interval that has any; rounded to six places."""
    us = micros(ts)
    end = ((us + F.lit(width - 1)) - F.pmod(us + F.lit(width - 1), F.lit(width))).alias("slot")
    return raw.filter(F.col(ts).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), end).agg(rounded(F.avg(value), 6).alias("y"))


def with_gaps(grid: DataFrame, width: int = HALF_HOUR) -> DataFrame:
    """A row for every slot between a key's first and last, y null in the gaps."""
    ends = grid.groupBy("k").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    spine = ends.select("k", F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("slot"))
    return spine.join(grid, ["k", "slot"], "left")


def numbered(series: DataFrame, key: str = "k", order: str = "slot") -> DataFrame:
    """pos: place of a row in its series, from 0."""
    return series.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long") - 1)


def split_column(us: Column, bounds: Sequence[tuple[str, str, str | None]]) -> Column:
    """Name of the split whose [start, end + 1 day) holds us; an open end has None; null outside all."""
    out = F.lit(None).cast("string")
    for name, start, end in reversed(bounds):
        inside = us >= F.lit(stamp(start))
        if end is not None:
            inside &= us < F.lit(stamp(end) + DAY)
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def catalogue(spark: SparkSession, rows: Sequence[tuple[str, str, str, str, str, int]]) -> DataFrame:
    """Event catalogue: event_id, start_date, end_date (inclusive), date_precision (day or date_range), region, tier."""
    parsed = [(i, dt.date.fromisoformat(a), dt.date.fromisoformat(b), p, r, t) for i, a, b, p, r, t in rows]
    return spark.createDataFrame(parsed, "event_id string, start_date date, end_date date, date_precision string, region string, tier int")


def synthetic(spark: SparkSession, kind: str, n: int, noise: float = 0.0, seed: int = 1) -> tuple[DataFrame, list[int]]:
    """t, y of a benchmark series, and its change points: 20 + 5 sin(2 pi t / 48), a rise by 8 at a quarter (sudden), along
    a ramp from there (gradual) or in the middle third (recurring); noise is normal, from NumPy's generator, on the driver's
    seed but drawn block by block on the executors, so that any block can be made again."""
    t = F.col("t")
    quarter, ramp = n // 4, min(1000, n // 4)
    lift, points = {
        "none": (F.lit(0.0), []),
        "sudden": (F.when(t >= quarter, 8.0).otherwise(0.0), [quarter]),
        "gradual": (8.0 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - quarter) / F.lit(float(max(1, ramp))))), [quarter, quarter + ramp]),
        "recurring": (F.when((t >= n // 3) & (t < 2 * n // 3), 8.0).otherwise(0.0), [n // 3, 2 * n // 3]),
    }[kind]
    clean = spark.range(n).select(F.col("id").alias("t")).select("t", (20 + 5 * F.sin(2 * F.pi() * t / 48) + lift).alias("y"))
    if not noise:
        return clean, points

    def noisy(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ts = batch.column("t").to_numpy()
            ys = batch.column("y").to_numpy().copy()
            for block in np.unique(ts // 4096):
                inside = ts // 4096 == block
                draws = np.random.default_rng([seed, int(block)]).normal(0.0, noise, 4096)
                ys[inside] += draws[ts[inside] % 4096]
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(ys)], names=["t", "y"])

    return clean.mapInArrow(noisy, "t long, y double"), points
