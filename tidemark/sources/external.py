"""Small files from outside: frozen configurations, other teams' values, tables that a page shows again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import exists, modified

_READ: dict[tuple[str, str, int, str], DataFrame] = {}


def frozen_config(spark: SparkSession, path: str, detector: str, schema: str) -> DataFrame:
    """One row: the detector's configuration, from a CSV file with detector, status and kwargs (JSON). An error if the file or
    the row is missing, or if the row was not selected."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = spark.read.schema("detector string, status string, kwargs string").option("header", True).option("escape", '"').csv(path)
    found = rows.filter(F.col("detector") == detector).limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{len(found)} rows for {detector} in {path}")
    if found[0]["status"] != "selected":
        raise ValueError(f"{detector} is {found[0]['status']}, not selected")
    return spark.createDataFrame(found, rows.schema).withColumn("config", F.from_json("kwargs", schema)).select("detector", "config.*")


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file's rows; none if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def cached_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file's rows; the same DataFrame until the file is written again."""
    key = (spark.sparkContext.applicationId, path, modified(spark, path), schema)
    if key not in _READ:
        for old in [k for k in _READ if k[:2] == key[:2]]:
            del _READ[old]
        _READ[key] = spark.read.schema(schema).option("header", True).csv(path)
    return _READ[key]
