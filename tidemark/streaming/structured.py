"""The operators on live data: windowed means with a watermark, and detectors as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.detectors import Detector
from tidemark.sources.shared import shared_folder


def events(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """The files of a table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir)


def windowed_mean(stream: DataFrame, key: str, ts: str, value: str, width: str = "30 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """key, start, stop, y, n per event-time window (closed on the left; sliding if slide is given); rows later than the watermark are dropped."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    window = F.window("_t", width, slide) if slide else F.window("_t", width)
    return timed.groupBy(F.col(key).alias("k"), window.alias("w")).agg(F.avg(value).alias("y"), F.count(value).alias("n")).select("k", "w.start", "w.end", "y", "n")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, stop, n per session: events with less than gap between two."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.col(key).alias("k"), F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n")).select("k", "w.start", "w.end", "n")


def detect(stream: DataFrame, make: Callable[[], Detector], key: str, order: str, value: str) -> DataFrame:
    """k, us of the alarms; a key's detector is its state and survives restarts. Rows of one trigger are taken in order."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(keys: tuple, parts, state: GroupState):
        detector = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(parts)).sort_values("us", kind="stable")
        hits = [us for us, y in zip(rows["us"], rows["y"], strict=True) if detector.update(float(y))]
        state.update((pickle.dumps(detector),))
        yield pd.DataFrame({"k": pd.Series([keys[0]] * len(hits), dtype="object"), "us": pd.Series(hits, dtype="int64")})

    rows = stream.filter(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(order).cast("timestamp")).alias("us"), F.col(value).alias("y"))
    return rows.groupBy("k").applyInPandasWithState(run, "k string, us long", "detector binary", "append", GroupStateTimeout.NoTimeout)


def run_to_end(result: DataFrame, mode: str = "append") -> DataFrame:
    """All available input through the query once; what it wrote, read back."""
    spark = result.sparkSession
    folder = shared_folder(spark, "stream")
    if mode == "append":
        q = result.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        q = result.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")
