"""Helpers shared by the training-data operators: reading, slicing Arrow batches, shared storage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.shared import drop_folder, shared_folder, written
from tidemark.sources.shipping import ship_package

__all__ = ["drop_folder", "frugal", "kept", "partitions", "prepare", "shared_folder", "slices", "table", "written"]

#: Bytes of text that one slice of an Arrow batch holds at most (a single longer row is a slice of its own).
SLICE_BYTES = 500_000
#: Bytes of an Arrow batch between the JVM and a Python worker, unless the session sets them itself.
BATCH_BYTES = "8m"


def frugal(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: Hashable = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker gives its memory back to the system: idle workers stay beside those of
    later stages, and what an operator has used there would count against all that follow. keeps names what kept() holds
    for run; what it holds for others goes."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return bounded


_KEPT: dict[Hashable, object] = {}
T = TypeVar("T")


def forget_others(keeps: Hashable) -> None:
    if any(key != keeps for key in _KEPT):
        _KEPT.clear()
        give_back()


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """make(), held by the worker from one task to the next until another operator's task comes."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library; memory then goes back when the worker ends.
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ship the package, and keep Arrow batches small where the session leaves them at Spark's default: long texts make the
    default of ten thousand rows a batch of many megabytes in both the JVM and the worker."""
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64m", "67108864"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of each slice stays under max_bytes; empty batches are skipped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
