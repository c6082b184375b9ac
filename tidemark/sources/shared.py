"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder under spark.checkpoint.dir; a temporary one only if that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = by_hand.get() if by_hand.isDefined() else tempfile.mkdtemp(prefix="checkpoints-")
        if not by_hand.isDefined():
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, which cuts its lineage, and the table's path."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _file(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _file(spark, path)
    return system.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """When a file, or the newest file of a folder, was written, in milliseconds since 1970."""
    system, p = _file(spark, path)
    status = system.getFileStatus(p)
    inside = system.listStatus(p) if status.isDirectory() else []
    return max([status.getModificationTime(), *(x.getModificationTime() for x in inside)])


def _created(system, p) -> bool:
    """Create an empty file if there is none, in one step."""
    if system.getScheme() == "file":
        # Hadoop's local file system looks first and creates then.
        try:
            os.close(os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        system.create(p, False).close()
    except Exception:  # py4j wraps what the file system raises
        if not system.exists(p):
            raise
        return False
    return True


@contextmanager
def locked(spark: SparkSession, path: str, patience: float = 60.0) -> Iterator[None]:
    """Hold the lock file at path; others wait for it, for patience seconds at most. Only one of several drivers creates it."""
    system, p = _file(spark, path)
    if p.getParent() is not None:
        system.mkdirs(p.getParent())
    until = time.monotonic() + patience
    while not _created(system, p):
        if time.monotonic() > until:
            raise TimeoutError(f"{path} is held by another writer")
        time.sleep(0.05)
    try:
        yield
    finally:
        system.delete(p, False)
