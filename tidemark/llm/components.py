"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import drop_folder, written

#: Steps after which the algorithm gives up; a path of n nodes needs about log2(n) of them.
MAX_STEPS = 60


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node either has one edge (to its component's smallest node) or is itself such a smallest node."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return not ends.groupBy("id").agg(F.sum("out").alias("o"), F.max("into").alias("i")).filter("o > 1 OR (o > 0 AND i > 0)").take(1)


def components(links: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, list[str]]:
    """(id, component) for every id in links, the component being its smallest id; and the folders that hold the rows.

    Links may repeat, point either way or at themselves; rows with a null end are ignored; no links, no rows.
    Each step is written to the shared folder; the minimum per node is pre-aggregated, and joins can be split by
    adaptive execution where one node has very many links.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, path = written(edges, "links")
    for _ in range(MAX_STEPS):
        if _stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large, large_path = written(large, "links")
        small = large.join(_least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small, small_path = written(small, "links")
        drop_folder(spark, path)
        drop_folder(spark, large_path)
        edges, path = small, small_path
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct()), [path]
