"""How filters interact: what each removes, under every order in which they can be applied, by part of the corpus.

A row's failures are a bit mask, so that which filter removes it under an order is a lookup in a small table made
beforehand (masks x orders). Tasks index the table with their rows and count removals by part, order, step and label in
one bincount; Spark adds their partial arrays up. Everything else follows from the removals: a filter's failures are
what it removes as the first one, its unique failures what it removes as the last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import frugal, written

#: The filters by letter; E needs the whole table and is worked out apart.
LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a task looks up at a time, and parts whose counts it holds before it hands them on; memory depends on these.
LOOKUP_ROWS = 2_000
HELD_PARTS = 2_000


def orders(letters: str = LETTERS) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def first_failures(letters: str = LETTERS) -> np.ndarray:
    """step[mask, order]: the step, from 0, at which a row with these failures (bit i: letter i) goes; as many as there are
    letters for a row that stays."""
    n = len(letters)
    table = np.full((1 << n, len(orders(letters))), n, np.int64)
    for j, order in enumerate(orders(letters)):
        bits = np.array([1 << letters.index(c) for c in order])
        fails = np.arange(1 << n)[:, None] & bits != 0
        table[:, j] = np.where(fails.any(axis=1), fails.argmax(axis=1), n)
    return table


def text_failures(text: Column) -> Column:
    """The bits of A (under 200 words), B (under half of the words distinct), C (over one letter in fifty upper case) and
    D (a sign of markup or code) for whole texts."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def label_bits(labels: DataFrame) -> DataFrame:
    """doc_id, label (1: quality, 2: toxic, 3: both); an id that is labelled repeatedly has what any of its rows says."""
    found = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("label")
    )
    return found.filter("label > 0")


def failing_rows(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, label, n: how many rows of a part have these failures and labels; some groups stand on several rows.

    A null text is an empty one, a null part an empty string. E fails where a smaller id has the same text: rows that
    repeat the smallest id pass, and so do rows without an id, which are never the smaller one either. Texts are compared
    by SHA-256 and never shuffled; equal rows collapse before every exchange.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_failures(text).cast("int").alias("mask"),
    )
    alike = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    labelled = alike.join(label_bits(labels), "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    has_id = F.col("doc_id").isNotNull()
    groups = labelled.groupBy("digest", "part", "mask", "label").agg(
        F.sum("n").alias("n"), F.sum(F.when(has_id, 0).otherwise(F.col("n"))).alias("no_id"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first")
    )
    groups, _ = written(groups, "texts")
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    found = groups.join(least, "digest").withColumn("passes", F.col("no_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0))
    both = F.array(F.struct("mask", F.col("passes").alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))
    return found.select("part", "label", F.inline(both)).filter("n > 0").select("part", "mask", "label", "n")


def removals(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, slot, removed, good_lost, toxic_lost of (part, mask, label, n) rows. slot numbers orders and steps, the order
    first, with one more step behind the last filter for rows that stay."""
    table = first_failures(letters)
    n_orders, steps = table.shape[1], len(letters) + 1
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def packed() -> pa.RecordBatch:
            # By label: none, good, toxic, both.
            sums = [np.stack([c.sum(axis=2), c[:, :, 1] + c[:, :, 3], c[:, :, 2] + c[:, :, 3]]).reshape(3, -1) for c in held.values()]
            columns = [pa.array([s[i].tolist() for s in sums], kind) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *columns], names=["part", "removed", "good_lost", "toxic_lost"])

        for batch in batches:
            for start in range(0, batch.num_rows, LOOKUP_ROWS):
                rows = batch.slice(start, LOOKUP_ROWS)
                parts = rows.column("part").dictionary_encode()
                code, mask, label, n = (np.asarray(x) for x in (parts.indices, rows.column("mask"), rows.column("label"), rows.column("n")))
                cell = (code[:, None].astype(np.int64) * n_orders + np.arange(n_orders)) * steps + table[mask]
                names = parts.dictionary.to_pylist()
                counts = np.bincount((cell * 4 + label[:, None]).ravel(), np.repeat(n, n_orders), len(names) * n_orders * steps * 4)
                for name, found in zip(names, counts.astype(np.int64).reshape(len(names), n_orders, steps, 4), strict=True):
                    held[name] = held[name] + found if name in held else found
                if len(held) > HELD_PARTS:
                    yield packed()
                    held.clear()
        if held:
            yield packed()

    partial = rows.mapInArrow(frugal(run), "part string, removed array<long>, good_lost array<long>, toxic_lost array<long>")
    cells = partial.select("part", F.posexplode(F.arrays_zip("removed", "good_lost", "toxic_lost")).alias("slot", "c"))
    return cells.groupBy("part", "slot").agg(*(F.sum(f"c.{c}").alias(c) for c in ("removed", "good_lost", "toxic_lost")))


def interactions(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of
    (part, mask, label, n) rows: a row for every part, order and step. No rows give no parts."""
    steps = len(letters) + 1
    names = F.array(*map(F.lit, orders(letters)))
    cells = removals(rows, letters).select(
        "part", names[F.floor(F.col("slot") / steps).cast("int")].alias("filter_order"), (F.col("slot") % steps + 1).cast("int").alias("step"), "removed", "good_lost", "toxic_lost"
    )
    cells = cells.withColumn("filter", F.expr("substr(filter_order, step, 1)"))
    order, of_filter = Window.partitionBy("part", "filter_order"), Window.partitionBy("part", "filter")
    later = F.coalesce(F.sum("removed").over(order.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("removed"))).over(of_filter)
    out = cells.withColumn("kept", later).filter(F.col("step") < steps)
    return out.select(
        "part", "filter_order", "step", "filter", "kept", "removed", (at(1) - F.col("removed")).alias("redundant"), at(len(letters)).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(of_filter).alias("shapley"),
    )


def audit_filters(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The interactions of the five filters over whole texts, a row for each part, order of filters and step.

    See failing_rows for nulls, repeated rows and ids without labels. Other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    return interactions(failing_rows(df, labels, id_col, text_col, part_col))
