"""Order-dependent operators as folds: a state for each key, fed with the key's rows in order.

Rows are dealt by key and sorted; a task goes through them batch by batch, so that its memory holds one state and one
batch, however long a series is. A single series is one task's work: its steps depend on each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.sources.shipping import ship_package

#: Takes a row's values and gives the values of the row to put out behind the key, or None.
Step = Callable[..., tuple | None]


def folded(rows: DataFrame, order: list[str], start: Callable[[], Step], schema: str) -> DataFrame:
    """schema's rows: for each k a step from start(), called with the other columns of rows in their order. rows has k."""
    ship_package(rows.sparkSession)
    chosen = [c for c in rows.columns if c != "k"]
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = object()
        step: Step | None = None
        for batch in batches:
            out = []
            for k, *values in zip(batch.column("k").to_pylist(), *(batch.column(c).to_pylist() for c in chosen), strict=True):
                if k != key:
                    key, step = k, start()
                found = step(*values)
                if found is not None:
                    out.append((k, *found))
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)

    return rows.repartition("k").sortWithinPartitions("k", *order).mapInArrow(run, schema)


def folded_blocks(rows: DataFrame, start: Callable[[str], Callable[..., list[tuple]]], schema: str) -> DataFrame:
    """schema's rows: for each k a step from start(k), called with arrays of pos and y, block by block in the order of pos, which
    gives the values of rows to put out behind the key. rows has k, pos, y without nulls."""
    ship_package(rows.sparkSession)
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            ks, pos, y = batch.column("k").to_pylist(), batch.column("pos").to_numpy(), batch.column("y").to_numpy()
            edges = [0, *(i for i in range(1, len(ks)) if ks[i] != ks[i - 1]), len(ks)]
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    if ks[a] != key or step is None:
                        key, step = ks[a], start(ks[a])
                    out += [(key, *found) for found in step(pos[a:b], y[a:b])]
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)

    return rows.select("k", "pos", "y").repartition("k").sortWithinPartitions("k", "pos").mapInArrow(run, schema)
