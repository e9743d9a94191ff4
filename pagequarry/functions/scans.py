"""Passes over sorted rows with a small state, for folds that no window function expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ARROW = {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def scan_sorted(df: DataFrame, keys: list[str], order: list[str], args: list[str], begin: Callable[[], Callable[[tuple], object]], name: str, kind: str) -> DataFrame:
    """df with a column name (of type kind): of each row, in the order of its key, what step gives for its args.

    begin() gives a new step for each key. One shuffle on the keys and Spark's external sort; a task holds a batch of rows and
    the state of one key, however many rows that key has. Rows that agree in order come in any order.
    """
    names = df.columns
    at = [names.index(c) for c in args]
    tagged = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.struct(*[F.col(f"`{k}`") for k in keys]).alias("k"))
    parts = tagged.repartition("k").sortWithinPartitions("k", *[F.col("r").getField(c) for c in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, begin()
        for b in batches:
            rows = b.column(0)
            values = []
            for key, row in zip(b.column(1).to_pylist(), zip(*[rows.field(i).to_pylist() for i in at])):
                if key != last:
                    last, step = key, begin()
                values.append(step(row))
            yield pa.RecordBatch.from_arrays([rows, pa.array(values, _ARROW[kind])], names=["r", "x"])

    schema = f"r {parts.schema['r'].dataType.simpleString()}, x {kind}"
    return parts.select("r", "k").mapInArrow(run, schema).select("r.*", F.col("x").alias(name))
