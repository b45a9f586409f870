"""Rows of Arrow batches inside of tasks: plain Python values both ways, so that whole numbers and nulls stay what they are."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def schema_of(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def rows_of(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a task's batches, one after another."""
    for part in parts:
        yield from zip(*(c.to_pylist() for c in part.columns))


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4_096) -> Iterator[pa.RecordBatch]:
    """Rows as batches of ``size`` at most; never more than one is held."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts go to Python in batches of few rows, so that very long ones do not fill its memory; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
