"""Small helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.session import cut_lineage, num_partitions

__all__ = ["cut_lineage", "num_partitions", "table", "lower_ascii", "python_rows", "batches"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def python_rows(part: pa.RecordBatch, size: int = 512) -> Iterator[tuple]:
    """The rows of a batch as tuples, turned into Python objects a few at a time."""
    for i in range(0, part.num_rows, size):
        yield from zip(*(c.to_pylist() for c in part.slice(i, size).columns))


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``size`` rows from an iterator of tuples."""
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= size:
            yield _batch(buffer, schema)
            buffer = []
    if buffer:
        yield _batch(buffer, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
