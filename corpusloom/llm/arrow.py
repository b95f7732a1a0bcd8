"""Small helpers for Arrow batches in tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string or binary column as bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary()).to_pylist()


def pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes each, so that a task's memory doesn't follow the batch size."""
    rows = max(1, int(batch.num_rows * min(1.0, limit / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; ids of remainder 2 are held out of all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def keyed(docs: DataFrame, ddl: str, key: str = "doc_id") -> T.StructType:
    """The schema of ``key`` as in ``docs``, then ``ddl``."""
    return T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL(ddl).fields])
