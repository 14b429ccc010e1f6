"""Rows with texts dealt out by ranges of their keys, and cut into frames that a task turns into blocks of an index by arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that rows without a key are dealt into.
KEYLESS = 64


def dealt(rows: DataFrame, key: str, text: Column, span: int, piece: int) -> DataFrame:
    """(key, range, text) of rows with a text, ``range`` being one of ``span`` keys; neighbours within ``piece`` keys meet in a task, in order."""
    rows = rows.select(F.col(key).cast("long").alias("key"), F.floor(F.col(key) / span).alias("range"), text.alias("text")).where("text <> ''")
    deal = F.coalesce(F.floor(F.col("key") / min(span, piece)), F.pmod(F.xxhash64("text"), F.lit(KEYLESS)))
    return rows.withColumn("deal", deal).repartition("deal").drop("deal").sortWithinPartitions("range", "key")


def changes(column: pa.Array) -> np.ndarray:
    """Whether a row's value isn't that of the row before; nulls are equal."""
    null, value = column.is_null().to_numpy(zero_copy_only=False), pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])])[: len(column)]


def frames(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, cut between ranges, and within those alone that are longer. Rows without a range are apart."""
    for batch in batches:
        if not len(batch):
            continue
        size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(size) - size
        start = before[np.maximum.accumulate(np.where(changes(batch.column("range")), np.arange(len(batch)), 0))]
        null = batch.column("range").is_null().to_numpy(zero_copy_only=False)
        outer, inner = start // most, (before - start) // most
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(outer) != 0) | (np.diff(inner) != 0) | np.diff(null)]))
        for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
            yield batch.slice(a, b - a)


def blocks(rows: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int) -> DataFrame:
    """What ``make`` gives for each frame of dealt rows, of ``most`` bytes; a longer text is a frame of its own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames(batches, most):
            yield make(frame)

    return rows.mapInArrow(each, schema)


def packed(values: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """The bytes of each run of numbers; ``ends`` begins with 0. Lists of numbers cost Parquet a step for every number and list."""
    at = (ends * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many each row has) of a packed column."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]].tobytes() if data else b""
    return np.frombuffer(values, kind), np.diff(at) // np.dtype(kind).itemsize
