"""Substring search by trigrams: a table of trigrams to rows, intersected by the rarest first, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import frames
from tessera.operators.postings_index import _bucket

#: Bytes of text of a frame, and the columns of a block: the keys of a range's rows as packed numbers. Without a range, they are null.
FRAME_BYTES = 2 << 20
#: Neighbouring keys whose texts meet in a task.
PIECE = 256
_BLOCKS = "gram string, range long, keys binary, n int"


def trigrams(text: str) -> set[str]:
    """The runs of three code points of a text in lower case."""
    return {text[i : i + 3] for i in range(len(text) - 2)}


def _gram_blocks(frame: pa.RecordBatch) -> pa.RecordBatch:
    """The blocks of a frame of texts: the distinct (trigram, row) pairs by sorting numbers that hold three symbols and the row."""
    text = frame.column("text")
    points = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(frame)), pc.utf8_length(text).to_numpy(zero_copy_only=False))
    used = np.zeros(0x110000, bool)
    used[points] = True
    symbols, bits = np.flatnonzero(used), int(used.sum()).bit_length()
    rank = (np.cumsum(used) - 1)[points]
    inside = row[2:] == row[:-2]
    grams = ((rank[:-2] << 2 * bits) | (rank[1:-1] << bits) | rank[2:])[inside]
    room = 63 - 3 * bits  # bits that are left for rows: a part of them at once, if their symbols are many
    row, step = row[:-2][inside], 1 << room
    parts = []
    for low in range(0, len(frame), step):
        at = slice(*np.searchsorted(row, [low, low + step]))
        pairs = np.unique((grams[at] << room) | (row[at] - low))
        parts.append((pairs >> room, (pairs & (step - 1)) + low))
    gram, row = (np.concatenate(p) for p in zip(*parts, strict=True))
    ranges = np.cumsum(frames.changes(frame.column("range")))[row]
    start = np.flatnonzero(np.concatenate([[True], (np.diff(gram) != 0) | (np.diff(ranges) != 0)])[: len(gram)])
    ends, first = np.append(start, len(gram)), gram[start]
    mask = (1 << bits) - 1
    names = symbols[np.stack([first >> 2 * bits, (first >> bits) & mask, first & mask], 1)].astype("<u4")
    size = (1 + (names > 0x7F) + (names > 0x7FF) + (names > 0xFFFF)).sum(1)  # in UTF-8
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = names.tobytes().decode("utf-32-le").encode()
    keys = pc.fill_null(frame.column("key"), 0).to_numpy()
    columns = {
        "gram": pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(data)),
        "range": frame.column("range").take(pa.array(row[start])),
        "keys": frames.packed(keys[row], ends),
        "n": pa.array(np.diff(ends), pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _keys(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, key) of blocks."""
    for rows in blocks:
        key, n = frames.unpacked(rows.column("keys"), np.int64)
        row = np.repeat(np.arange(len(rows)), n)
        keyless = rows.column("range").is_null().to_numpy(zero_copy_only=False)[row]
        yield pa.RecordBatch.from_arrays([rows.column("gram").take(pa.array(row)), pa.array(key, mask=keyless)], ["gram", "key"])


@dataclass
class Found:
    """Rows of the table whose text holds the needle, and how many were read to verify it."""

    rows: DataFrame
    verified: int


class SubstringIndex:
    """Rows of each trigram of a text column under ``path``: blocks of neighbouring keys, of a range of ``span`` at most, in folders by the trigram's hash.

    ``most``: trigrams of a needle that are intersected; further ones would cost more than they spare."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, span: int = 4096, most: int = 4) -> None:
        self.spark, self.path, self.key, self.buckets, self.span, self.most = spark, path.rstrip("/"), key, buckets, span, most

    def build(self, rows: DataFrame, text: str) -> SubstringIndex:
        """Index every row, by one shuffle of the texts: a task makes the blocks of its rows by arrays."""
        dealt = frames.dealt(rows, self.key, F.lower(F.col(text)), self.span, PIECE)
        blocks = frames.blocks(dealt, _gram_blocks, _BLOCKS, FRAME_BYTES).withColumn("bucket", _bucket(F.col("gram"), self.buckets))
        blocks = blocks.sortWithinPartitions("bucket", "gram", "range")
        blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/trigrams")
        return self

    def candidates(self, needle: str) -> DataFrame | None:
        """(key) of rows with the needle's rarest trigrams; null if it has fewer than three characters, when any row may hold it."""
        grams = trigrams(self.spark.range(1).select(F.lower(F.lit(needle))).first()[0])
        if not grams:
            return None
        asked = self.spark.createDataFrame([(g,) for g in sorted(grams)], "gram string").withColumn("bucket", _bucket(F.col("gram"), self.buckets)).collect()
        rows = self.spark.read.schema(f"{_BLOCKS}, bucket int").parquet(f"{self.path}/trigrams")
        blocks = rows.where(F.col("bucket").isin(*{r["bucket"] for r in asked}) & F.col("gram").isin(*[r["gram"] for r in asked]))
        counts = {r["gram"]: r["n"] for r in blocks.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(counts) < len(asked):  # a trigram that no row has
            return self.spark.createDataFrame([], f"{self.key} long")
        rarest = sorted(counts, key=lambda g: (counts[g], g))[: self.most]
        each = blocks.where(F.col("gram").isin(*rarest)).select("gram", "range", "keys").mapInArrow(_keys, "gram string, key long")
        each = each.select("gram", F.col("key").alias(self.key)).distinct()
        return each.groupBy(self.key).agg(F.count("*").alias("have")).where(F.col("have") == len(rarest)).select(self.key)

    def search(self, rows: DataFrame, text: str, needle: str) -> Found:
        """The rows whose text holds the needle, blind to case, taken literally. A needle of fewer than three characters is looked for in all."""
        near = self.candidates(needle)
        if near is not None:
            asked = near.select(F.col(self.key).alias("asked"))
            rows = rows.join(asked, F.col(self.key).eqNullSafe(F.col("asked")), "left_semi")
        holds = F.contains(F.lower(F.col(text)), F.lower(F.lit(needle)))
        return Found(rows.where(holds), rows.count())
