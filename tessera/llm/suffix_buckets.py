"""Repeated byte strings by bucket-pointer refinement of sampled candidate regions.

A suffix is told from others by its first 400 bytes here. Full bucket-pointer refinement keeps a pointer for each byte
of the corpus and shuffles all of them at each level, ten times the text and more. So it runs where it decides
something:

1. *Regions.* Any two equal 400-byte strings hold the same sampled gram at the same place (``anchors``). Ranges
   of suffixes around sampled grams are settled together where nothing else shares them, or where all of them repeat.
   What stays open are short regions at the edges of repeats.
2. *Initial buckets.* The suffixes of a region, and the later offsets that they will be compared by, are put in
   buckets by their first q = 100 bytes. A bucket's identifier is a pointer to its least member.
3. *Refinement.* From width w to 2w: suffix i goes to the bucket of the pair (bucket of i, bucket of i + w). The bytes
   are never looked at again; a bucket identifier of a later offset tells suffixes apart. A suffix alone in its bucket is
   settled, leaves, and takes those along that need it at a later offset. The new identifiers are what the next
   level pairs, up to 400 bytes. Suffixes that still share a bucket there are the repeats.

Buckets are grouped by partial aggregation and joined as tables, so a bucket of any size costs a row for each task and
can be split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tessera.llm.anchors import (
    Windows,
    by_document,
    narrower_ranges,
    sampled_ranges,
    spans_of,
    union,
    whole_spans,
    window_starts,
    with_spans,
)
from tessera.llm.common import discard, keyed, map_arrow, materialise

#: A place is a region's number and a byte in it. Regions are numbered by partition and row, of up to 2**27 rows.
PLACE_BITS, ROW_BITS = 17, 27


def _bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, np.diff(offsets)


def widths(size: int, q: int) -> list[int]:
    """The widths of the buckets, from q to size; each at most twice the one before."""
    out = [min(q, size)]
    while out[-1] < size:
        out.append(min(size, 2 * out[-1]))
    return out


def offsets_by_level(steps: list[int]) -> dict[int, int]:
    """The offsets from a suffix whose initial buckets it needs, each with the last level (0 for initial buckets) at
    which its own bucket is asked for."""
    top = len(steps) - 1
    need = {0: top}
    for level in range(top, 0, -1):
        for offset in list(need):
            need.setdefault(offset + steps[level] - steps[level - 1], level - 1)
    return need


def _initial(regions: DataFrame, win: Windows, steps: list[int]) -> DataFrame:
    """(place, level, h1, h2): the first q bytes, as 128 bits, of the suffixes of each region and of the later offsets they need."""
    q, need = steps[0], offsets_by_level(steps)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        places, levels, digests = [], [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("region", "own", "left", "context", "parts")), strict=True)
        for region, own, left, raw, parts in rows:
            level: dict[int, int] = {}
            for start, _ in window_starts(own, left, len(raw), parts, win):
                for offset, until in need.items():
                    level[start + offset] = max(level.get(start + offset, 0), until)
            for at, until in level.items():
                places.append(region << PLACE_BITS | at)
                levels.append(until)
                digests.append(xxh3_128_digest(raw[at : at + q]))
        if not places:
            return None
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        columns = [pa.array(places, pa.int64()), pa.array(levels, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])]
        return pa.RecordBatch.from_arrays(columns, names=["place", "level", "h1", "h2"])

    return map_arrow(regions, each, "place long, level int, h1 long, h2 long")


def _rebucket(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """(place, level, bucket), as a table: rows that agree in ``by`` with others; bucket: the least place of them."""
    buckets = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("place").alias("pointer")).where("n > 1").drop("n")
    out = materialise(rows.join(buckets, by).select("place", "level", F.col("pointer").alias("bucket")), name)
    discard(rows)
    return out


def refine(regions: DataFrame, win: Windows, steps: list[int], name: str) -> DataFrame:
    """(region, at), as a table: the open windows of the regions that equal another one."""
    ids = _rebucket(materialise(_initial(regions, win, steps), f"{name}-grams"), ["h1", "h2"], f"{name}-buckets0")
    for level in range(1, len(steps)):
        later = ids.select((F.col("place") - (steps[level] - steps[level - 1])).alias("place"), F.col("bucket").alias("next"))
        pairs = materialise(ids.where(F.col("level") >= level).join(later, "place"), f"{name}-pairs{level}")
        discard(ids)
        ids = _rebucket(pairs, ["bucket", "next"], f"{name}-buckets{level}")
    at = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    return ids.select(F.shiftright("place", PLACE_BITS).alias("region"), at.alias("at"))


def repeated_bytes(docs: DataFrame, size: int = 400, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, starts, ends, sources): every document with the spans of its UTF-8 bytes that
    are covered by a string of ``size`` bytes that starts anywhere else too.

    A null or short text has no spans. Rows that repeat a document repeat its strings, so all of a
    repeated row of ``size`` bytes or more is covered.
    """
    gram = gram or max(1, size * 2 // 5)
    rows = keyed(docs, id_col, text_col)
    win = Windows(size, gram, max(1, int((size - gram + 1) ** 0.5 + 0.999)), _bytes, earlier=False)
    first, contexts = sampled_ranges(rows, win, "suffix")
    second, open_ = narrower_ranges(contexts, win, 1, "suffix")
    number = F.monotonically_increasing_id()
    region = F.shiftleft(F.shiftright(number, 33), ROW_BITS).bitwiseOR(number.bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    regions = materialise(open_.select("kid", "kh", "pos", "own", "left", "context", "parts", region.alias("region")), "suffix-regions")
    discard(contexts)
    found = refine(regions, win, widths(size, max(1, size // 4)), "suffix")
    start = F.col("pos") - F.col("left") + F.col("at")
    single = regions.select("region", "kid", "kh", "pos", "left").join(found, "region")
    single = single.select("kid", "kh", start.alias("start"), (start + size).alias("end"), F.lit(None).cast("long").alias("source"))
    return with_spans(rows, by_document(whole_spans(first, win, False), whole_spans(second, win, True), single))


def remove_repeats(docs: DataFrame, size: int = 400, **columns: str) -> DataFrame:
    """(doc_id, kept, spans): each document's bytes without its repeated ones, and the removed runs."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, runs = [], []
        for text, (starts, ends, _) in zip(batch.column("text"), spans_of(batch), strict=True):
            data, spans = text.as_py().encode(), union(starts, ends)
            kept.append(without(data, spans))
            runs.append([{"start": a, "end": b} for a, b in spans])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "kept", "spans"])

    return map_arrow(repeated_bytes(docs, size, **columns), each, "doc_id long, kept binary, spans array<struct<start:long,end:long>>")


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def repeats_digest(docs: DataFrame, size: int = 400) -> DataFrame:
    """The digest columns of the query."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, (starts, ends, _) in zip(batch.column("text"), spans_of(batch), strict=True):
            data, spans = text.as_py().encode(), union(starts, ends)
            rows.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(data, spans)).hexdigest()))
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(repeated_bytes(docs, size), each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
