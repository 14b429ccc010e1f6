"""Repeated windows of W symbols over a whole corpus, found exactly, without any quadratic step.

Two equal windows select the same sample: the least hashed k-gram in a window, the leftmost of
equals, depends on the window alone. So it suffices to compare windows around sampled positions,
one in (W - k) / 2 or so. A sampled position m stands for the windows that hold the k-gram at m,
those that start at m - d for d in [0, W - k]. They are compared in ranges of d, coarse to fine:

* the *core* of a range is what all its windows share. Rows with equal cores form a bucket; where
  the bucket has one row (or none from an earlier document), no window of the range repeats.
* the *hull* of a range is what its windows cover together. Where another row of the bucket has the
  same hull, every window of the range repeats.
* otherwise the range is split and its parts form new buckets. What is then still open, single windows at the
  edges of repeats, is for the operator to decide: by refined buckets (``suffix_buckets``) or by matches with
  reference blocks (``rlz_spans``).

Buckets are compared by 64-bit fingerprints through partial aggregation and joins, so a bucket of any
size costs a row for each task, never a task. Hulls add 64 further bits, single windows too. Only ranges at
the edges of repeats are split, so rows are in proportion to the samples. Equal ranges are told
from others for all documents together, so nothing depends on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tessera.llm.common import discard, groups, map_arrow, materialise, utf8
from tessera.llm.lexer import mix, powers, prefix_sums

#: Symbols in one piece of work; a longer document is done in overlapping pieces.
PIECE = 1 << 18
_LOW = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Windows:
    """What repeats mean. ``symbols`` turns a column of UTF-8 texts into (array, counts by text)."""

    size: int
    gram: int
    step: int  # offsets in a range of the second level
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    earlier: bool  # a repeat counts only if it starts in a document with a smaller id

    def __post_init__(self) -> None:
        if not 0 <= self.reach < 1 << 15:
            raise ValueError("A window has its k-gram and fewer than 32768 further symbols")

    @property
    def reach(self) -> int:
        return self.size - self.gram


def sample(values: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, low, high) of the samples of every window of ``size`` inside one document: those that select
    the sample at m start at m - high to m - low, without a gap."""
    found = []
    for a, b in groups(offsets, PIECE):
        lo, hi = int(offsets[a]), int(offsets[b])
        x = lo
        while hi - x >= size:
            y = min(hi, x + 4 * PIECE)
            at, start = _sample_piece(values[x:y].astype(np.uint64), offsets[a : b + 1] - x, size, gram)
            found.append((at + x, start + x))
            x = y if y == hi else y - size + 1
    if not found:
        return (np.empty(0, np.int64),) * 3
    at, start = (np.concatenate(f) for f in zip(*found, strict=True))
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    last = np.append(new[1:], len(at)) - 1
    return at[new], at[new] - start[last], at[new] - start[new]


def _sample_piece(v: np.ndarray, bounds: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window inside one document the sample and the start."""
    n, width = len(v) - size + 1, size - gram + 1
    sums = prefix_sums(v + np.uint64(1))
    _, down = powers(len(v) + 1)
    m = len(v) - gram + 1
    key = mix((sums[gram:] - sums[:m]) * down[:m])
    key = (key & ~_LOW) | np.arange(m, dtype=np.uint64)
    pad = -m % width
    rows = np.append(key, np.full(pad, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & _LOW).astype(np.int64)
    ok = np.ones(n, bool)
    for o in bounds[(bounds > 0) & (bounds < len(v))]:
        ok[max(0, o - size + 1) : o] = False
    return least[ok], np.flatnonzero(ok)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _maybe(values: list[int | None]) -> pa.Array:
    none = np.array([v is None for v in values], bool)
    whole = np.array([v or 0 for v in values], np.uint64).view(np.int64)
    return pa.array(whole, pa.int64(), mask=none)


_PRINTS = "c long, u long, kid long, kh long, pos long, part int"
_CONTEXT = ["c", "kid", "kh", "pos", "whole", "source", "own", "left", "context"]


def _first_prints(docs: DataFrame, win: Windows) -> DataFrame:
    """The sampled positions of every document with the fingerprints of their widest ranges; part holds the
    offsets of the windows that select the sample, low in the upper bits, high in the lower 15."""
    reach, size, gram = win.reach, win.size, win.gram

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        values, counts = win.symbols(*utf8(batch.column(2)))
        offsets = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        at, low, high = sample(values, offsets, size, gram)
        if not len(at):
            return None
        doc = np.searchsorted(offsets, at, "right") - 1
        raw, unit = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize
        cores = [xxh3_64_intdigest(raw[unit * m : unit * (m + gram)], 1) for m in at.tolist()]
        hulls = [
            xxh3_64_intdigest(raw[unit * (m - reach) : unit * (m + size)], 2) if m - reach >= lo and m + size <= hi else None
            for m, lo, hi in zip(at.tolist(), offsets[doc].tolist(), offsets[doc + 1].tolist(), strict=True)
        ]
        take = pa.array(doc)
        columns = [_signed(cores), _maybe(hulls), batch.column(0).take(take), batch.column(1).take(take), pa.array(at - offsets[doc]), pa.array((low << 15 | high).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["c", "u", "kid", "kh", "pos", "part"])

    return map_arrow(docs.select("kid", "kh", "text"), each, _PRINTS)


def _contexts(docs: DataFrame, wanted: DataFrame, win: Windows) -> DataFrame:
    """(c, kid, kh, pos, whole, source, own, left, context): the symbols around each wanted position, left of them
    before it; own: the offsets that select it; the rest as in _judge()."""
    reach, size = win.reach, win.size

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, counts = win.symbols(*utf8(batch.column(2)))
        ends = np.cumsum(counts)
        places = batch.column(3)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
        flat = places.flatten()
        pos, own = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        lo, hi = (ends - counts)[doc], ends[doc]
        start, end = np.maximum(lo, lo + pos - reach), np.minimum(hi, lo + pos + size)
        context = [values[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        take = pa.array(doc)
        columns = [
            flat.field(2), batch.column(0).take(take), batch.column(1).take(take), pa.array(pos), flat.field(3), flat.field(4),
            pa.array(own.astype(np.int32)), pa.array((lo + pos - start).astype(np.int32)), pa.array(context, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_CONTEXT)

    lists = wanted.groupBy("kid", "kh").agg(F.collect_set(F.struct("pos", "part", "c", "whole", "source")).alias("places"))
    joined = docs.select("kid", "kh", "text").join(lists, ["kid", "kh"])
    kinds = "c long, kid long, kh long, pos long, whole boolean, source long, own int, left int, context binary"
    return map_arrow(joined, each, kinds)


def _part_prints(contexts: DataFrame, win: Windows, unit: int) -> DataFrame:
    """Fingerprints of the parts of each context's range, ``step`` offsets each, that have offsets of its own. Equal
    windows select the same sample at the same offset, so each has its parts in the same buckets."""
    reach, size, step = win.reach, win.size, win.step

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        cores, hulls, row, part = [], [], [], []
        for i, (own, left, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("own", "left", "context")), strict=True)):
            n, first, last = len(raw) // unit, own >> 15, own & 32767
            for j, lo in enumerate(range(0, reach + 1, step)):
                hi = min(reach, lo + step - 1)
                if hi < first or lo > last or left - lo < 0 or left - hi + size > n:
                    continue
                cores.append(xxh3_64_intdigest(raw[unit * (left - lo) : unit * (left - hi + size)], 101 + j))
                whole = left - hi >= 0 and left - lo + size <= n
                hulls.append(xxh3_64_intdigest(raw[unit * (left - hi) : unit * (left - lo + size)], 3) if whole else None)
                row.append(i)
                part.append(j)
        take = pa.array(np.array(row, np.int64))
        columns = [_signed(cores), _maybe(hulls), *(batch.column(c).take(take) for c in ("kid", "kh", "pos")), pa.array(np.array(part, np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["c", "u", "kid", "kh", "pos", "part"])

    return map_arrow(contexts, each, _PRINTS)


def window_starts(own: int, left: int, n: int, parts: list[int], win: Windows) -> list[tuple[int, int]]:
    """(start in the context, offset) of the open windows of a context of n symbols: in the parts listed, and its own."""
    first, last = own >> 15, own & 32767
    return [
        (left - d, d)
        for j in sorted(parts)
        for d in range(max(j * win.step, first), min(win.reach, j * win.step + win.step - 1, last) + 1)
        if left - d >= 0 and left - d + win.size <= n
    ]


def _judge(prints: DataFrame, win: Windows, name: str) -> DataFrame:
    """(c, kid, kh, pos, part, whole, refine, source), as a table: the ranges with repeats; whole: every window
    repeats, and source is the least id that holds the hull; refine: the next level has to look at its parts."""
    once = materialise(prints, f"{name}-prints")
    # Tables on both sides of every join, so that a hot bucket can be split among tasks.
    buckets = materialise(once.groupBy("c").agg(F.count("*").alias("n"), F.min("kid").alias("first")).where("n > 1").drop("n"), f"{name}-buckets")
    shared = materialise(once.join(buckets, "c"), f"{name}-shared")
    discard(once)
    # One long, so that the minimum is aggregated by hash; rows that agree in it are both models.
    place = F.xxhash64("kid", "kh", "pos", "part")
    hulls = shared.groupBy("c", "u").agg(F.count("*").alias("n"), F.min("kid").alias("source"), F.max("kid").alias("last"), F.min("first").alias("first"), F.min(place).alias("model"))
    hulls = materialise(hulls, f"{name}-hulls")
    if win.earlier:
        unsettled = F.when(F.col("u").isNull(), F.col("last") > F.col("first")).otherwise(F.col("source") > F.col("first"))
        whole = F.col("u").isNotNull() & (F.col("source") < F.col("kid"))
    else:
        unsettled = F.col("u").isNull() | (F.col("n") == 1)
        whole = F.col("u").isNotNull() & (F.col("n") > 1)
    again = materialise(hulls.where(unsettled).select("c").distinct().withColumn("again", F.lit(True)), f"{name}-again")
    kinds = materialise(hulls.join(again, "c", "left").drop("first", "last"), f"{name}-kinds")
    kind = kinds.select(F.col("c").alias("kind_c"), F.col("u").alias("kind_u"), "n", "source", "model", "again")
    found = shared.join(kind, (F.col("c") == F.col("kind_c")) & F.col("u").eqNullSafe(F.col("kind_u")))
    found = found.withColumn("whole", whole).withColumn("is_model", F.col("model") == place)
    # A bucket with unsettled rows is refined with all of those and one row of each settled kind, which
    # the others may yet agree with in part.
    refine = F.coalesce(F.col("again"), F.lit(False)) & (~F.col("whole") | F.col("is_model"))
    out = found.select("c", "kid", "kh", "pos", "part", "whole", refine.alias("refine"), "source").where("whole or refine")
    out = materialise(out, name)
    discard(buckets, shared, hulls, again, kinds)
    return out


def sampled_ranges(docs: DataFrame, win: Windows, name: str) -> tuple[DataFrame, DataFrame]:
    """The widest ranges around every sample, as _judge() tells them, and the contexts of those that aren't settled.

    ``docs`` is keyed(); it is read twice, once to sample it and once for the contexts.
    """
    first = _judge(_first_prints(docs, win), win, f"{name}-0")
    return first, materialise(_contexts(docs, first.where("refine"), win), f"{name}-contexts")


def narrower_ranges(contexts: DataFrame, win: Windows, unit: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The parts of the contexts' ranges, as _judge() tells them, and the contexts with the column ``parts``: those
    whose single windows are open."""
    second = _judge(_part_prints(contexts, win, unit), win, f"{name}-1")
    parts = second.where("refine").groupBy("kid", "kh", "pos").agg(F.collect_set("part").alias("parts"))
    return second, contexts.join(parts, ["kid", "kh", "pos"])


def whole_spans(ranges: DataFrame, win: Windows, narrow: bool) -> DataFrame:
    """(kid, kh, start, end, source) of the settled ranges in which every window repeats."""
    low = F.col("part") * win.step if narrow else F.lit(0)
    high = F.least(F.lit(win.reach), F.col("part") * win.step + (win.step - 1)) if narrow else F.lit(win.reach)
    start, end = (F.col("pos") - high).alias("start"), (F.col("pos") - low + win.size).alias("end")
    return ranges.where("whole").select("kid", "kh", start, end, "source")


def by_document(*found: DataFrame) -> DataFrame:
    """(kid, kh, spans): per document key the spans [start, end) in symbols and the least id each was found in; spans
    may overlap. Documents without are absent."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("kid", "kh").agg(F.collect_set(F.struct("start", "end", "source")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, starts, ends, sources) for every document; no spans: empty lists."""
    field = lambda name: F.coalesce(F.transform("spans", lambda s: s[name]), F.array().cast("array<long>")).alias(f"{name}s")
    return docs.join(spans, ["kid", "kh"], "left").select("doc_id", "text", field("start"), field("end"), field("source"))


def spans_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, sources) of each row of with_spans(). Arrays, as a text of one repeated line has a span
    for almost every symbol."""
    columns = [batch.column(c) for c in ("starts", "ends", "sources")]
    at = columns[0].offsets.to_numpy() - columns[0].offsets[0].as_py()
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    return [tuple(f[a:b] for f in flat) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs covered by the spans; runs that touch are one."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return list(zip(starts[new].tolist(), ends[last].tolist(), strict=True))


__all__ = ["Windows", "by_document", "narrower_ranges", "sample", "sampled_ranges", "spans_of", "union", "whole_spans", "window_starts", "with_spans"]
