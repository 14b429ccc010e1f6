"""Repeated passages of words by relative Lempel-Ziv parsing against an index of reference blocks.

A document is parsed relative to the documents before it (smaller ids); words in sufficiently long factors, 50 words with
what lies before a factor's boundary, are duplicates.

1. *Index.* A reference block is the words around a sampled gram of an earlier document, a window's reach to either side
   (``anchors``: equal windows sample the same gram at the same place, so a window of 50 words lies inside
   a block). Blocks are indexed by their gram; equal blocks are one, under the least id that has it.
2. *Matching.* A block that stands whole in an earlier document is a match as it is. Elsewhere the blocks of the
   same gram are shipped to the document's own words, and each match is grown word by word to both sides
   as far as it goes. A gram with more than ``few`` distinct blocks has them compared range by range and, where that
   leaves a range open, window by window, so that no document meets all blocks of a common gram.
3. *Parsing.* ``factor`` parses greedily from left to right: at each word the match that reaches furthest, else a
   literal. A greedy parse by longest matches from a word on misses a window that begins in one factor and
   ends in the next and yet stands whole in a third document. Matches here are grown to the left too, so at a
   factor's boundary every match that covers it is at hand, and those of 50 words or more are factors.

Word comparisons are of 64-bit hashes, of which a window has 50; block and range comparisons are of 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tessera.llm import lexer
from tessera.llm.anchors import (
    Windows,
    by_document,
    narrower_ranges,
    sampled_ranges,
    spans_of,
    whole_spans,
    window_starts,
    with_spans,
)
from tessera.llm.common import discard, keyed, map_arrow, materialise, utf8

#: Bytes of a word's hash in a context.
_UNIT = 8
_SPANS = "kid long, kh long, start long, end long, source long"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, counts = lexer.words(data, offsets)
    return hashes, counts


def grow(own: np.ndarray, left: int, block: np.ndarray, block_left: int) -> tuple[int, int]:
    """(words before, words from) the gram's start that agree without a gap between a document's words and a block; the
    gram starts at ``left`` and ``block_left``."""
    n = min(len(own) - left, len(block) - block_left)
    same = own[left : left + n] == block[block_left : block_left + n]
    after = n if same.all() else int(same.argmin())
    n = min(left, block_left)
    same = own[left - n : left][::-1] == block[block_left - n : block_left][::-1]
    return n if same.all() else int(same.argmin()), after


def _index(contexts: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """(c, blocks): the distinct reference blocks of each gram with ``few`` at most; and (c), the grams with more."""
    holder = F.when(F.col("whole"), F.col("source")).otherwise(F.col("kid"))
    rows = contexts.select("c", "left", "context", holder.alias("source"), F.xxhash64("context").alias("x"), F.xxhash64(F.lit(7), "context").alias("y"))
    blocks = rows.groupBy("c", "left", "x", "y").agg(F.min("source").alias("source"), F.first("context").alias("context"))
    blocks = materialise(blocks.drop("x", "y"), "rlz-blocks")
    counts = materialise(blocks.groupBy("c").agg(F.count("*").alias("n")), "rlz-counts")
    index = blocks.join(counts.where(F.col("n") <= few), "c").groupBy("c").agg(F.collect_list(F.struct("source", "left", "context")).alias("blocks"))
    return materialise(index, "rlz-index"), counts.where(F.col("n") > few).select("c")


def _grown(asked: DataFrame, win: Windows) -> DataFrame:
    """The matches of ``size`` words or more of each context with the blocks of its gram that earlier documents hold."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("kid", "kh", "pos", "left", "context", "blocks")), strict=True)
        for kid, kh, pos, left, raw, blocks in rows:
            own = np.frombuffer(raw, np.uint64)
            for block in blocks:
                if block["source"] < kid:
                    before, after = grow(own, left, np.frombuffer(block["context"], np.uint64), block["left"])
                    if after >= win.gram and before + after >= win.size:
                        found.append((kid, kh, pos - before, pos + after, block["source"]))
        if not found:
            return None
        columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["kid", "kh", "start", "end", "source"])

    return map_arrow(asked.select("kid", "kh", "pos", "left", "context", "blocks"), each, _SPANS)


def _single(open_: DataFrame, win: Windows) -> DataFrame:
    """The open windows, each by itself, that an earlier document has among its own."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found, digests = [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("kid", "kh", "pos", "own", "left", "context", "parts")), strict=True)
        for kid, kh, pos, own, left, raw, parts in rows:
            for at, d in window_starts(own, left, len(raw) // _UNIT, parts, win):
                found.append((kid, kh, pos - d))
                digests.append(xxh3_128_digest(raw[_UNIT * at : _UNIT * (at + win.size)]))
        if not found:
            return None
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        columns = [pa.array(both[:, 0]), pa.array(both[:, 1]), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "kid", "kh", "start"])

    windows = materialise(map_arrow(open_, each, "h1 long, h2 long, kid long, kh long, start long"), "rlz-windows")
    first = windows.groupBy("h1", "h2").agg(F.min("kid").alias("source"))
    found = windows.join(first, ["h1", "h2"]).where("source < kid")
    return found.select("kid", "kh", "start", (F.col("start") + win.size).alias("end"), "source")


def duplicate_words(
    docs: DataFrame, size: int = 50, gram: int | None = None, few: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, starts, ends, sources): every document with its matches, the spans of ``size`` words or more that
    also stand in a document with a smaller id, and an id that has them. Matches may overlap.

    A null text has no words. A null id is smaller than all others. Rows with equal ids are not
    before each other.
    """
    gram = gram or max(1, size * 2 // 5)
    rows = keyed(docs, id_col, text_col)
    win = Windows(size, gram, max(1, int((size - gram + 1) ** 0.5 + 0.999)), _words, earlier=True)
    first, contexts = sampled_ranges(rows, win, "rlz")
    index, common = _index(contexts, few)
    grown = _grown(contexts.where("not whole").join(index, "c"), win)
    second, open_ = narrower_ranges(contexts.join(common, "c", "left_semi"), win, _UNIT, "rlz")
    found = by_document(whole_spans(first, win, False), grown, whole_spans(second, win, True), _single(open_, win))
    spans = materialise(found, "rlz-spans")
    discard(first, contexts, index, second)
    return with_spans(rows, spans)


def factor(n: int, starts: list[int], ends: list[int], sources: list[int]) -> list[tuple[int, int, int | None]]:
    """The greedy parse of n words into (start, end, source): copies, and runs of literals with None.

    Matches of one source that overlap are one match there, longer than a block.
    """
    matches: dict[int, list[list[int]]] = {}
    for a, b, s in sorted(zip(starts, ends, sources, strict=True), key=lambda x: (x[2], x[0], x[1])):
        own = matches.setdefault(s, [])
        if own and a < own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    spans = sorted((a, b, s) for s, own in matches.items() for a, b in own)
    out, at, i, best = [], 0, 0, (0, None)
    while at < n:
        while i < len(spans) and spans[i][0] <= at:
            if spans[i][1] > best[0]:
                best = (spans[i][1], spans[i][2])
            i += 1
        if best[0] > at:
            out.append((at, best[0], best[1]))
            at = best[0]
        else:
            near = spans[i][0] if i < len(spans) else n
            out.append((at, near, None))
            at = near
    return out


def parse(docs: DataFrame, size: int = 50, **columns: str) -> DataFrame:
    """(doc_id, kept, factors): the kept words joined by spaces and the greedy parse of each document."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, factors = [], []
        for text, n, start, end, at, to, source in _documents(batch):
            parsed = factor(n, at.tolist(), to.tolist(), source.tolist())
            kept.append(_rest(text, n, start, end, [f[:2] for f in parsed if f[2] is not None]))
            factors.append([{"start": a, "end": b, "source": s} for a, b, s in parsed])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([k.decode() for k in kept], pa.string()), pa.array(factors, kind)], names=["doc_id", "kept", "factors"])

    return map_arrow(duplicate_words(docs, size, **columns), each, "doc_id long, kept string, factors array<struct<start:long,end:long,source:long>>")


def _documents(batch: pa.RecordBatch):
    data, offsets = utf8(batch.column(1))
    _, start, end, counts = lexer.words(data, offsets)
    ends = np.cumsum(counts)
    raw = data.tobytes()
    for i, (n, spans) in enumerate(zip(counts.tolist(), spans_of(batch), strict=True)):
        own = slice(int(ends[i]) - n, int(ends[i]))
        yield raw, n, start[own], end[own], *spans


def _rest(raw: bytes, n: int, start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    keep = np.ones(n, bool)
    for a, b in spans:
        keep[a:b] = False
    return b" ".join([raw[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True)])


def spans_digest(docs: DataFrame, size: int = 50) -> DataFrame:
    """The digest columns of the query."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw, n, start, end, at, to, source in _documents(batch):
            spans = [f[:2] for f in factor(n, at.tolist(), to.tolist(), source.tolist()) if f[2] is not None]
            rows.append((n, sum(b - a for a, b in spans), hashlib.sha256(_rest(raw, n, start, end, spans)).hexdigest()))
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_arrow(duplicate_words(docs, size), each, "doc_id long, n_words long, n_removed long, kept_sha256 string")
