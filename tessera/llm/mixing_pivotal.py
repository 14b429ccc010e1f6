"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents. The
whole part is taken outright. The fractional parts are rounded by the pivotal method: two
fractional probabilities meet, and mass moves from one to the other, at random in direction,
until one is integral; the other goes on to the next. Mass is measured in words (probability times
size), so a source's expected and realised words agree but for what the last fractional document
leaves. Every step, which documents meet is decided by what happened before alone, and the last document is rounded
by its own probability, so every document keeps its own expected number of copies. Nothing is drawn again.

The pairing is a reduction tree. Documents are dealt to blocks by a hash; one task reduces a block
of a source to at most one fractional document and some small ones; these residuals are dealt to fewer blocks, and so
on until a source has one block. No task holds more than about ``block`` documents of one key: a
hot source is many blocks, and rows that repeat a document are numbered and dealt apart. Random numbers are a hash of
seed, level and ids, so reruns agree however the rows are dealt.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from xxhash import xxh3_64_intdigest

from tessera.llm.common import NULL_ID, discard, materialise
from tessera.runtime import ship

WORD = "[^\\x20\\x09-\\x0D]+"
_EPS = 1e-9


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, n_docs, source_size, target) of (source, size) rows.

    Sources in code point order, null last, take the weights in turn. Targets share ``share`` of all
    sizes by weight; a target stops at ``most`` times its source's size and its excess is shared by
    weight among the others until none is above. In closed form: ordered by stop over weight,
    sources stop until the level of the rest fits the next one. The table has a row for each source.
    """
    by = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").cast("long").alias("source_size"))
    # One row a source: the only single-partition step, over the aggregate.
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    rise = W.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = rise.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    total = F.sum("source_size").over(every) * F.lit(float(share))
    left = F.greatest(total - F.coalesce(F.sum("stop").over(before), F.lit(0.0)), F.lit(0.0))
    weigh = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / weigh).withColumn("turn", F.row_number().over(rise))
    # The first source whose stop is above its share at that level, and all after it, get that level.
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct(F.col("turn"), F.col("level")))).over(every)
    target = F.when(free.isNull(), F.col("stop")).otherwise(F.least(F.col("stop"), free["level"] * F.col("weight")))
    return by.withColumn("target", target).select("source", "n_docs", "source_size", "target")


def _unit(seed: int, *ids: int) -> float:
    """A number in [0, 1) from a hash of the ids."""
    text = ",".join(map(str, (seed, *ids))).encode()
    return (xxh3_64_intdigest(text) >> 11) / 2**53


#: A document of more than this share of the words of all smaller ones is heavy.
HEAVY = 64
#: A fractional document: kid, kh, twin (its number among equal rows), size in words, probability.
Row = tuple[int, int, int, int, float]


def _settle_heavy(rows: list[list], seed: int, level: int) -> int:
    """Round the first of ``rows`` (by size, largest first) against all that are smaller as one partner, as long as the
    first has more than 1/HEAVY of their words; returns how many are settled.

    A partner so much smaller than the document would end integral and leave it fractional. What moves is dealt among
    the smaller ones by size and p (1 - p), which keeps the words and every expectation.
    """
    sizes = np.array([r[3] for r in rows], np.float64)
    p = np.array([r[4] for r in rows], np.float64)
    rest = np.append(np.cumsum(sizes[::-1])[::-1][1:], 0.0)
    done = 0
    while done < len(rows) - 1 and sizes[done] * HEAVY > rest[done]:
        tail, q = slice(done + 1, None), p[done]
        spread = p[tail] * (1 - p[tail])
        whole = float(spread @ sizes[tail])
        up, down = (1 - q) * sizes[done], q * sizes[done]
        if up * (1 - p[tail].min()) >= whole or down * p[tail].max() >= whole:
            break
        if _unit(seed, level, *rows[done][:3]) < q:
            p[done], p[tail] = 1.0, p[tail] - up * spread / whole
        else:
            p[done], p[tail] = 0.0, p[tail] + down * spread / whole
        done += 1
    for row, x in zip(rows, p.tolist(), strict=True):
        row[4] = x
    return done


def _integral(p: float) -> bool:
    return p <= _EPS or p >= 1 - _EPS


def pivot(rows: list[Row], seed: int, level: int, last: bool = False, spare: int = 0) -> list[Row]:
    """Reduce rows to integral ones but for one at most; with ``last`` that one is rounded by its probability too.
    Of the smallest documents ``spare`` stay out of it, and up to as many of the largest that have more than 1/64 of the
    words of those after them: the next level has small ones to end with, and more of them to set against a large one.

    Of two, mass in words moves by as much as makes one integral, up or down with the odds that keep
    both expectations. Large documents pair first, so that the last fractional one is small.
    """
    out = [(*r[:4], float(round(r[4])) if r[3] > 0 else 0.0) for r in rows if _integral(r[4]) or r[3] <= 0]
    open_ = sorted((list(r) for r in rows if not _integral(r[4]) and r[3] > 0), key=lambda r: (-r[3], *r[:3]))
    if spare:
        kept = len(open_) - min(spare, len(open_))
        out += [tuple(r) for r in open_[kept:]]
        del open_[kept:]
        rest, done = sum(r[3] for r in open_), 0
        while done < min(spare, len(open_)) and open_[done][3] * HEAVY > (rest := rest - open_[done][3]):
            done += 1
    else:
        done = _settle_heavy(open_, seed, level)
    out += [tuple(r) for r in open_[:done]]
    heap = [(-r[3], *r[:3], r[4]) for r in open_[done:]]
    heapq.heapify(heap)
    while len(heap) > 1:
        (sa, *a, p), (sb, *b, q) = heapq.heappop(heap), heapq.heappop(heap)
        sa, sb = -sa, -sb
        up = min((1 - p) * sa, q * sb)  # words that can move from b to a
        down = min(p * sa, (1 - q) * sb)
        if _unit(seed, level, *a, *b) < down / (up + down):
            p, q = p + up / sa, q - up / sb
        else:
            p, q = p - down / sa, q + down / sb
        for size, ids, x in ((sa, a, p), (sb, b, q)):
            if _integral(x):
                out.append((*ids, size, float(round(x))))
            else:
                heapq.heappush(heap, (-size, *ids, x))
    for size, *ids, x in heap:
        out.append((*ids, -size, float(_unit(seed, level, 1, *ids) < x) if last else x))
    return out


_REDUCED = "source_no long, n_docs long, kid long, kh long, twin long, size long, p double"


def _reduce(rows: DataFrame, blocks: str, seed: int, level: int, last: bool, spare: int) -> DataFrame:
    """One level of the tree over (source_no, kid, kh, twin, size, p); ``blocks``: the expression of a row's block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                got = pivot(sorted(held), seed, level, last, 0 if last else spare)
                held.clear()
                n = len(got)
                kinds = (*[pa.int64()] * 4, pa.float64())
                columns = [pa.array(list(c), k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)]
                columns = [pa.array([at[0]] * n, pa.int64()), pa.array([at[2]] * n, pa.int64()), *columns]
                yield pa.RecordBatch.from_arrays(columns, names=["source_no", "n_docs", "kid", "kh", "twin", "size", "p"])

        for batch in batches:
            for no, block, n_docs, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or (no, block) != at[:2]:
                    yield from done()
                    at = (no, block, n_docs)
                held.append(tuple(row))
        yield from done()

    block = F.expr(blocks).cast("long").alias("block")
    ship(rows.sparkSession)
    dealt = rows.select("source_no", block, "n_docs", "kid", "kh", "twin", "size", "p")
    dealt = dealt.repartition("source_no", "block").sortWithinPartitions("source_no", "block")
    return dealt.mapInArrow(each, _REDUCED)


def _numbered_twins(groups: DataFrame, chunk: int = 4096) -> DataFrame:
    """A row for each of the ``twins`` of a group, numbered from 1 in ``twin``; a large group is dealt before it grows."""
    chunks = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("twins") - 1) / chunk))))
    if (groups.agg(F.max("twins")).first()[0] or 0) > chunk:
        chunks = chunks.repartition("kid", "kh", "part")
    first = F.col("part") * chunk + 1
    twin = F.explode(F.sequence(first, F.least(F.col("twins"), first + (chunk - 1)))).alias("twin")
    return chunks.select(*[c for c in groups.columns if c != "twins"], twin)


def _twin_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their numbers among rows of equal ``keys``: within a partition they were written by (pid), after
    those of the partitions before, so equal rows are counted where they lie."""
    within = F.row_number().over(W.partitionBy(*keys, "pid").orderBy("size"))
    parts = rows.groupBy(*keys, "pid").agg(F.count("*").alias("here"))
    before = F.sum("here").over(W.partitionBy(*keys).orderBy("pid").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(*keys, "pid", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.withColumn("within", within).join(parts, [*keys, "pid"]).withColumn("twin", F.col("before") + F.col("within"))


def _key() -> list:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("kid"), F.xxhash64(text).alias("kh"), F.col("source").cast("string").alias("source")]


def _size():
    return F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, share: float = 1.0, block: int = 4096, seed: int = 17) -> DataFrame:
    """(doc_id, kid, kh, source, size, source_size, target, copies) for every row of documents.

    A null text and a text without words have size 0 and no copies. A null source is a source of its
    own. Rows that are equal in id and text are separate documents. An empty table gives no rows.
    """
    pid = F.spark_partition_id().alias("pid")
    sized = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(), _size().alias("size"), pid), "mix-sized")
    targets = source_targets(sized, weights, most, share)
    numbered = targets.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))).cast("long"))
    numbered = materialise(numbered, "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(F.broadcast(numbered) if numbered.count() <= 100_000 else numbered, sized["source"].eqNullSafe(numbered["source"]))
    rows = rows.select(sized["*"], "n_docs", "source_size", "target", "source_no", rate.alias("rate"))
    part = F.col("rate") - F.floor(F.col("rate") + F.lit(_EPS))
    keys = ["source_no", "kid", "kh"]
    live = rows.where((F.col("size") > 0) & (part > _EPS)).groupBy(*keys, "n_docs", "size", part.alias("p")).agg(F.count("*").alias("twins"))
    live = _numbered_twins(live)
    most_docs = numbered.agg(F.max("n_docs")).first()[0] or 0
    done, level, made = [], 0, [sized, numbered]
    spare = min(64, block // 16)
    while most_docs > 0:
        # Several blocks are half full on average, so that chance never doubles them.
        blocks = f"pmod(xxhash64(kid, kh, twin, {seed}, {level}), if(n_docs > {block}, ceil(2 * n_docs / {block}), 1))"
        many = most_docs > block
        got = materialise(_reduce(live, blocks, seed, level, not many, spare), f"mix-level{level}")
        made.append(got)
        done.append(got.where(F.col("p") >= 1 - _EPS))
        if not many:
            break
        live = got.where((F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)).withColumn("n_docs", F.ceil(2 * F.col("n_docs") / block) * (2 * spare + 1))
        most_docs, level = -(-2 * most_docs // block) * (2 * spare + 1), level + 1
    out = _twin_of_each(rows.drop("n_docs"), keys)
    extra = F.lit(0)
    if done:
        taken = done[0]
        for more in done[1:]:
            taken = taken.unionByName(more)
        out = out.join(taken.select(*keys, "twin", F.lit(1).alias("one")), [*keys, "twin"], "left")
        extra = F.coalesce(F.col("one"), F.lit(0))
    copies = F.when(F.col("size") > 0, F.floor(F.col("rate") + F.lit(_EPS)) + extra).otherwise(0).cast("long")
    out = out.select("doc_id", "kid", "kh", "source", "size", "source_size", "target", copies.alias("copies"))
    mixed = materialise(out, "mix-copies")
    discard(*made)
    return mixed


def mix_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the query; of equal rows, which has which number may differ between reruns."""
    taken = (F.col("copies") * F.col("size")).cast("long")
    return mix(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


def materialise_mix(docs: DataFrame, columns: list[str], **parameters: object) -> DataFrame:
    """The mixed corpus itself: each taken document once for each copy, with ``columns`` and size,
    source_size, target, copies and copy (from 1), each named mix_… where ``columns`` has its name.
    Rows equal in id, text and source share their copies."""
    keys = ["kid", "kh", "source"]
    mixed = mix(docs, **parameters).groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("size", "source_size", "target")], F.sum("copies").alias("copies"))
    mixed = mixed.where("copies > 0").select(*[F.col(c).alias(f"mix_{c}") for c in mixed.columns])
    kid, kh, source = _key()
    rows = docs.select(F.struct(*columns).alias("row"), kid, kh, source).dropDuplicates(keys)
    same = (F.col("kid") == F.col("mix_kid")) & (F.col("kh") == F.col("mix_kh")) & F.col("source").eqNullSafe(F.col("mix_source"))
    free = lambda c: f"mix_{c}" if c in columns else c
    sizes = [F.col(f"mix_{c}").alias(free(c)) for c in ("size", "source_size", "target", "copies")]
    return rows.join(mixed, same).select("row.*", *sizes, F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias(free("copy")))
