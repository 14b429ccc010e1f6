"""A persisted index of words: postings in buckets by term, in blocks with upper bounds, and counts that follow changes.

A block is a term's postings of one range of ``span`` keys. Ranges are the same for all terms, so what the blocks of a range can
give at most adds up to a bound of any document in it. A search reads the bounds of its terms, scores the few ranges of the
greatest bounds, and then only ranges whose bound reaches the k-th score found; the others' postings aren't scored. Its
result is that of scoring everything. A hot term is many blocks, of ``span`` postings at most for distinct keys. The blocks that a
term has in one frame of texts are one row, as a row a block would be mostly rows for rare terms, of two postings on average.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Settings
from tessera.functions import strings
from tessera.operators import frames
from tessera.sources.sinks import SnapshotStore


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class TextStatistics:
    """How many documents have each term and how long documents are, kept as signed changes.

    Each change is a folder of (term, df, tf) sums, with a null term for the documents' number and length; what stands is the sum of
    all. A folder is named after its version, so a change that is written again replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, text: str) -> None:
        self.spark, self.path, self.key, self.text = spark, path.rstrip("/"), key, text

    def _hadoop(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions with a complete change; a compaction is under the last version that it holds."""
        at, fs = self._hadoop("change-*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName().split("-")[1]) for f in fs.globStatus(at) or [])

    def _sums(self, docs: DataFrame, sign: int) -> DataFrame:
        rows = docs.select(strings.words(F.coalesce(F.col(self.text), F.lit(""))).alias("w"))
        # The distinct terms say in how many documents, all of them how often; both are added up before the shuffle.
        kinds = F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("tf")))
        times = F.transform("w", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("tf")))
        whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("df"), F.size("w").alias("tf")))
        each = rows.select(F.explode(F.concat(kinds, times, whole)).alias("e")).select("e.*")
        return each.groupBy("term").agg((F.sum("df") * sign).alias("df"), (F.sum("tf") * sign).alias("tf"))

    def change(self, version: int, came: DataFrame | None, gone: DataFrame | None = None) -> None:
        """Add the documents that came and take away those that went."""
        parts = [self._sums(rows, sign) for rows, sign in ((came, 1), (gone, -1)) if rows is not None]
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
        self.write(version, both)

    def write(self, version: int, sums: DataFrame) -> None:
        """A version's change as sums (term, df, tf)."""
        sums.where("df <> 0 OR tf <> 0").write.mode("overwrite").parquet(f"{self.path}/change-{version}")

    def follow(self, store: SnapshotStore) -> int:
        """Bring the counts to the store's version by the rows that came and went since the last one followed, reading
        touched buckets alone. If the version before is no longer kept, everything is counted anew."""
        now, last = store.version(), max(self.versions(), default=0)
        if now == last:
            return now
        if last and last not in store.versions():
            rows = store.read(now)
            none = self.spark.createDataFrame([], "term string, df long, tf long")
            self._replace(now, none if rows is None else self._sums(rows, 1))
            return now
        gone, came = store.around(last, now)  # what stands on both sides is counted away
        if came is not None or gone is not None:
            self.change(now, came, gone)
        return now

    def _replace(self, version: int, sums: DataFrame) -> None:
        """One change in the place of all before. The new one is complete under another name before any goes."""
        old = self.versions()
        at, fs = self._hadoop(f"next-{version}")
        sums.write.mode("overwrite").parquet(f"{self.path}/next-{version}")
        for v in old:
            fs.delete(self._hadoop(f"change-{v}")[0], True)
        fs.rename(at, self._hadoop(f"change-{version}")[0])

    def compact(self) -> None:
        versions = self.versions()
        if len(versions) > 1:
            self._replace(versions[-1], self._all())

    def _all(self) -> DataFrame:
        folders = [f"{self.path}/change-{v}" for v in self.versions()]
        rows = self.spark.read.schema("term string, df long, tf long").parquet(*folders)
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df <> 0 OR tf <> 0")

    def terms(self) -> DataFrame:
        """(term, df, tf)."""
        return self._all().where("term IS NOT NULL")

    def totals(self) -> tuple[int, float]:
        """(documents, average length)."""
        row = self._all().where("term IS NULL").first()
        return (row["df"], row["tf"] / row["df"]) if row and row["df"] else (0, 0.0)


#: Bytes of text of a frame, and the columns of a term's blocks in it: of each block its range, number and bounds, then all postings by
#: range and key, as packed numbers. Keyless rows have no range; their key is null.
FRAME_BYTES = 12 << 20
_BLOCKS = "term string, keyless boolean, ranges binary, counts binary, max_tfs binary, min_lens binary, keys binary, tfs binary, lens binary, df int, tf int"


def _word_blocks(frame: pa.RecordBatch) -> pa.RecordBatch:
    """The blocks of a frame of texts whose words stand between single spaces: (word, row) pairs are counted by sorting."""
    words = pc.split_pattern(frame.column("text"), " ")
    length = np.diff(words.offsets.to_numpy()).astype(np.int32)
    coded = words.flatten().dictionary_encode()
    pairs = coded.indices.to_numpy().astype(np.int64) * len(frame) + np.repeat(np.arange(len(frame)), length)
    pairs, tf = np.unique(pairs, return_counts=True)
    code, row = np.divmod(pairs, len(frame))
    tf, lens = tf.astype(np.int32), length[row]
    keys, ranges = (pc.fill_null(frame.column(c), 0).to_numpy() for c in ("key", "range"))
    new = np.concatenate([[True], np.diff(code) != 0])
    first = np.flatnonzero(new)  # a term's postings, then a block's
    start = np.flatnonzero(new | np.concatenate([[True], np.diff(np.cumsum(frames.changes(frame.column("range")))[row]) != 0]))
    all_of, blocks_of = np.append(first, len(pairs)), np.append(np.searchsorted(start, first), len(start))
    columns = {
        "term": coded.dictionary.take(pa.array(code[first])),
        "keyless": pa.array(np.full(len(first), frame.column("range").null_count > 0)),
        "ranges": frames.packed(ranges[row[start]], blocks_of),
        "counts": frames.packed(np.diff(np.append(start, len(pairs))).astype(np.int32), blocks_of),
        "max_tfs": frames.packed(np.maximum.reduceat(tf, start), blocks_of),
        "min_lens": frames.packed(np.minimum.reduceat(lens, start), blocks_of),
        "keys": frames.packed(keys[row], all_of),
        "tfs": frames.packed(tf, all_of),
        "lens": frames.packed(lens, all_of),
        "df": pa.array(np.diff(all_of), pa.int32()),
        "tf": pa.array(np.add.reduceat(tf, first), pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _unpack(names: list[str], per_block: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, range, ...) of every block, or of every posting."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            values, n = frames.unpacked(rows.column("ranges"), np.int64)
            row = np.repeat(np.arange(len(rows)), n)
            if not per_block:
                count = frames.unpacked(rows.column("counts"), np.int32)[0]
                values, row = np.repeat(values, count), np.repeat(row, count)
            keyless = rows.column("keyless").to_numpy(zero_copy_only=False)[row]
            columns = [rows.column("term").take(pa.array(row)), pa.array(values, mask=keyless)]
            for name in names:
                value = frames.unpacked(rows.column(name), np.int64 if name == "keys" else np.int32)[0]
                columns.append(pa.array(value, mask=keyless if name == "keys" else None))
            yield pa.RecordBatch.from_arrays(columns, ["term", "range", *[name[:-1] for name in names]])

    return each


def _bounds(rows: DataFrame) -> DataFrame:
    """(term, range, max_tf, min_len) of each block; its postings aren't read."""
    names = ["max_tfs", "min_lens"]
    return rows.select("term", "keyless", "ranges", *names).mapInArrow(_unpack(names, True), "term string, range long, max_tf int, min_len int")


def _postings(rows: DataFrame) -> DataFrame:
    """(term, range, key, tf, len) of each posting."""
    names = ["keys", "tfs", "lens"]
    return rows.select("term", "keyless", "ranges", "counts", *names).mapInArrow(_unpack(names, False), "term string, range long, key long, tf int, len int")


@dataclass
class Hits:
    """The best documents, and how many ranges were asked about and read."""

    rows: DataFrame
    ranges: int
    read: int


class PostingsIndex:
    """Postings of one text of a table under ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, span: int = 256, settings: Settings = DEFAULT) -> None:
        self.spark, self.path, self.key, self.buckets, self.span, self.settings = spark, path.rstrip("/"), key, buckets, span, settings
        self.statistics = TextStatistics(spark, f"{self.path}/statistics", key, "text")

    def build(self, docs: DataFrame, text: str) -> PostingsIndex:
        """Index every row, by one shuffle of the texts: a task has whole ranges and makes their blocks by arrays, so that a hot term
        is as many tasks as ranges. Counts come from the blocks that are written."""
        spaced = F.trim(F.regexp_replace(F.lower(F.col(text)), strings.NO_WORD, " "))  # as strings.words, which Python doesn't split alike
        rows = frames.dealt(docs, self.key, spaced, self.span, self.span)
        blocks = frames.blocks(rows, _word_blocks, _BLOCKS, FRAME_BYTES)
        blocks = blocks.withColumn("bucket", _bucket(F.col("term"), self.buckets)).sortWithinPartitions("bucket", "term")
        blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        made = self.spark.read.schema(f"{_BLOCKS}, bucket int").parquet(f"{self.path}/postings")
        sums = made.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
        length = made.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tf"))
        whole = docs.agg(F.count("*").alias("df")).crossJoin(length).select(F.lit(None).cast("string").alias("term"), "df", "tf")
        self.statistics.write(1, sums.unionByName(whole))
        return self

    def _blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of these terms: their buckets' folders alone are listed, the term is pushed down into them."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), self.buckets)).distinct().collect()
        rows = self.spark.read.schema(f"{_BLOCKS}, bucket int").parquet(f"{self.path}/postings")
        return rows.where(F.col("bucket").isin(*[r[0] for r in asked]) & F.col("term").isin(*terms))

    def candidates(self, terms: list[str]) -> DataFrame:
        """(key): the documents with any of the terms."""
        terms = sorted(set(terms))
        if not terms:
            return self.spark.createDataFrame([], f"{self.key} long")
        return _postings(self._blocks(terms)).select(F.col("key").alias(self.key)).distinct()

    def _weight(self, idf: Column, tf: Column, length: Column, average: float) -> Column:
        k1, b = self.settings.bm25_k1, self.settings.bm25_b
        return idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(average))))

    def _idf(self, terms: list[str]) -> tuple[Column, float] | None:
        total, average = self.statistics.totals()
        df = {r["term"]: r["df"] for r in self.statistics.terms().where(F.col("term").isin(*terms)).collect()}
        if not df:
            return None
        idf = {t: math.log(1 + (total - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        return F.element_at(F.create_map(*[F.lit(x) for pair in idf.items() for x in pair]), F.col("term")), average

    def _scored(self, postings: DataFrame, idf: Column, average: float) -> DataFrame:
        weight = self._weight(idf, F.col("tf"), F.col("len"), average)
        return postings.groupBy(F.col("key").alias(self.key)).agg(F.sum(weight).alias("score"))

    def search(self, terms: list[str], k: int, first: int | None = None) -> Hits:
        """The k best documents (key, score), equal scores by key. ``first``: ranges that a first k-th score is taken from, k by default."""
        terms = sorted(set(terms))
        weights = self._idf(terms) if terms else None
        if weights is None:
            return Hits(self.spark.createDataFrame([], f"{self.key} long, score double"), 0, 0)
        idf, average = weights
        blocks = self._blocks(terms)
        bound = self._weight(idf, F.col("max_tf"), F.col("min_len"), average)
        most = _bounds(blocks).groupBy("range", "term").agg(F.max(bound).alias("bound"))  # a long range is several blocks of a term
        bounds = most.groupBy("range").agg((F.sum("bound") * (1 + 1e-9)).alias("bound"))  # sums may be rounded otherwise
        head = bounds.orderBy(F.desc("bound"), "range").limit(first or k).collect()
        postings = _postings(blocks)
        at = postings.where(F.col("range").isin(*[r["range"] for r in head if r["range"] is not None]))
        known = self._scored(at, idf, average).orderBy(F.desc("score")).limit(k).collect()
        floor = known[-1]["score"] if len(known) == k else 0.0
        open_ranges = bounds.where(F.col("bound") >= floor)
        count = bounds.agg(F.count("*"), F.count_if(F.col("bound") >= floor)).first()
        # A null key has a null range, which is read whenever it is open.
        kept = postings.join(open_ranges.select(F.col("range").alias("open")), F.col("range").eqNullSafe(F.col("open")), "left_semi")
        rows = self._scored(kept, idf, average).orderBy(F.desc("score"), self.key).limit(k)
        return Hits(rows, count[0], count[1])
