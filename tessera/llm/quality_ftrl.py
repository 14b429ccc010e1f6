"""Quality classifier: hashed word n-gram logistic regression, learned by following the regularised leader.

A text's features are counts of hashed n-grams of three readings of its words: the words in lower case
(1 and 2 words), their shapes (1 to 3; letters and digits by class, runs of a class as one, other
characters as they are) and their echoes (1; which of the three words before is the same). Counts are divided by
the reading's length and the root is taken, so texts of every length weigh alike. A score is the sparse
dot product of a text's features with the weights, through the logistic function.

Weights are learned example by example with per-coordinate rates and L1 and L2 terms (FTRL-proximal),
in one task, on a bounded sample of labelled rows. They are a vector of ``bits`` hash bits whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.llm import lexer
from tessera.llm.common import least_hashed, map_arrow, text_or_empty, utf8
from tessera.runtime import ship

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_CLASS[9:14] = 32


@dataclass(frozen=True)
class Ftrl:
    """``bits``: of a feature's hash. ``per_class``: whole labelled texts of each class to learn from at most,
    those with the least hashes of their ids and texts."""

    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    epochs: int = 3
    per_class: int = 3000


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes by class with runs of one class cut to one byte."""
    kind = _CLASS[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[offsets[:-1][offsets[:-1] < len(kind)]] = True
    at = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return kind[keep], at[offsets]


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of every text, sorted by text."""
    n = len(offsets) - 1
    words, _, _, counts = lexer.words(data, offsets, lower=True)
    shapes, _, _, shape_counts = lexer.words(*_shapes(data, offsets))
    text = np.repeat(np.arange(n), counts)
    echo = np.zeros(len(words), np.uint64)
    for k in (1, 2, 3):
        same = (words[k:] == words[:-k]) & (text[k:] == text[:-k])
        echo[k:] |= same.astype(np.uint64) << np.uint64(k)
    docs, keys, values = [], [], []
    for reading, (h, c, sizes) in enumerate(((words, counts, (1, 2)), (shapes, shape_counts, (1, 2, 3)), (lexer.mix(echo + np.uint64(1)), counts, (1,)))):
        for size in sizes:
            grams, have = lexer.ngrams(h, c, size)
            key = lexer.mix(grams ^ np.uint64(reading * 8 + size)) >> np.uint64(64 - bits)
            own = np.repeat(np.arange(n), have).astype(np.uint64)
            code, times = np.unique(own << np.uint64(bits) | key, return_counts=True)
            doc = (code >> np.uint64(bits)).astype(np.int64)
            docs.append(doc)
            keys.append((code & np.uint64((1 << bits) - 1)).astype(np.int64))
            values.append(np.sqrt(times / have[doc]))
    doc, key, value = np.concatenate(docs), np.concatenate(keys), np.concatenate(values)
    order = np.argsort(doc, kind="stable")
    return doc[order], key[order], value[order]


def learn(examples: list[tuple[np.ndarray, np.ndarray, int]], how: Ftrl) -> np.ndarray:
    """Weights, the intercept last, from (features, values, label) in this order, ``epochs`` times."""
    size = (1 << how.bits) + 1
    z, n, weights = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(how.epochs):
        for key, value, label in examples:
            key, value = np.append(key, size - 1), np.append(value, 1.0)
            # A feature may stand twice, where n-grams of two readings share a hash.
            zk, nk = z[key], n[key]
            w = np.where(np.abs(zk) <= how.l1, 0.0, (np.sign(zk) * how.l1 - zk) / ((how.beta + np.sqrt(nk)) / how.alpha + how.l2))
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(nk + g * g) - np.sqrt(nk)) / how.alpha
            np.add.at(z, key, g - sigma * w)
            np.add.at(n, key, g * g)
    live = np.abs(z) > how.l1
    weights[live] = (np.sign(z[live]) * how.l1 - z[live]) / ((how.beta + np.sqrt(n[live])) / how.alpha + how.l2)
    return weights


def train(docs: DataFrame, labels: DataFrame, usable: Column, how: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learned from the rows of ``labels`` that are ``usable`` and labelled 0 or 1.

    The sample is drawn by hash, first of the ids and then, as ids and labels may repeat, of the rows that they
    find, so it is bounded by ``per_class`` whatever the input. Repeated labels and documents count as they come.
    """
    wanted = labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    wanted = wanted.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col)).alias("h"))
    sizes = wanted.groupBy("label").agg(F.count("*").alias("size"))  # two rows
    wanted = least_hashed(wanted, "label", "h", how.per_class, sizes).select("id", "label", "h")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.join(F.broadcast(wanted), "id").select("h", "id", "label", "text", F.xxhash64("id", "text").alias("row_h"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("row_h"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= how.per_class).drop("rank", "row_h")
    rows = rows.repartition(1).sortWithinPartitions("h", "id", "label", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            doc, key, value = features(data, offsets, how.bits)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for i, label in enumerate(batch.column(2).to_pylist()):
                examples.append((key[cut[i] : cut[i + 1]], value[cut[i] : cut[i + 1]], label))
        weights = learn(_interleaved(examples), how)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], names=["feature", "weight"])

    out = np.zeros((1 << how.bits) + 1)
    ship(docs.sparkSession)
    got = rows.mapInArrow(fit, "feature long, weight double").toPandas()
    out[got["feature"].to_numpy(np.int64)] = got["weight"].to_numpy()
    return out


def _interleaved(examples: list) -> list:
    """The classes in turn, the smaller one again from its start, so that each gives half the updates."""
    sides = [[e for e in examples if e[2] == label] for label in (0, 1)]
    if not all(sides):
        return examples
    n = max(map(len, sides))
    return [side[i % len(side)] for i in range(n) for side in sides]


def score(docs: DataFrame, weights: np.ndarray, how: Ftrl = Ftrl(), columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``columns`` with score and predicted of every whole text. An empty or null text has the intercept's score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights = shared.value
        data, offsets = utf8(batch.column(batch.num_columns - 1))
        total = np.full(batch.num_rows, float(weights[-1]))
        a = 0
        while a < batch.num_rows:  # about a megabyte at once, or one text
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20), "right")) - 1)
            doc, key, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], how.bits)
            total[a:b] += np.bincount(doc, weights[key] * value, b - a)
            a = b
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        arrays = [*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, names=[*columns, "score", "predicted"])

    schema = StructType([*(docs.schema[c] for c in columns), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return map_arrow(docs.select(*columns, text_or_empty(text_col).alias("scored_text")), each, schema)


def keep(docs: DataFrame, weights: np.ndarray, how: Ftrl = Ftrl()) -> DataFrame:
    """The rows and columns of ``docs`` that are predicted to be good."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_or_empty("text").alias("text"))
    return score(rows, weights, how, ("row",)).where("predicted = 1").select("row.*")


def held_out() -> Column:
    """Documents never learned from; a null id is not held out, and has no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    weights = train(docs, labels, ~held_out())
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", "predicted")
