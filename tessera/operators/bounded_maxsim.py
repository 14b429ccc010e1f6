"""Exact MaxSim top-k that reads few float vectors: bounds from a sidecar of small codes, floats for what the bounds leave open.

The sidecar has of each patch its vector in one signed byte a dimension, the scale, and the norm of what the rounding left out. By
Cauchy and Schwarz a product with a query token is within the token's norm times that rest of the product with the code, so the
codes give every page a lower and an upper bound of its score. The k-th greatest lower bound is reached by k pages; a page whose upper
bound is below it isn't among the first k, and its floats aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Settings
from tessera.operators import retrieval

CODES = "page long, patch long, code binary, scale double, rest double"


def encode(patches: DataFrame) -> DataFrame:
    """(page, patch, code, scale, rest) of (page, patch, vec). A vector of zeros has scale 0; a null one is left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            scale = np.abs(v).max(1, initial=0) / 127
            code = np.rint(v / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            rest = np.linalg.norm(v - code * scale[:, None], axis=1)
            raw = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw, pa.array(scale), pa.array(rest)], names=["page", "patch", "code", "scale", "rest"])

    rows = patches.where("vec IS NOT NULL").select(F.col("page").cast("long"), F.col("patch").cast("long"), "vec")
    return rows.mapInArrow(each, CODES)


def bounds(codes: DataFrame, query: np.ndarray) -> DataFrame:
    """(page, low, high) of each page's score for the query's tokens (tokens x dims).

    A task adds up the greatest of each of its batches' pages, so the shuffle has a row a page and batch; maxima are merged token by token.
    """
    norms = np.linalg.norm(query, axis=1)
    shared = codes.sparkSession.sparkContext.broadcast((query, norms))  # the caller bounds the tokens
    n = len(query)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, norm = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1)
            near = (code.astype(np.float64) @ q.T) * batch.column(2).to_numpy(zero_copy_only=False)[:, None]
            # Sums are rounded; a billionth of what they are made of covers that.
            slack = batch.column(3).to_numpy(zero_copy_only=False)[:, None] * norm * (1 + 1e-9) + 1e-9 * (1 + np.abs(near))
            page, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            low, high = np.full((len(page), n), -np.inf), np.full((len(page), n), -np.inf)
            np.maximum.at(low, at, near - slack)
            np.maximum.at(high, at, near + slack)
            listed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), n).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(page), listed(low), listed(high)], names=["page", "low", "high"])

    part = codes.select("page", "code", "scale", "rest").mapInArrow(each, "page long, low array<double>, high array<double>")
    most = [F.max(F.get(side, F.lit(t))).alias(f"{side}_{t}") for side in ("low", "high") for t in range(n)]
    merged = part.groupBy("page").agg(*most)
    total = lambda side: sum((F.col(f"{side}_{t}") for t in range(n)), F.lit(0.0))
    return merged.select("page", total("low").alias("low"), total("high").alias("high"))


@dataclass
class Best:
    """The first pages, and how many had their floats read of how many there are."""

    rows: DataFrame
    read: int
    pages: int


class BoundedMaxSim:
    """The sidecar of a table of patches under ``path``."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = DEFAULT) -> None:
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    def build(self, patches: DataFrame) -> BoundedMaxSim:
        encode(patches).write.mode("overwrite").parquet(f"{self.path}/codes")
        return self

    def top(self, patches: DataFrame, tokens: DataFrame, k: int) -> Best:
        """The k best pages (page, score) for tokens (tok, q_vec), equal scores by page, as retrieval.maxsim() ranks them."""
        asked = tokens.orderBy("tok").limit(self.settings.max_query_tokens + 1).collect()
        if len(asked) > self.settings.max_query_tokens:
            raise ValueError(f"A query of more than {self.settings.max_query_tokens} tokens")
        if not asked:
            return Best(self.spark.createDataFrame([], "page long, score double"), 0, 0)
        query = np.array([r["q_vec"] for r in asked], float)
        held = bounds(self.spark.read.schema(CODES).parquet(f"{self.path}/codes"), query)
        known = held.orderBy(F.desc("low")).limit(k).collect()
        floor = known[-1]["low"] if len(known) == k else float("-inf")
        open_pages = held.where(F.col("high") >= floor).select("page")
        read, pages = held.agg(F.count_if(F.col("high") >= floor), F.count("*")).first()
        kept = patches.join(open_pages, "page", "left_semi")
        scores = retrieval.maxsim(kept, tokens, retrieval.float_similarity())
        return Best(retrieval.top(scores, k), read, pages)
