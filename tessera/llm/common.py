"""What the operators of this subpackage share: tables, scratch storage, Arrow plumbing, row keys.

Conventions that hold for every operator here unless its docstring says otherwise:

* only the named columns of the input are read, so further columns, also ones with the names of
  outputs, neither clash nor matter;
* a null text is an empty text;
* rows are documents: repeated rows and repeated ids stay separate rows of the result;
* a null id is kept as null in the result and sorts before every other id;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.runtime import shared_dir, ship

#: Rows in an Arrow batch handed to Python. Some texts have a megabyte, so few rows bound memory.
ROWS_PER_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, which may be any path that Spark can read."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Lower the session's Arrow batch size to ``rows``, never raise it, and send the package along."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


#: Spark deletes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage in storage that outlives every executor: a lost executor costs the
    tasks it ran, never the table. What was shuffled for it is deleted with the write.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out._scratch = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete those made by materialise() of these tables, which no later plan reads."""
    for df in tables:
        at = df.__dict__.get("_scratch")
        if at is None:
            continue
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The id that stands for a null id in joins and comparisons.
NULL_ID = -(2**63)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, kid, kh, text): kid is the id without nulls, kh the text's hash.

    (kid, kh) names a document up to rows that are equal in both, for which every operator here
    gives equal results.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("kid"),
        F.xxhash64(text).alias("kh"),
        text.alias("text"),
    )


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def least_hashed(rows: DataFrame, group: str, hash_col: str, most: int, sizes: DataFrame) -> DataFrame:
    """The ``most`` rows of each group with the least hashes, for groups of the given (group, size).

    Rows whose hash is beyond what half as many rows again would reach are dropped where they are read, so
    the ranking gets a bounded number of rows a group however many tasks read them.
    """
    reach = F.lit(float(-(2**63))) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(1.5 * most + 100) / F.col("size"))
    near = rows.join(F.broadcast(sizes), group).where(F.col(hash_col).cast("double") <= reach).drop("size")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(hash_col))
    return near.withColumn("least_rank", rank).where(F.col("least_rank") <= most).drop("least_rank")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to each record batch of ``df``. The package goes to the executors first."""
    ship(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(each, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width, kind = 8, np.int64
    else:
        width, kind = 4, np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, n + 1, column.offset * width).astype(np.int64)
    size = int(at[-1] - at[0])
    whole = np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.empty(0, np.uint8)
    return whole, at - at[0]


def groups(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of values that hold ``most`` symbols together at most, or one value."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the concatenated values and each list's length."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def blobs(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
