"""Synchronisation as a stream: micro-batches of changes, upserted by key, with the mark in the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.sinks import SnapshotStore


def latest_by_key(batch: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Of each key the last row, by partial maxima."""
    best = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("row"))
    return best.select("row.*")


def sync_available(spark: SparkSession, path: str, schema, store: SnapshotStore, checkpoint: str, key: str, order: tuple[str, ...], files_per_batch: int = 64) -> None:
    """Read what has arrived under ``path`` since the last call and upsert it; returns when all is in.

    A batch that is run again after a failure writes the same rows: the store replaces by key. A row older than the
    one stored doesn't replace it.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows, now = latest_by_key(batch, key, order), store.read()
        if now is not None:
            rows = latest_by_key(rows.unionByName(now.join(rows.select(key), key, "left_semi")), key, order)
        store.upsert(rows)

    stream = arriving(spark, path, schema, files_per_batch)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; rows later than ``late`` behind the latest are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def arriving(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """The files under ``path`` as a stream, the oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what the stream tells of all that has arrived; a run after a failure goes on where the last one ended."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
