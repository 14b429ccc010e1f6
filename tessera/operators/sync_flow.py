"""Full and incremental synchronisation of a table, end to end.

The changed rows are read once, up to a mark taken when the run begins, and feed documents, file
differences and counters alike. The checkpoint is written last: a run that dies is run again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ingestion as ing
from tessera.operators import synchronisation as sync
from tessera.sources.sinks import SnapshotStore
from tessera.sources.tables import incremental


def _references(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("record_id"), F.explode("file_references").alias("f")).select("record_id", "f.s3_key", "f.url")


def sync_table(table: str, rows: DataFrame, store: SnapshotStore, since: datetime | None, until: datetime, column: str | None, relationships: dict[str, str], kinds: dict[str, str], now: int, deletes: bool = True, key: str = "id") -> dict[str, DataFrame | int]:
    """One run for one table; ``since`` None or a table without a time column reads it whole.

    Returns the counts, the file differences of changed records, and the checkpoint row to append.
    """
    spark = rows.sparkSession
    changed = incremental(rows, column if since is not None else None, since, until)
    documents, rejects = ing.to_documents(changed, table, relationships, kinds, now, key)
    before = store.read()
    old = _references(before.join(documents.select("doc_id"), "doc_id", "left_semi")) if before is not None else spark.createDataFrame([], "record_id string, s3_key string, url string")
    files = sync.reference_diff(old, _references(documents))
    gone, n_deleted = None, 0
    if deletes and before is not None:
        mine = before.where(F.col("source_table") == table)
        gone = sync.deleted(mine.select(F.col("source_id").alias("id")), rows.select(F.col(key).alias("id")), "id")
        gone = gone.select(F.concat(F.lit(f"{table}:"), "id").alias("doc_id"))
        n_deleted = gone.count()
    counts = documents.select(F.lit(True).alias("ok")).unionByName(rejects.select(F.lit(False).alias("ok")))
    processed, failed = counts.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
    store.change(documents, gone if n_deleted else None)
    status = "COMPLETED" if failed == 0 else "COMPLETED_WITH_ERRORS"
    checkpoint = spark.createDataFrame([(table, until, None, processed, failed, status, None, until)], sync.CHECKPOINT)
    return {"processed": processed, "failed": failed, "deleted": n_deleted, "files": files, "checkpoint": checkpoint}
