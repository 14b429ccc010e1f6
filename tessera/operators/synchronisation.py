"""Incremental synchronisation of a source table with a document store.

State is data: checkpoints are an append-only log of which the latest row of a table counts, snapshots are
versions, and a checkpoint is written after its snapshot, so a run that dies is run again to
the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKPOINT = "table_name string, last_sync_timestamp timestamp_ntz, last_record_id string, records_processed bigint, records_failed bigint, sync_status string, error_message string, updated_at timestamp_ntz"


def classify_changes(rows: DataFrame, key: str, created: str, updated: str, since: Column, until: Column | None = None) -> DataFrame:
    """(record_id, change_type): rows changed after ``since``, new if they were made after it. Without a time
    of making a change is an update."""
    changed = rows.where(F.col(updated) > since)
    if until is not None:
        changed = changed.where(F.col(updated) <= until)
    kind = F.when(F.coalesce(F.col(created) > since, F.lit(False)), F.lit("insert")).otherwise(F.lit("update"))
    return changed.select(F.col(key).alias("record_id"), kind.alias("change_type"))


def route(changes: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """The ids among the changes of this kind."""
    return ids.join(changes.where(F.col("change_type") == kind), "record_id", "left_semi")


def deleted(known: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Ids that the store has and the source no longer has, as strings."""
    left, right = (d.select(F.col(key).cast("string").alias(key)) for d in (known, current))
    return left.join(right, key, "left_anti").distinct()


def reference_key() -> Column:
    """What names a file: its storage key, else its URL; empty is missing."""
    return F.coalesce(F.nullif(F.col("s3_key"), F.lit("")), F.nullif(F.col("url"), F.lit("")))


def reference_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(record_id, key, change): each file of a record as added, removed or unchanged. Rows without a key are dropped."""
    sides = [d.select("record_id", reference_key().alias("key")).where("key is not null").distinct().withColumn(side, F.lit(True)) for d, side in ((old, "o"), (new, "n"))]
    both = sides[0].join(sides[1], ["record_id", "key"], "full_outer")
    return both.select("record_id", "key", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("unchanged").alias("change"))


def with_old_references(changes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Updates with their references as they were before the run."""
    return changes.where("change_type = 'update'").join(snapshot, "record_id", "left")


def match_downloads(results: DataFrame, files: DataFrame) -> DataFrame:
    """Download results by the same key as their files; of a file named twice the last row counts."""
    r = results.withColumn("key", reference_key())
    f = files.withColumn("key", reference_key()).groupBy("key").agg(F.max_by("record_id", "file_no").alias("record_id"))
    return r.join(f, "key")


def orphan_pages(pages: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, orphaned) pages: orphans are those of a removed file of the same record."""
    on = ["record_id", "key"]
    return pages.join(removed, on, "left_anti"), pages.join(removed, on, "left_semi")


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The target with these rows in the place of those with their keys."""
    return target.join(rows.select(key), key, "left_anti").unionByName(rows)


def update_fields(target: DataFrame, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The target with these fields replaced where rows have them; a null leaves the old value."""
    new = rows.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    out = target.join(new, key, "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in target.columns])


def delete(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def latest_checkpoints(log: DataFrame) -> DataFrame:
    """Of each table the row written last. Partial maxima leave a row a table and task for the shuffle."""
    rest = [c for c in log.columns if c != "table_name"]
    best = log.groupBy("table_name").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "records_processed")).alias("c"))
    return best.select("table_name", "c.*")


def last_sync(checkpoints: DataFrame) -> DataFrame:
    """(table_name, last_sync_timestamp) of the tables that were completed; others count as never synced."""
    return checkpoints.where("sync_status = 'COMPLETED'").select("table_name", "last_sync_timestamp")


def unsynced(tables: DataFrame, checkpoints: DataFrame) -> DataFrame:
    return tables.join(last_sync(checkpoints), "table_name", "left_anti")


def synced(tables: DataFrame, checkpoints: DataFrame) -> DataFrame:
    return tables.join(last_sync(checkpoints), "table_name", "left_semi")


def job_counters(results: DataFrame) -> DataFrame:
    """(table_name, processed, failed, status) of each table and, with a null name, of all."""
    out = results.rollup("table_name").agg(F.count_if(F.col("success")).alias("processed"), F.count_if(~F.col("success")).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED"))


def status_report(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.agg(F.count("*").alias("tables"), F.sum("records_processed").alias("processed"), F.sum("records_failed").alias("failed"), F.count_if(F.col("sync_status") == "COMPLETED").alias("completed"))


@dataclass(frozen=True)
class Plan:
    """What a cycle does: ``full`` tables are read whole, ``changed`` ones since their mark; ``deletes``: whether
    deletions are looked for."""

    full: tuple[str, ...]
    changed: tuple[str, ...]
    deletes: bool


def schedule(tables: list[str], done: set[str], cycle: int, per_cycle: int, delete_every: int) -> Plan:
    """Tables never synced first, so many a cycle; once all are, changes. Deletions each so many cycles, 0: always."""
    waiting = [t for t in tables if t not in done]
    deletes = delete_every == 0 or cycle % delete_every == 0
    if waiting:
        return Plan(tuple(waiting[:per_cycle]), (), deletes)
    return Plan((), tuple(tables), deletes)


def run_cycle(plan: Plan, full: Callable[[str], None], changed: Callable[[str, bool], None]) -> dict[str, str]:
    """Run a plan table by table; a table that fails doesn't stop the others, and counts as failed."""
    out = {}
    for t in (*plan.full, *plan.changed):
        try:
            full(t) if t in plan.full else changed(t, plan.deletes)
            out[t] = "COMPLETED"
        except Exception as e:  # reported, and run again in the next cycle
            out[t] = f"FAILED: {e}"
    return out
