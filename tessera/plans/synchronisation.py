"""Queries of synchronisation, sinks and streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import synchronisation as sync
from tessera.runtime import shared_dir
from tessera.sources import sinks
from tessera.sources.tables import catalog, incremental, read
from tessera.streaming import presence, sync_stream

SINCE = "TIMESTAMP_NTZ '2024-01-20 00:00:00'"
DAY_MS = 86_400_000


def _dir(spark: SparkSession) -> str:
    """A new folder for a query's store."""
    return f"{shared_dir(spark)}/tessera-sync-{uuid.uuid4().hex}"


def i8_change_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events made at their time and changed up to 19 days later."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), F.expr("ts + make_dt_interval(CAST(event_id % 20 AS INT))").alias("updated_at"))
    return sync.classify_changes(e, "event_id", "created_at", "updated_at", F.expr(SINCE))


def a23_change_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i8_change_classify(spark, sf_dir).groupBy("change_type").agg(F.count("*").alias("n"))


def j7_route_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"))
    return sync.route(i8_change_classify(spark, sf_dir), ids, "update")


def j5_delete_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return sync.deleted(o, o.where("o_orderkey % 13 <> 0"), "o_orderkey")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of checkpoints, a table for each user."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")
    return e.select(F.concat(F.lit("t"), "user_id").alias("table_name"), F.col("ts").alias("last_sync_timestamp"), F.col("event_id").alias("records_processed"), (F.col("event_id") % 3).alias("records_failed"), status.alias("sync_status"), F.col("ts").alias("updated_at"))


def w7_latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.latest_checkpoints(_log(spark, sf_dir)).select("table_name", "records_processed", "sync_status")


def _tables(spark: SparkSession) -> DataFrame:
    return spark.range(160).select(F.concat(F.lit("t"), "id").alias("table_name"))


def j19_unsynced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.unsynced(_tables(spark), sync.latest_checkpoints(_log(spark, sf_dir)))


def j19_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.synced(_tables(spark), sync.latest_checkpoints(_log(spark, sf_dir)))


def t8_next_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j19_unsynced(spark, sf_dir).orderBy("table_name").limit(3)


def a5_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.status_report(sync.latest_checkpoints(_log(spark, sf_dir)))


def a4_job_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    return sync.job_counters(l.select(F.col("l_linestatus").alias("table_name"), (F.col("l_returnflag") != "R").alias("success")))


def _refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("k"))
    key, url = F.concat(F.lit("k/"), "k"), F.concat(F.lit("u/"), "k")
    old = o.where("k % 3 <> 0").select("record_id", F.when(F.col("k") % 2 == 0, key).otherwise(F.lit("")).alias("s3_key"), F.when(F.col("k") % 7 == 0, F.lit("")).otherwise(url).alias("url"), F.col("k").alias("file_no"))
    new = o.where("k % 4 <> 0").select("record_id", F.when(F.col("k") % 2 == 0, key).alias("s3_key"), url.alias("url"), F.col("k").alias("file_no"))
    return old, new


def j6_ref_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.reference_diff(*_refs(spark, sf_dir))


def j8_match_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _refs(spark, sf_dir)
    return sync.match_downloads(new.drop("record_id", "file_no"), old).select("key", "record_id")


def j9_old_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = _refs(spark, sf_dir)[0].groupBy("record_id").agg(F.count("*").alias("n_refs"))
    return sync.with_old_references(i8_change_classify(spark, sf_dir), snapshot).select("record_id", F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def j10_orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _refs(spark, sf_dir)
    removed = sync.reference_diff(old, new).where("change = 'removed'").select("record_id", "key")
    pages = old.select("record_id", sync.reference_key().alias("key"), F.explode(F.expr("array(1L, 2L)")).alias("page")).where("key is not null")
    return sync.orphan_pages(pages, removed)[1]


def k1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = c.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), F.upper("c_name").alias("c_name"), F.lit("NEW").alias("c_mktsegment"))
    return sync.upsert(c, rows, "c_custkey")


def k2_partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("X")).alias("c_mktsegment")).where("c_custkey % 3 = 0")
    return sync.update_fields(c, rows, "c_custkey", ["c_mktsegment"])


def k3_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return sync.delete(c, c.where("c_custkey % 4 = 1"), "c_custkey")


def k4_feed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("documents:"), "doc_id").alias("doc_id"), "n_chars")
    return sinks.feed_results(d, "n_chars < 5000")


def k8_schema_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame(catalog({t: read(spark, sf_dir, t) for t in ("nation", "region")})[1], "table_name string, column_name string, data_type string, nullable boolean, position int")
    back = F.from_json("json", "table_name string, columns array<struct<position:int,column_name:string,data_type:string>>")
    return sinks.schema_json(c).select("table_name", F.array_join(F.transform(back["columns"], lambda x: x["column_name"]), ",").alias("columns"))


def u2_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("b"))
    said = lambda c: F.array_join(F.array_sort(c), ",")
    return e.select("user_id", said(F.array_except("a", "b")).alias("added"), said(F.array_intersect("a", "b")).alias("kept"))


def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events upserted by user in micro-batches; what the store has when all have arrived."""
    at, path = _dir(spark), f"{sf_dir}/events.parque[t]"  # a pattern, as the table may be one file
    schema = read(spark, sf_dir, "events").schema
    store = sinks.SnapshotStore(spark, f"{at}/store", "user_id")
    sync_stream.sync_available(spark, path, schema, store, f"{at}/checkpoint", "user_id", ("ts", "event_id"))
    return store.read().select("user_id", "event_id", "event_type")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed count of the stream, run over the table at rest."""
    out = sync_stream.windowed_counts(read(spark, sf_dir, "events"), width="1 day")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def j5_stream_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that come and, after a day without an event, go, as keyed state over three runs of a stream: each run takes up
    the state that the one before has left in the checkpoint."""
    at = _dir(spark)
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    day = F.dayofmonth("ts")
    settings = {k: spark.conf.get(k, None) for k in presence.state_store()}
    for k, v in presence.state_store().items():
        spark.conf.set(k, v)
    try:
        for k in range(3):  # no row is later than the watermark's delay behind those of the runs before
            e.where((day > 10 * k) & (day <= 10 * k + 10 if k < 2 else day > 20)).write.parquet(f"{at}/in/run-{k}")
            stream = sync_stream.arriving(spark, f"{at}/in/*", e.schema, 1_000_000)
            sync_stream.run_available(presence.presence(stream, DAY_MS), f"{at}/out", f"{at}/checkpoint")
    finally:
        for k, v in settings.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(presence.CHANGES).parquet(f"{at}/out")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed count as a stream of three files: the third holds the older half of the events, which comes after the
    watermark has passed it and is dropped. A batch drops by the mark with which the one before it began, so two go
    before. Windows that the watermark has closed are told."""
    at = _dir(spark)
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    late = F.col("ts") < F.expr("TIMESTAMP '2024-01-15 00:00:00'")
    e.where(~late & (F.col("event_id") % 2 == 0)).coalesce(1).write.parquet(f"{at}/in/a")
    e.where(~late & (F.col("event_id") % 2 == 1)).coalesce(1).write.parquet(f"{at}/in/b")
    e.where(late).coalesce(1).write.parquet(f"{at}/in/c")
    counted = sync_stream.windowed_counts(sync_stream.arriving(spark, f"{at}/in/*", e.schema, 1), late="1 day", width="1 day")
    flat = counted.select("window.start", "event_type", "n")
    sync_stream.run_available(flat, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(flat.schema).parquet(f"{at}/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def s6_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes since a mark and of the hour before it, in case some came late."""
    e = read(spark, sf_dir, "events")
    return incremental(e, "ts", F.expr(SINCE), overlap_s=3600).select("event_id")


_STATUS = "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END"
_LATEST = f"k AS (SELECT 't' || user_id AS table_name, event_id AS records_processed, event_id % 3 AS records_failed, {_STATUS} AS sync_status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"
_CHANGES = "c AS (SELECT event_id AS record_id, CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'insert' ELSE 'update' END AS change_type FROM events WHERE ts + to_days(CAST(event_id % 20 AS INT)) > TIMESTAMP '2024-01-20')"
_REFS = "o AS (SELECT o_custkey AS record_id, o_orderkey AS k FROM orders), old AS (SELECT record_id, k, CASE WHEN k % 2 = 0 THEN 'k/' || k WHEN k % 7 <> 0 THEN 'u/' || k END AS key FROM o WHERE k % 3 <> 0), new AS (SELECT record_id, k, CASE WHEN k % 2 = 0 THEN 'k/' || k ELSE 'u/' || k END AS key FROM o WHERE k % 4 <> 0)"
_DIFF = "diff AS (SELECT coalesce(a.record_id, b.record_id) AS record_id, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT record_id, key FROM old WHERE key IS NOT NULL) a FULL JOIN (SELECT DISTINCT record_id, key FROM new) b ON a.record_id = b.record_id AND a.key = b.key)"
_ALL = "SELECT 't' || range AS table_name FROM range(160)"

ORACLES = {
    "i8_change_classify": f"WITH {_CHANGES} SELECT * FROM c",
    "a23_change_totals": f"WITH {_CHANGES} SELECT change_type, count(*) AS n FROM c GROUP BY change_type",
    "j7_route_changes": f"WITH {_CHANGES} SELECT record_id FROM c WHERE change_type = 'update'",
    "j5_delete_detect": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders WHERE o_orderkey % 13 = 0",
    "w7_latest_checkpoint": f"WITH {_LATEST} SELECT table_name, records_processed, sync_status FROM k",
    "j19_unsynced": f"WITH {_LATEST} {_ALL} EXCEPT SELECT table_name FROM k WHERE sync_status = 'COMPLETED'",
    "j19_synced": f"WITH {_LATEST} {_ALL} INTERSECT SELECT table_name FROM k WHERE sync_status = 'COMPLETED'",
    "t8_next_tables": f"WITH {_LATEST} SELECT table_name FROM ({_ALL} EXCEPT SELECT table_name FROM k WHERE sync_status = 'COMPLETED') ORDER BY table_name LIMIT 3",
    "a5_status_totals": f"WITH {_LATEST} SELECT count(*) AS tables, CAST(sum(records_processed) AS BIGINT) AS processed, CAST(sum(records_failed) AS BIGINT) AS failed, count(*) FILTER (sync_status = 'COMPLETED') AS completed FROM k",
    "a4_job_rollup": "SELECT l_linestatus AS table_name, count(*) FILTER (l_returnflag <> 'R') AS processed, count(*) FILTER (l_returnflag = 'R') AS failed, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status FROM lineitem GROUP BY ROLLUP (l_linestatus)",
    "j6_ref_diff": f"WITH {_REFS}, {_DIFF} SELECT * FROM diff",
    "j8_match_downloads": f"WITH {_REFS} SELECT new.key, old.record_id FROM new JOIN old ON new.key = old.key",
    "j9_old_references": f"WITH {_CHANGES}, {_REFS} SELECT c.record_id, count(old.k) AS n_refs FROM c LEFT JOIN old ON c.record_id = old.record_id WHERE change_type = 'update' GROUP BY c.record_id",
    "j10_orphan_pages": f"WITH {_REFS}, {_DIFF} SELECT old.record_id, old.key, p AS page FROM old JOIN diff ON old.record_id = diff.record_id AND old.key = diff.key AND change = 'removed', (VALUES (CAST(1 AS BIGINT)), (2)) AS t(p)",
    "k1_upsert": "WITH r AS (SELECT c_custkey + 100 AS c_custkey, upper(c_name) AS c_name, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 5 = 0) SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM r) UNION ALL SELECT * FROM r",
    "k2_partial_update": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "k3_delete": "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 1",
    "k4_feed_results": "SELECT 'documents:' || doc_id AS doc_id, n_chars < 5000 AS success, CASE WHEN n_chars >= 5000 THEN 'rejected' END AS error FROM documents",
    "k8_schema_json": "SELECT * FROM (VALUES ('nation', 'n_nationkey,n_name,n_regionkey'), ('region', 'r_regionkey,r_name')) AS t(table_name, columns)",
    "u2_key_sets": "WITH s AS (SELECT user_id, list_distinct(list(event_type) FILTER (event_id % 2 = 0)) AS a, list_distinct(list(event_type) FILTER (event_id % 3 = 0)) AS b FROM events GROUP BY user_id) SELECT user_id, coalesce(array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))), ','), '') AS added, coalesce(array_to_string(list_sort(list_filter(a, lambda x: list_contains(coalesce(b, []), x))), ','), '') AS kept FROM s",
    "stream_sync": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "j5_stream_presence": f"""WITH m AS (SELECT max(epoch_us(ts) // 1000) - 3600000 AS mark FROM events), e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS ms FROM events, m WHERE epoch_us(ts) // 1000 <= mark),
g AS (SELECT key, ms, lag(ms) OVER w AS before, lead(ms) OVER w AS after FROM e WINDOW w AS (PARTITION BY key ORDER BY ms))
SELECT key, 'insert' AS change, ms AS at_ms FROM g WHERE before IS NULL OR ms > before + {DAY_MS}
UNION ALL SELECT key, 'delete', ms + {DAY_MS} FROM g, m WHERE coalesce(after > ms + {DAY_MS}, ms + {DAY_MS} <= mark)""",
    "stream_late": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND date_trunc('day', ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY ALL",
    "s6_overlap": "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-19 23:00:00'",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in ORACLES}
