"""Queries of single scans, sinks and predicates, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions import strings
from tessera.operators import etl, ranks, serving
from tessera.operators import ingestion as ing
from tessera.operators import synchronisation as sync
from tessera.plans.ingestion import SOURCES, _catalog, _frames
from tessera.runtime import shared_dir, ship
from tessera.sources import sinks
from tessera.sources import tables as src


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def s2_query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query in SQL over a named table."""
    return spark.sql("SELECT n_nationkey, n_name FROM {n} WHERE n_regionkey = {r}", n=src.read(spark, sf_dir, "nation"), r=2)


def s3_batch_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in batches of 1,000 by key: the first and last key and the rows of each."""
    o = ranks.numbered(src.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    batch = F.expr("(place - 1) div 1000").alias("batch")
    return o.groupBy(batch).agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count("*").alias("n"))


def s5_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def s9_catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ing.discover(spark, _frames(spark, sf_dir))["tables"]


def s11_database_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(src.database_name(spark)).alias("name"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Nations as small files of two types in a folder that all machines share."""
    at = _folder(spark, "files")
    n = src.read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("value")).repartition(4).write.text(f"{at}/even")
    n.where("n_nationkey % 2 = 1").select(F.col("n_name").alias("value")).repartition(4).write.json(f"{at}/odd")
    return at


def s17_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of one type in a folder: what they hold, together."""
    f = etl.files(spark, f"{_written(spark, sf_dir)}/even", "*.txt")
    return f.select(F.explode(F.split(F.rtrim(F.col("content").cast("string")), "\\s*\n")).alias("n_name")).where("n_name <> ''")


def _pages_of(content: bytes) -> list[tuple[bytes, str]]:
    if not content:
        raise ValueError("empty file")
    return [(part, part.decode("utf-8", "replace")) for part in content.split(b" ")]


def s16_file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to pages: a row a page; a file that can't be read is one row with its error."""
    ship(spark)
    p = src.read(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit(".pdf")).alias("filename"), F.when(F.col("p_partkey") % 10 == 0, F.lit("")).otherwise(F.col("p_name")).cast("binary").alias("content"))
    return etl.pages(p, _pages_of).select("filename", "page_number", "text", "error")


def _one_page(content: bytes) -> list[tuple[bytes, str]]:
    return [(content, "")]


def s18_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image is a file of one page without text."""
    ship(spark)
    p = src.read(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit(".png")).alias("filename"), F.col("p_name").cast("binary").alias("content"))
    return etl.pages(p, _one_page).select("filename", "page_number", F.length("image").cast("long").alias("bytes"), "text")


def _stored(key: str) -> bytes:
    if key.endswith("3"):
        raise KeyError("no such key")
    return key.encode() * 3


def s20_store_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads from an object store: a missing key is a failed row."""
    ship(spark)
    c = src.read(spark, sf_dir, "customer").select(F.concat(F.lit("k/"), "c_custkey").alias("key"), F.lit("png").alias("extension"))
    return serving.download(c, _stored).select("key", "status", "size")


def s22_bounded_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch by four workers at once: whatever order they end in, all rows come, and from four tasks at most."""
    ship(spark)
    s = src.read(spark, sf_dir, "supplier").select(F.concat(F.lit("k/"), "s_suppkey").alias("key"), F.lit("pdf").alias("extension"))
    done = serving.download(s, _stored, workers=4).withColumn("worker", F.spark_partition_id())
    return done.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "downloaded").alias("ok"), (F.countDistinct("worker") <= 4).alias("bounded"))


def s23_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ("max_query_tokens", "target_hits_per_token", "rerank_count", "max_regions", "max_download_mb")
    return spark.createDataFrame([(k, getattr(DEFAULT, k)) for k in kept], "name string, value long")


def s24_id_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id")).distinct()


def s25_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's models with the length of what each makes of a text; an unknown one is an error."""
    models = serving.Models({f"hash{n}": (n, lambda n=n: etl.hashed_model(n, 2)) for n in (8, 16)})
    rows = [(name, dims, int(models.make(name)(["x"]).shape[-1])) for name, (dims, _) in sorted(models.known.items())]
    return spark.createDataFrame(rows, "model string, dims long, made long")


def s28_get_or_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by id: those at hand, the others fetched."""
    ship(spark)
    p = src.read(spark, sf_dir, "part").select(F.concat(F.lit("k/"), "p_partkey").alias("key"), F.lit("png").alias("extension"))
    held = p.where("key LIKE '%1'").select("key", F.length("key").cast("long").alias("at_hand"))
    missing = serving.download(p.join(held, "key", "left_anti"), _stored).select("key", "size")
    out = p.join(held, "key", "left").join(missing, "key", "left")
    return out.select("key", F.coalesce("at_hand", "size").alias("size"), F.col("at_hand").isNotNull().alias("cached"))


def k5_parallel_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten tasks write at once; what is read back is what was fed."""
    at = _folder(spark, "feed")
    src.read(spark, sf_dir, "documents").select("doc_id", "source").repartition(10).write.parquet(at)
    return spark.read.parquet(at)


def k6_state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States appended twice for half of the tables: the later one counts."""
    at = _folder(spark, "state")
    c = src.read(spark, sf_dir, "customer")
    row = lambda n, t, status: c.select(F.concat(F.lit("t"), "c_custkey").alias("table_name"), F.expr(f"TIMESTAMP_NTZ '{t}'").alias("last_sync_timestamp"), F.lit(None).cast("string").alias("last_record_id"), F.lit(n).cast("long").alias("records_processed"), F.lit(0).cast("long").alias("records_failed"), F.lit(status).alias("sync_status"), F.lit(None).cast("string").alias("error_message"), F.expr(f"TIMESTAMP_NTZ '{t}'").alias("updated_at"), F.col("c_custkey"))
    sinks.append_checkpoint(row(1, "2024-01-01", "FAILED").drop("c_custkey"), at)
    sinks.append_checkpoint(row(2, "2024-01-02", "COMPLETED").where("c_custkey % 2 = 0").drop("c_custkey"), at)
    return sync.latest_checkpoints(spark.read.schema(sync.CHECKPOINT).parquet(at)).select("table_name", "records_processed", "sync_status")


def k9_schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings of the schema's report, the largest table first."""
    found = ing.discover(spark, _frames(spark, sf_dir))
    lines = ing.schema_report(found["columns"].withColumn("column_default", F.lit(None).cast("string")), found["counts"]).split("\n")
    heads = [line.removeprefix("## ") for line in lines if line.startswith("## ")]
    return spark.createDataFrame(list(enumerate(heads)), "place long, heading string")


def k10_null_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run leaves nothing behind: the plan runs, the table stays what it is."""
    o = src.read(spark, sf_dir, "orders")
    sinks.null_sink(o.withColumn("o_custkey", F.col("o_custkey") + 1))
    return o.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


def k13_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents posted one by one: codes 200 and 201 are taken, others are errors with the answer's first 200 characters."""
    d = src.read(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, (200, 201, 404, 500))), (F.col("doc_id") % 4 + 1).cast("int")).alias("code"), "text")
    return sinks.posted(d, "code", "text").select("doc_id", "success", F.length("error").cast("long").alias("n_error"))


def k15_checkpoint_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared columns of the checkpoint table, as a table made from them has them."""
    made = spark.createDataFrame([], sync.CHECKPOINT)
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(made.schema.fields)], "place long, name string, type string")


def p2_result_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as answers have them: a title, tags and a snippet are never null."""
    d = src.read(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("source"))
    tags = F.when(F.col("doc_id") % 3 != 0, F.array("lang"))
    return d.select("doc_id", F.coalesce(title, F.lit("Untitled")).alias("title"), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ",").alias("tags"), F.length(F.substring("text", 1, 200)).cast("long").alias("n"))


def p3_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read(spark, sf_dir, "documents").where("lang = 'de' AND source = 'src2'").select("doc_id")


def p5_array_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an array element that matches a pattern."""
    c = src.read(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.collect_list("text").alias("texts"))
    return c.where(F.exists("texts", lambda t: t.rlike("(?i)\\bthe\\b"))).select("conv_id")


def p7_timestamp_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each table of a catalog the column that tells of changes."""
    c = _catalog(spark)[0]
    turn = F.array_position(F.array(*map(F.lit, DEFAULT.timestamp_columns)), F.col("column_name"))
    return c.withColumn("turn", turn).groupBy("table_name").agg(F.min_by("column_name", F.when(F.col("turn") > 0, F.col("turn"))).alias("column_name"))


def p9_min_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import regions

    p = src.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 12).alias("w"), (F.col("p_partkey") % 600).alias("h"))
    return p.where(regions.is_big_enough(F.col("w"), F.col("h"))).select("p_partkey")


def p18_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), "o_orderkey", F.element_at(F.array(*map(F.lit, (".pdf", ".TIF", ".txt", ""))), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("name"))
    return o.where(strings.extension(F.col("name")).isin(*DEFAULT.processable_types)).select("o_orderkey")


def j18_table_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables joined with their columns, relationships and counts."""
    c, t = _catalog(spark)
    rel = ing.infer_relationships(c, t)
    n = c.groupBy("table_name").agg(F.count("*").alias("n_columns"))
    out = rel.groupBy(F.col("source_table").alias("table_name")).agg(F.count("*").alias("n_links"))
    return t.join(n, "table_name", "left").join(out, "table_name", "left").select("table_name", "n_columns", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def a3_catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ing.discover(spark, _frames(spark, sf_dir))
    return found["counts"].agg(F.count("*").alias("tables"), F.sum("row_count").alias("rows"))


def a6_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job with any failed row is completed with errors."""
    o = src.read(spark, sf_dir, "orders")
    jobs = o.groupBy(F.col("o_custkey").alias("job")).agg(F.max(F.col("o_orderstatus") == "F").alias("failed"))
    return jobs.select("job", F.when(F.col("failed"), "COMPLETED_WITH_ERRORS").otherwise("COMPLETED").alias("status"))


def a18_total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read(spark, sf_dir, "documents").agg(F.count_if((F.col("lang") == "en") & F.contains("text", F.lit("the"))).alias("total"))


def a21_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the seconds between first and last event, in all and per kind of event, and events a second."""
    e = src.read(spark, sf_dir, "events")
    s = F.expr("timestampdiff(SECOND, min(ts), max(ts))")
    out = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), s.alias("seconds"))
    return out.withColumn("rate", F.round(F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")).otherwise(F.lit(0.0)), 9))


def u3_known_minus_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = src.read(spark, sf_dir, "customer"), src.read(spark, sf_dir, "orders")
    return c.select(F.col("c_custkey").alias("id")).exceptAll(o.select(F.col("o_custkey").alias("id")).distinct())


def u7_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default patterns and the user's, each once."""
    mine = ("webhook_*", "tmp_*")
    given = spark.createDataFrame([(p,) for p in (*DEFAULT.excluded_tables, *mine)], "pattern string")
    return given.distinct()


def w2_topn_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer, three a task before the shuffle."""
    o = src.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("r", r).where("r <= 3").select("o_custkey", "o_orderkey", F.col("r").cast("long").alias("place"))


_STATE = "SELECT 't' || c_custkey AS table_name"
ORACLES = {
    "s2_query_rows": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2",
    "s3_batch_scan": "SELECT (place - 1) // 1000 AS batch, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders) GROUP BY 1",
    "s5_full_scan": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "s9_catalog_tables": "SELECT DISTINCT table_name FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in SOURCES) + ")",
    "s11_database_name": "SELECT 'default' AS name",
    "s16_file_pages": "SELECT p_partkey || '.pdf' AS filename, CAST(i AS BIGINT) AS page_number, w[i] AS text, CAST(NULL AS VARCHAR) AS error FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part WHERE p_partkey % 10 <> 0)) UNION ALL SELECT p_partkey || '.pdf', NULL, NULL, 'empty file' FROM part WHERE p_partkey % 10 = 0",
    "s17_folder": "SELECT n_name FROM nation WHERE n_nationkey % 2 = 0",
    "s18_images": "SELECT p_partkey || '.png' AS filename, CAST(1 AS BIGINT) AS page_number, octet_length(encode(p_name)) AS bytes, '' AS text FROM part",
    "s20_store_download": "SELECT 'k/' || c_custkey AS key, CASE WHEN c_custkey % 10 = 3 THEN 'failed' ELSE 'downloaded' END AS status, CASE WHEN c_custkey % 10 <> 3 THEN 3 * length('k/' || c_custkey) END AS size FROM customer",
    "s22_bounded_batch": "SELECT count(*) AS n, count(*) FILTER (s_suppkey % 10 <> 3) AS ok, true AS bounded FROM supplier",
    "s23_settings": "SELECT * FROM (VALUES ('max_query_tokens', 64), ('target_hits_per_token', 100), ('rerank_count', 100), ('max_regions', 12), ('max_download_mb', 100)) AS t(name, value)",
    "s24_id_set": "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id FROM lineitem",
    "s25_models": "SELECT * FROM (VALUES ('hash16', 16, 16), ('hash8', 8, 8)) AS t(model, dims, made)",
    "s28_get_or_fetch": "SELECT 'k/' || p_partkey AS key, CASE WHEN p_partkey % 10 = 1 THEN length('k/' || p_partkey) WHEN p_partkey % 10 <> 3 THEN 3 * length('k/' || p_partkey) END AS size, p_partkey % 10 = 1 AS cached FROM part",
    "k5_parallel_feed": "SELECT doc_id, source FROM documents",
    "k6_state_upsert": f"{_STATE}, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS records_processed, CASE WHEN c_custkey % 2 = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS sync_status FROM customer",
    "k9_schema_report": "SELECT row_number() OVER (ORDER BY n DESC, t) - 1 AS place, t || ' (' || format('{:,}', n) || ' rows)' AS heading FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in SOURCES) + ")",
    "k10_null_sink": "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders",
    "k13_posts": "SELECT doc_id, doc_id % 4 < 2 AS success, CASE WHEN doc_id % 4 >= 2 THEN 5 + least(length(coalesce(text, '')), 200) END AS n_error FROM documents",
    "k15_checkpoint_ddl": "SELECT * FROM (VALUES (0, 'table_name', 'string'), (1, 'last_sync_timestamp', 'timestamp_ntz'), (2, 'last_record_id', 'string'), (3, 'records_processed', 'bigint'), (4, 'records_failed', 'bigint'), (5, 'sync_status', 'string'), (6, 'error_message', 'string'), (7, 'updated_at', 'timestamp_ntz')) AS t(place, name, type)",
    "p2_result_shape": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Untitled' ELSE coalesce(source, 'Untitled') END AS title, CASE WHEN doc_id % 3 <> 0 THEN coalesce(lang, '') ELSE '' END AS tags, length(left(text, 200)) AS n FROM documents",
    "p3_equals": "SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src2'",
    "p5_array_elements": "SELECT conv_id FROM conversations WHERE text IS NOT NULL GROUP BY conv_id HAVING bool_or(regexp_matches(text, '\\bthe\\b', 'i'))",
    "p7_timestamp_column": "SELECT * FROM (VALUES ('projects', 'created_at'), ('photos', NULL), ('change_orders', NULL), ('companies', NULL), ('addresses', NULL), ('staff', NULL), ('category', NULL)) AS t(table_name, column_name)",
    "p9_min_sizes": "SELECT p_partkey FROM part WHERE p_size * 12 >= 200 AND p_partkey % 600 >= 200 AND p_size * 12 * (p_partkey % 600) >= 100000",
    "p18_extensions": "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 < 2",
    "j18_table_metadata": "SELECT * FROM (VALUES ('projects', 4, 1), ('photos', 6, 1), ('change_orders', 8, 3), ('companies', 1, 0), ('addresses', 1, 0), ('staff', 1, 0), ('category', 1, 0)) AS t(table_name, n_columns, n_links)",
    "a3_catalog_totals": "SELECT count(*) AS tables, CAST(sum(n) AS BIGINT) AS rows FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in SOURCES) + ")",
    "a6_job_status": "SELECT o_custkey AS job, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status FROM orders GROUP BY o_custkey",
    "a18_total_count": "SELECT count(*) AS total FROM documents WHERE lang = 'en' AND contains(text, 'the')",
    "a21_rates": "SELECT user_id, event_type, n, seconds, round(CASE WHEN seconds > 0 THEN n / seconds::DOUBLE ELSE 0 END, 9) AS rate FROM (SELECT user_id, event_type, count(*) AS n, CAST(floor(epoch(max(ts) - min(ts))) AS BIGINT) AS seconds FROM events GROUP BY ALL)",
    "u3_known_minus_current": "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders",
    "u7_exclusions": "SELECT * FROM (VALUES ('_prisma_migrations'), ('sync_events'), ('webhook_*'), ('api_credentials'), ('integration_*'), ('processed_webhook_events'), ('audit_records'), ('tmp_*')) AS t(pattern)",
    "w2_topn_per_user": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3",
}
QUERIES = {name: globals()[name] for name in ORACLES}
