"""Queries of discovery, ingestion and scans, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions import strings
from tessera.operators import ingestion as ing
from tessera.sources import tables as src

SOURCES = ("customer", "nation", "orders", "region")
CATALOG = (
    ("projects", "id", "bigint"), ("projects", "name", "text"), ("projects", "company_id", "bigint"), ("projects", "created_at", "timestamp"), ("photos", "id", "bigint"), ("photos", "project_id", "bigint"),
    ("photos", "s3_key", "text"), ("photos", "thumbnail_url", "text"), ("photos", "url", "text"), ("photos", "s3_bucket", "text"), ("change_orders", "id", "bigint"), ("change_orders", "project_id", "bigint"),
    ("change_orders", "attachment_s3_keys", "jsonb"), ("change_orders", "x_s3_keys", "json"), ("change_orders", "address_id", "bigint"), ("change_orders", "staff_id", "bigint"), ("change_orders", "ghost_id", "bigint"),
    ("change_orders", "category_id", "bigint"), ("companies", "id", "bigint"), ("addresses", "id", "bigint"), ("staff", "id", "bigint"), ("category", "id", "bigint"),
)
NOW = 1_700_000_000_000


def _catalog(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    c = spark.createDataFrame(CATALOG, "table_name string, column_name string, data_type string")
    return c, c.select("table_name").distinct()


def f13_classify_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ing.file_columns(_catalog(spark)[0])


def j1_fk_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ing.infer_relationships(*_catalog(spark))


def j3_incoming_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ing.incoming_hints(ing.infer_relationships(*_catalog(spark)))


def _frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: src.read(spark, sf_dir, t) for t in SOURCES}


def s10_catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ing.discover(spark, _frames(spark, sf_dir))["columns"]
    return c.select("table_name", "column_name", F.col("position").cast("long").alias("position"))


def a1_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.row_counts(_frames(spark, sf_dir))


def i12_metadata_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are told by the ending ``key`` here, and name no table, so there are no relationships."""
    found = ing.discover(spark, _frames(spark, sf_dir), "key")
    return ing.metadata_documents(found["columns"], found["relationships"], found["counts"], "db")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.read(spark, sf_dir, "orders")
    return o.select(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")).alias("id"), F.col("o_custkey").alias("customer_id"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("number"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).otherwise((F.col("o_orderkey") % 50).cast("string")).alias("project_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("created_at"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("k/"), F.col("o_orderkey"), F.lit("/A.PDF"))).alias("s3_key"), F.concat(F.lit('{"f1": "a/'), F.col("o_orderkey"), F.lit('.png", "f2": null}')).alias("more_s3_keys"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("https://h.org/d/x.jpg?q=1")).otherwise(F.lit("no url")).alias("url"))


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return ing.to_documents(_orders(spark, sf_dir), "orders", {"customer_id": "customers", "project_id": "projects"}, {"s3_key": "s3_key", "more_s3_keys": "jsonb_s3_map", "url": "url"}, NOW)


def i2_transform_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)[0]
    return d.select("doc_id", "source_id", "project_id", "content_text", "created_at", "updated_at", F.size("metadata").cast("long").alias("n_fields"), F.size("relationships").cast("long").alias("n_links"), F.size("file_references").cast("long").alias("n_files"))


def i2_metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir)[0].select("doc_id", F.explode("metadata").alias("field", "value"))


def i3_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir)[1].groupBy("source_table", "error").agg(F.count("*").alias("n"))


def j2_outgoing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)[0].select("doc_id", F.explode("relationships").alias("r"))
    return d.select("doc_id", "r.target_doc_id", "r.relationship_type", "r.direction", "r.source_column")


def j4_reverse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the orders that refer to them, counted."""
    o, c = src.read(spark, sf_dir, "orders"), src.read(spark, sf_dir, "customer")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return c.join(n, c["c_custkey"] == n["o_custkey"]).select("c_custkey", "n_orders")


def i5_detected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ing.detected_files(_documents(spark, sf_dir)[0]).select("doc_id", "key", "filename", "extension", "file_id")


def i14_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, said = ing.provenance(F.lit("orders"), F.col("o_orderkey").cast("string"), F.lit("s3_key"))
    return src.read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tags, "|").alias("tags"), said.alias("description"))


def u8_all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = src.read(spark, sf_dir, "region"), src.read(spark, sf_dir, "nation")
    parts = [ing.to_documents(r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), "regions", {}, {}, NOW)[0], ing.to_documents(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_id")), "nations", {"region_id": "regions"}, {}, NOW)[0]]
    return ing.union_documents(parts).select("doc_id", "source_table", "content_text", F.size("relationships").cast("long").alias("n_links"))


def s6_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.read(spark, sf_dir, "events")
    column = src.timestamp_column(["id", "created_at", "updated_at"]) and "ts"
    return src.incremental(e, column, F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", "user_id")


def s7_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.limited(src.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 25)


def s8_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five orders at random: whichever they are, as many, different, and among all."""
    o = src.read(spark, sf_dir, "orders").select("o_orderkey")
    known = src.sample(o, 5).join(o.select(F.col("o_orderkey").alias("k")), F.col("o_orderkey") == F.col("k"), "left")
    return known.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("different"), F.count("k").alias("known"))


def s12_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.point(src.read(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_orderstatus")


def s13_visit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.read(spark, sf_dir, "documents")
    return d.where("source = 'src3'").select(F.col("doc_id").cast("string").alias("source_id")).distinct()


def s14_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read(spark, sf_dir, "documents").agg(F.count("*").alias("n"))


def s21_download_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each file would be fetched, or why it is skipped. A file without an extension is not skipped."""
    f = ing.detected_files(_documents(spark, sf_dir)[0]).withColumn("mb", F.length("doc_id") * 9)
    status = F.when(F.col("mb") > DEFAULT.max_download_mb, "too large").when(F.col("extension").isNotNull() & ~F.col("extension").isin(*DEFAULT.download_types), "unsupported").when(F.col("url").isNotNull(), "url").otherwise("store")
    return f.select("doc_id", "key", status.alias("status"))


def s29_fetch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.read(spark, sf_dir, "orders")
    return src.fetch(o, o.where("o_orderstatus = 'F'").select((F.col("o_orderkey") + 1).alias("o_orderkey")), "o_orderkey").select("o_orderkey", "o_orderstatus")


def p1_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the shape of an answer: defaults for nulls, a flag for a stored original."""
    p = src.read(spark, sf_dir, "pages")
    key = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("k/"), "page_id"))
    return p.select("page_id", F.coalesce(F.when(F.col("page_id") % 2 == 0, F.col("url")), F.lit("")).alias("url"), (F.length(key) > 0).alias("has_original_pdf"))


def p4_title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words side by side, whatever their case."""
    d = src.read(spark, sf_dir, "documents")
    said = F.concat(F.lit(" "), F.array_join(strings.words(F.col("text")), " "), F.lit(" "))
    return d.where(F.contains(said, F.lit(" of the "))).select("doc_id")


def p6_table_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [(n,) for n in ("projects", "webhook_calls", "audit_records", "integration_x", "sync_events", "photos", "_prisma_migrations", "temp_1")]
    t = spark.createDataFrame(names, "t string")
    return t.where(~strings.matches_any_glob(F.col("t"), (*DEFAULT.excluded_tables, "temp_?")))


def p13_upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.read(spark, sf_dir, "documents").withColumn("name", F.when(F.col("doc_id") % 7 == 0, F.lit("a.txt")).otherwise(F.lit("a.PDF")))
    error = F.when(F.col("n_chars") > 20_000, "File too large").when(~F.lower("name").endswith(".pdf"), "Only PDF files").when(F.length(F.substring("text", 1, 300)) < 100, "Title too short")
    return d.select("doc_id", F.coalesce(error, F.lit("ok")).alias("status"))


def p15_client_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.read(spark, sf_dir, "documents").select("doc_id", "source", F.array("lang", F.concat(F.lit("Tag"), F.col("doc_id") % 10)).alias("tags"))
    hit = F.contains(F.lower("source"), F.lit("rc1")) | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit("tag7")))
    return d.where(hit).select("doc_id")


def a16_group_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.read(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("orders"))


def a17_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


def a2_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ing.file_columns(_catalog(spark)[0])
    return f.agg(F.count("*").alias("n_columns"), F.countDistinct("table_name").alias("n_tables"))


_C = ", ".join(str(c) for c in CATALOG)
_O = f"o AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS id, o_orderkey AS k, o_custkey AS customer_id, CASE WHEN o_orderkey % 2 = 0 THEN '  ' ELSE ' ' || o_orderpriority END AS title, o_orderstatus AS number, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS project_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS created_at FROM orders), d AS (SELECT *, 'orders:' || id AS doc_id FROM o WHERE id IS NOT NULL AND project_id <> 'x')"
_F = "f AS (SELECT doc_id, k, 'k/' || k || '/A.PDF' AS key, 'A.PDF' AS filename, 'pdf' AS extension, CAST(NULL AS VARCHAR) AS file_id, false AS by_url FROM d WHERE k % 5 <> 0 UNION ALL SELECT doc_id, k, 'a/' || k || '.png', k || '.png', 'png', 'f1', false FROM d UNION ALL SELECT doc_id, k, 'https://h.org/d/x.jpg?q=1', 'x.jpg', 'jpg', NULL, true FROM d WHERE k % 2 = 0)"
_FK = "(VALUES ('change_orders', 'address_id', 'addresses'), ('change_orders', 'project_id', 'projects'), ('change_orders', 'staff_id', 'staff'), ('photos', 'project_id', 'projects'), ('projects', 'company_id', 'companies')) AS t(source_table, source_column, target_table)"

ORACLES = {
    "f13_classify_columns": f"SELECT * FROM (SELECT table_name, column_name, CASE WHEN data_type = 'jsonb' AND column_name LIKE '%\\_s3\\_keys' ESCAPE '\\' THEN 'jsonb_s3_map' WHEN data_type = 'text' AND (column_name = 's3_key' OR column_name LIKE 's3\\_%' ESCAPE '\\' OR column_name LIKE '%\\_s3\\_key' ESCAPE '\\') THEN 's3_key' WHEN data_type = 'text' AND (column_name = 'url' OR column_name LIKE '%\\_url' ESCAPE '\\') THEN 'url' END AS kind FROM (VALUES {_C}) AS t(table_name, column_name, data_type)) WHERE kind IS NOT NULL",
    "j1_fk_inference": f"SELECT * FROM {_FK}",
    "j3_incoming_hints": f"SELECT target_table, source_table, source_column, rtrim(source_table, 's') AS relationship_type, 'one_to_many' AS cardinality, 'Find ' || source_table || ' where ' || source_column || ' = id' AS query_hint FROM {_FK}",
    "s10_catalog_columns": "SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS position FROM information_schema.columns WHERE table_name IN ('customer', 'nation', 'orders', 'region')",
    "a1_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in SOURCES),
    "i12_metadata_documents": "WITH c AS (SELECT table_name, string_agg(column_name, ' ' ORDER BY column_name) AS cols FROM information_schema.columns WHERE table_name IN ('customer', 'nation', 'orders', 'region') GROUP BY table_name), n AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in SOURCES) + ") SELECT 'table:' || table_name AS doc_id, table_name || ' ' || cols AS content_text, row_count, CAST(0 AS BIGINT) AS n_out, CAST(0 AS BIGINT) AS n_in FROM c JOIN n USING (table_name) UNION ALL SELECT 'schema:db', 'db with 4 tables', CAST(sum(row_count) AS BIGINT), 0, 0 FROM n",
    "i2_transform_orders": f"WITH {_O} SELECT doc_id, CAST(id AS VARCHAR) AS source_id, TRY_CAST(project_id AS BIGINT) AS project_id, CASE WHEN trim(title) = '' THEN number ELSE trim(title) || ' ' || number END AS content_text, CASE WHEN created_at IS NULL THEN {NOW} ELSE epoch_ms(created_at) END AS created_at, CAST({NOW} AS BIGINT) AS updated_at, CAST(7 + (created_at IS NOT NULL)::INT + (k % 5 <> 0)::INT AS BIGINT) AS n_fields, CAST(2 AS BIGINT) AS n_links, CAST(2 + (k % 5 <> 0)::INT AS BIGINT) AS n_files FROM d",
    "i2_metadata_fields": f"WITH {_O} SELECT doc_id, field, value FROM (SELECT doc_id, unnest(['id', 'customer_id', 'title', 'number', 'project_id', 'created_at', 's3_key', 'more_s3_keys', 'url']) AS field, unnest([CAST(id AS VARCHAR), CAST(customer_id AS VARCHAR), title, number, project_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S'), CASE WHEN k % 5 <> 0 THEN 'k/' || k || '/A.PDF' END, '{{\"f1\": \"a/' || k || '.png\", \"f2\": null}}', CASE WHEN k % 2 = 0 THEN 'https://h.org/d/x.jpg?q=1' ELSE 'no url' END]) AS value FROM d) WHERE value IS NOT NULL",
    "i3_rejects": "SELECT 'orders' AS source_table, CASE WHEN o_orderkey % 11 = 0 THEN 'Row without id' ELSE 'project_id is not a number' END AS error, count(*) AS n FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 3 = 0 GROUP BY ALL",
    "j2_outgoing_links": f"WITH {_O} SELECT doc_id, 'customers:' || customer_id AS target_doc_id, 'customer' AS relationship_type, 'outgoing' AS direction, 'customer_id' AS source_column FROM d UNION ALL SELECT doc_id, 'projects:' || project_id, 'project', 'outgoing', 'project_id' FROM d",
    "j4_reverse_links": "SELECT c_custkey, count(*) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "i5_detected_files": f"WITH {_O}, {_F} SELECT doc_id, key, filename, extension, file_id FROM f",
    "i14_provenance": "SELECT o_orderkey, 'orders|record:' || o_orderkey || '|column:s3_key' AS tags, 'Source: orders (record ' || o_orderkey || ')' AS description FROM orders",
    "u8_all_documents": "SELECT 'regions:' || r_regionkey AS doc_id, 'regions' AS source_table, r_name AS content_text, CAST(0 AS BIGINT) AS n_links FROM region UNION ALL SELECT 'nations:' || n_nationkey, 'nations', n_name, 1 FROM nation",
    "s6_incremental": "SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-20'",
    "s7_limited": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25",
    "s8_sample": "SELECT CAST(5 AS BIGINT) AS n, CAST(5 AS BIGINT) AS different, CAST(5 AS BIGINT) AS known",
    "s12_point_get": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "s13_visit_ids": "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS source_id FROM documents WHERE source = 'src3'",
    "s14_match_count": "SELECT count(*) AS n FROM documents",
    "s21_download_dispatch": f"WITH {_O}, {_F} SELECT doc_id, key, CASE WHEN length(doc_id) * 9 > 100 THEN 'too large' WHEN by_url THEN 'url' ELSE 'store' END AS status FROM f",
    "s29_fetch_ids": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT o_orderkey + 1 FROM orders WHERE o_orderstatus = 'F')",
    "p1_projection": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN coalesce(url, '') ELSE '' END AS url, page_id % 3 <> 0 AS has_original_pdf FROM pages",
    "p4_title_terms": "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])of[^\\p{L}\\p{N}]+the([^\\p{L}\\p{N}]|$)')",
    "p6_table_selection": "SELECT * FROM (VALUES ('projects'), ('photos')) AS t(t)",
    "p13_upload_checks": "SELECT doc_id, CASE WHEN n_chars > 20000 THEN 'File too large' WHEN doc_id % 7 = 0 THEN 'Only PDF files' WHEN length(left(text, 300)) < 100 THEN 'Title too short' ELSE 'ok' END AS status FROM documents",
    "p15_client_search": "SELECT doc_id FROM documents WHERE contains(lower(source), 'rc1') OR doc_id % 10 = 7",
    "a16_group_to_map": "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey",
    "a17_category_counts": "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang",
    "a2_file_summary": "SELECT CAST(5 AS BIGINT) AS n_columns, CAST(2 AS BIGINT) AS n_tables",
}
QUERIES = {name: globals()[name] for name in ORACLES}
