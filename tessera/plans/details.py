"""Queries of the parts of scalar functions, ingestion and page processing, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions import nested, strings
from tessera.operators import etl, regions, serving, sync_flow, vector_plan
from tessera.operators import ingestion as ing
from tessera.operators import synchronisation as sync
from tessera.plans.ingestion import NOW, SOURCES, _catalog, _documents, _frames
from tessera.plans.synchronisation import _LATEST, _dir, _log, _tables
from tessera.runtime import ship
from tessera.sources import sinks
from tessera.sources.tables import read


def f3_short_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", strings.short_md5(F.col("text")).alias("md5"))


def f4_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", strings.page_doc_id(F.concat("p_name", F.lit(".pdf")), F.col("p_brand"), F.col("p_size")).alias("doc_id"))


def f8_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's name without its extension."""
    p = read(spark, sf_dir, "part")
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, (".pdf", "", ".tar.gz"))), (F.col("p_partkey") % 3 + 1).cast("int")))
    return p.select("p_partkey", strings.stem(name).alias("title"))


def f17_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.where(strings.matches_any_glob(F.col("c_name"), ("*1?", "Customer#000000?0*"))).select("c_custkey")


def f19_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.element_at(F.array(*map(F.lit, ("on", " TRUE ", "1", "Yes", "no", "", "2"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", strings.truthy(F.when(F.col("o_orderkey") % 9 != 0, flag)).alias("flag"))


def f20_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(strings.line_breaks(F.concat("source", F.lit("\n"), "text")).cast("binary")).alias("html_md5"))


def d2_or_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and zero times are now."""
    at = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 4 * 1000)
    return read(spark, sf_dir, "orders").select("o_orderkey", nested.or_now(at, NOW).alias("millis"))


def m12_tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of pages of many sizes: how many, and that they reach the far corner."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), (F.col("p_size") * 150 + 400).cast("long").alias("width"), (F.col("p_partkey") % 50 * 120 + 400).cast("long").alias("height"))
    t = regions.tiles(p).groupBy("page_id").agg(F.count("*").alias("n"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"))
    return t


def m13_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("l_discount") * F.col("l_tax") * 20
    l = read(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", F.round(F.least(F.lit(1.0), share * regions.DENSITY_SCALE), 6).alias("confidence"))


def m16_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with their padding, inside the page."""
    pad, side = DEFAULT.crop_padding, 1000
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % side).alias("x"), (F.col("p_size") * 9).alias("w"))
    return p.select("p_partkey", F.greatest(F.col("x") - pad, F.lit(0)).cast("long").alias("left"), F.least(F.col("x") + F.col("w") + pad, F.lit(side)).cast("long").alias("right"))


def c4_optional_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON without the keys whose values are missing, empty or zero."""
    o = read(spark, sf_dir, "orders")
    count = F.nullif(F.col("o_orderkey") % 3, F.lit(0))
    name = F.nullif(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.lit("")), F.lit(""))
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_custkey").alias("id"), count.alias("n"), name.alias("s"))).alias("json"))


def i1_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that discovery tells of a source, one row a table."""
    found = ing.discover(spark, _frames(spark, sf_dir))
    n = found["columns"].groupBy("table_name").agg(F.count("*").alias("n_columns"), F.max_by("column_name", "position").alias("last_column"))
    return found["tables"].join(n, "table_name").join(found["counts"], "table_name")


def i4_file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _documents(spark, sf_dir)[0].select("doc_id", F.explode("file_references").alias("f"))
    return f.groupBy("f.source_column", "f.reference_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    when = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(c_custkey % 60 AS INT))")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation_id"), when.alias("updated_at"))


def _synced(spark: SparkSession, rows: DataFrame, *marks: tuple, column: str | None = "updated_at") -> tuple[DataFrame, list[dict]]:
    store = sinks.SnapshotStore(spark, f"{_dir(spark)}/docs", "doc_id")
    runs = [sync_flow.sync_table("customers", rows, store, since, until, column, {"nation_id": "nations"}, {}, NOW) for since, until in marks]
    return store.read(), runs


def i6_full_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run: everything up to its mark, whatever the time of its change."""
    docs, _ = _synced(spark, _customers(spark, sf_dir), (None, datetime(2024, 12, 31)))
    return docs.select("doc_id", "content_text", F.element_at("relationships", 1)["target_doc_id"].alias("target"))


def i9_no_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without a time of change is read whole at every run."""
    rows = _customers(spark, sf_dir).drop("updated_at")
    _, runs = _synced(spark, rows, (None, datetime(2024, 1, 1)), (datetime(2024, 1, 1), datetime(2024, 2, 1)), column=None)
    return spark.createDataFrame([(i, r["processed"], r["deleted"]) for i, r in enumerate(runs)], "run long, processed long, deleted long")


def i10_single_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table in two runs: the first takes all, the second what changed between the marks."""
    _, runs = _synced(spark, _customers(spark, sf_dir), (None, datetime(2024, 1, 20)), (datetime(2024, 1, 20), datetime(2024, 2, 5)))
    out = runs[0]["checkpoint"].unionByName(runs[1]["checkpoint"])
    return out.select("table_name", F.date_format("last_sync_timestamp", "yyyy-MM-dd").alias("mark"), "records_processed", "records_failed", "sync_status")


def i11_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six cycles over the tables there are: two new ones a cycle, then changes; deletions every third."""
    tables, done, rows = sorted(SOURCES), set(), []
    for cycle in range(6):
        plan = sync.schedule(tables, done, cycle, 2, 3)
        rows += [(cycle, t, t in plan.full, plan.deletes) for t in (*plan.full, *plan.changed)]
        done |= set(plan.full)
    return spark.createDataFrame(rows, "cycle long, table_name string, whole boolean, deletes boolean")


def i13_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ways lead back to each table, and one of them."""
    h = ing.incoming_hints(ing.infer_relationships(*_catalog(spark)))
    return h.groupBy("target_table").agg(F.count("*").alias("n"), F.min("query_hint").alias("first"))


def i15_valid_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks count only of tables whose last run was completed."""
    last = sync.last_sync(sync.latest_checkpoints(_log(spark, sf_dir)))
    return last.select("table_name", F.date_format("last_sync_timestamp", "yyyy-MM-dd HH:mm:ss").alias("mark"))


def i17_status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by what their last checkpoint says, those without one as never synced."""
    last = sync.latest_checkpoints(_log(spark, sf_dir))
    state = _tables(spark).join(last, "table_name", "left").select(F.coalesce("sync_status", F.lit("NEVER")).alias("status"), F.coalesce("records_failed", F.lit(0)).alias("failed"))
    return state.groupBy("status").agg(F.count("*").alias("tables"), F.sum("failed").alias("failed"))


def _one_page(content: bytes) -> list[tuple[bytes, str]]:
    return [(content, content[:4].decode())]


def e2_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as documents of one page."""
    ship(spark)
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("img "), "p_partkey", F.lit(".PNG")).alias("filename"), F.col("p_brand").cast("binary").alias("content"))
    return etl.page_documents(etl.pages(p, _one_page)).select("id", "title", "page_number", "text")


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages drawn in memory: two framed drawings by paths, two dark fields by pixels, or nothing."""
    ship(spark)
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"))
    return regions.drawn_pages(n)


def e4_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade with paths at hand: by vector where they tell of two regions, else by white space, else by tiles."""
    got = vector_plan.page_regions(_drawn(spark, sf_dir), "auto")
    return got.groupBy("page_id").agg(F.count_if(F.col("region_type") == "detected").alias("detected"), F.count_if(F.col("region_type") == "tile").alias("tiles"), F.max(F.when(F.col("region_type") == "detected", F.col("confidence"))).alias("confidence"))


def u6_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths inside a frame or table are claimed; the others form further regions."""
    got = vector_plan.page_regions(_drawn(spark, sf_dir).where("page_id % 3 = 0"), "pdf_vector")
    return got.where("region_type = 'detected'").groupBy("confidence").agg(F.count("*").alias("n"))


def _labels(texts: list[str]) -> list[str]:
    if any(t.startswith("r1") for t in texts):
        raise TimeoutError("model is away")
    return [t.upper() for t in texts]


def e11_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by a model behind an interface; where it fails, numbered names in their place."""
    ship(spark)
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit(1).cast("long").alias("region"), F.concat(F.lit("r"), "p_size").alias("text"))
    return etl.labelled(p, _labels).select("page_id", "label", "by_model")


def e13_offline_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render, embed, feed as one plan: what the store has in the end."""
    ship(spark)
    p = read(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit(".pdf")).alias("filename"), F.col("p_name").cast("binary").alias("content"))
    docs = etl.page_documents(etl.pages(p, _one_page))
    made = etl.embed(docs.select("id", "page_number", "text"), etl.hashed_model(16, 2))
    store = sinks.SnapshotStore(spark, f"{_dir(spark)}/pages", "id")
    store.upsert(made.select("id", "page_number", F.size("vectors").alias("patches")))
    return store.read().agg(F.count("*").alias("n"), F.sum("patches").alias("patches"), F.max("page_number").alias("pages"))


def e15_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the text of the file or, without one, a snippet that names the page."""
    ship(spark)
    p = read(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit(".pdf")).alias("filename"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.lit("    ")).cast("binary").alias("content"))
    got = etl.page_documents(etl.pages(p, _one_page))
    return got.select("title", F.length("text").cast("long").alias("n"), "snippet")


def e16_reembed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages by two encoders: lengths of what each makes."""
    ship(spark)
    d = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    models = serving.Models({"small": (16, lambda: etl.hashed_model(16, 2)), "large": (32, lambda: etl.hashed_model(32, 2))})
    out = None
    for name in sorted(models.known):
        made = etl.embed(d, models.make(name), "s_name").select("s_suppkey", F.lit(name).alias("model"), F.size(F.element_at("packed", 1)).cast("long").alias("bytes"))
        out = made if out is None else out.unionByName(made)
    return out


def e17_region_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as JSON and read back."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.lit(5).alias("x"), F.col("p_size").alias("width"), F.lit("tile").alias("label"))).alias("json"))
    back = F.from_json("json", "x int, width int, label string")
    return p.select("p_partkey", "json", back["width"].cast("long").alias("width"), back["label"].alias("label"))


_TILE = "greatest(1, CAST(ceil(({} - 100) / 1700.0) AS INT))"
ORACLES = {
    "f3_short_md5": "SELECT doc_id, left(md5(text), 12) AS md5 FROM documents",
    "f4_document_ids": "SELECT p_partkey, coalesce(nullif(lower(regexp_replace(left(regexp_replace(p_name || '.pdf', '[^a-zA-Z0-9]', '_', 'g'), 30), '^_+|_+$', '', 'g')), ''), 'document') || '_' || left(md5(p_brand), 12) || '_page_' || p_size AS doc_id FROM part",
    "f8_titles": "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN p_name || '.tar' ELSE p_name END AS title FROM part",
    "f17_globs": "SELECT c_custkey FROM customer WHERE c_name GLOB '*1?' OR c_name GLOB 'Customer#000000?0*'",
    "f19_truthy": "SELECT o_orderkey, o_orderkey % 9 <> 0 AND o_orderkey % 7 < 4 AS flag FROM orders",
    "f20_line_breaks": "SELECT doc_id, md5(source || '<br>' || replace(text, chr(10), '<br>')) AS html_md5 FROM documents",
    "d2_or_now": f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 THEN o_orderkey % 4 * 1000 ELSE {NOW} END AS millis FROM orders",
    "m12_tile_counts": f"SELECT p_partkey AS page_id, CAST({_TILE.format('w')} * {_TILE.format('h')} AS BIGINT) AS n, CAST(w AS BIGINT) AS right, CAST(h AS BIGINT) AS bottom FROM (SELECT p_partkey, p_size * 150 + 400 AS w, p_partkey % 50 * 120 + 400 AS h FROM part)",
    "m13_confidence": "SELECT l_orderkey, l_linenumber, round(least(1.0, CAST(l_discount AS DOUBLE) * CAST(l_tax AS DOUBLE) * 20 * 10), 6) AS confidence FROM lineitem",
    "m16_crops": "SELECT p_partkey, greatest(p_partkey * 37 % 1000 - 20, 0) AS left, least(p_partkey * 37 % 1000 + p_size * 9 + 20, 1000) AS right FROM part",
    "c4_optional_keys": "SELECT o_orderkey, '{\"id\":' || o_custkey || CASE WHEN o_orderkey % 3 <> 0 THEN ',\"n\":' || o_orderkey % 3 ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN ',\"s\":\"' || o_orderstatus || '\"' ELSE '' END || '}' AS json FROM orders",
    "i1_discovery": "WITH c AS (SELECT table_name, count(*) AS n_columns, arg_max(column_name, ordinal_position) AS last_column FROM information_schema.columns GROUP BY table_name), n AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in SOURCES) + ") SELECT table_name, n_columns, last_column, row_count FROM n JOIN c USING (table_name)",
    "i4_file_references": "SELECT 's3_key' AS source_column, 's3_key' AS reference_type, count(*) AS n, count(*) AS n_docs FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 UNION ALL SELECT 'more_s3_keys', 'jsonb_s3_map', count(*), count(*) FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0 UNION ALL SELECT 'url', 'url', count(*), count(*) FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0",
    "i6_full_sync": "SELECT 'customers:' || c_custkey AS doc_id, c_name AS content_text, 'nations:' || c_nationkey AS target FROM customer",
    "i9_no_timestamp": "SELECT range AS run, (SELECT count(*) FROM customer) AS processed, CAST(0 AS BIGINT) AS deleted FROM range(2)",
    "i10_single_table": "SELECT 'customers' AS table_name, '2024-01-20' AS mark, count(*) AS records_processed, CAST(0 AS BIGINT) AS records_failed, 'COMPLETED' AS sync_status FROM customer UNION ALL SELECT 'customers', '2024-02-05', count(*) FILTER (c_custkey % 60 BETWEEN 20 AND 35), 0, 'COMPLETED' FROM customer",
    "i11_schedule": "SELECT * FROM (VALUES (0, 'customer', true, true), (0, 'nation', true, true), (1, 'orders', true, false), (1, 'region', true, false)) AS t(cycle, table_name, whole, deletes) UNION ALL SELECT c.range, t, false, c.range % 3 = 0 FROM range(2, 6) c, (VALUES ('customer'), ('nation'), ('orders'), ('region')) AS s(t)",
    "i13_hints": "SELECT * FROM (VALUES ('addresses', 1, 'Find change_orders where address_id = id'), ('projects', 2, 'Find change_orders where project_id = id'), ('staff', 1, 'Find change_orders where staff_id = id'), ('companies', 1, 'Find projects where company_id = id')) AS t(target_table, n, first)",
    "i15_valid_checkpoints": "SELECT 't' || user_id AS table_name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS mark FROM (SELECT user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type NOT IN ('error', 'view')",
    "i17_status_report": f"WITH {_LATEST} SELECT coalesce(sync_status, 'NEVER') AS status, count(*) AS tables, CAST(sum(coalesce(records_failed, 0)) AS BIGINT) AS failed FROM (SELECT 't' || range AS table_name FROM range(160)) LEFT JOIN k USING (table_name) GROUP BY 1",
    "e2_images": "SELECT 'img_' || p_partkey || '_png_' || left(md5(p_brand), 12) || '_page_1' AS id, 'img ' || p_partkey AS title, CAST(1 AS BIGINT) AS page_number, left(p_brand, 4) AS text FROM part",
    "e4_cascade": "SELECT CAST(n_nationkey AS BIGINT) AS page_id, CASE WHEN n_nationkey % 3 = 2 THEN 0 ELSE 2 END AS detected, CASE WHEN n_nationkey % 3 = 2 THEN 4 ELSE 0 END AS tiles, CASE n_nationkey % 3 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 1.0::DOUBLE END AS confidence FROM nation",
    "u6_claimed": "SELECT 0.9::DOUBLE AS confidence, 2 * count(*) AS n FROM nation WHERE n_nationkey % 3 = 0",
    "e11_labels": "SELECT p_partkey AS page_id, CASE WHEN left(CAST(p_size AS VARCHAR), 1) = '1' THEN 'region_1' ELSE 'R' || p_size END AS label, left(CAST(p_size AS VARCHAR), 1) <> '1' AS by_model FROM part",
    "e13_offline_feed": "SELECT count(*) AS n, CAST(2 * count(*) AS BIGINT) AS patches, CAST(1 AS BIGINT) AS pages FROM part",
    "e15_variants": "SELECT CAST(p_partkey AS VARCHAR) AS title, CAST(4 AS BIGINT) AS n, CASE WHEN p_partkey % 2 = 0 THEN left(p_type, 4) ELSE '    ' END AS snippet FROM part",
    "e16_reembed": "SELECT s_suppkey, m AS model, CASE m WHEN 'small' THEN 2 ELSE 4 END AS bytes FROM supplier, (VALUES ('small'), ('large')) AS t(m)",
    "e17_region_json": "SELECT p_partkey, '{\"x\":5,\"width\":' || p_size || ',\"label\":\"tile\"}' AS json, CAST(p_size AS BIGINT) AS width, 'tile' AS label FROM part",
}
QUERIES = {name: globals()[name] for name in ORACLES}
