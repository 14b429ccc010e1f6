"""Queries of whole flows and of what is left between the areas, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import strings
from tessera.operators import etl, regions, serving, sync_flow, text_index, vector_plan
from tessera.operators import retrieval as r
from tessera.operators import synchronisation as sync
from tessera.plans.retrieval import _bm25_sql, patches, tokens
from tessera.plans.synchronisation import _dir
from tessera.runtime import ship
from tessera.sources.sinks import SnapshotStore
from tessera.sources.tables import read


def s15_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several queries' rows, each row once."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return d.where("source LIKE 'src1%'").unionByName(d.where("doc_id % 2 = 0")).dropDuplicates(["doc_id"])


def s27_one_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").where("page_id = 5").select("url").where("url <> ''").limit(1)


def s19_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select(F.col("url").alias("key"), F.element_at(F.array(F.lit("pdf"), F.lit("doc"), F.lit(None).cast("string")), (F.col("page_id") % 3 + 1).cast("int")).alias("extension"))

    def fetch(key: str) -> bytes:
        if key.startswith("http:"):
            raise OSError("no route")
        return key.encode()

    return serving.download(p, fetch)


def p14_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumnRenamed("lang", "category")
    return serving.scoped(d, category="en", text="The").select("doc_id")


def p16_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.where(F.contains(F.lower("c_name"), F.lit("7")) | F.contains(F.lower("c_mktsegment"), F.lit("auto"))).select("c_custkey")


def a12_profile_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    return l.groupBy("l_linenumber").agg(F.round(F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)), 6).alias("share")).select(F.col("l_linenumber").cast("long").alias("row"), "share")


def a20_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.agg(F.count_if(F.col("n_chars") > 1000).alias("ok"), F.sum(F.expr("n_chars div 3000 + 1")).alias("pages"))


def c5_reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References stored as JSON strings, parsed; broken ones are dropped."""
    o = read(spark, sf_dir, "orders")
    js = F.array(F.concat(F.lit('{"s3_key": "k/'), "o_orderkey", F.lit('"}')), F.lit("{broken"))
    refs = F.filter(F.transform(js, lambda x: F.from_json(x, "s3_key string, url string")), lambda x: x["s3_key"].isNotNull())
    return o.select("o_orderkey", F.explode(refs).alias("r")).select("o_orderkey", "r.s3_key", "r.url")


def d4_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times without a zone are UTC."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"), F.date_format("ts", "HH").alias("hour"))


def m14_query_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of queries that no process changes: as many as there are queries."""
    c = read(spark, sf_dir, "conversations").select("text").distinct()
    return c.agg(F.countDistinct(F.xxhash64("text", F.lit("hybrid"))).alias("ids"), F.count("*").alias("queries"))


def m15_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as JSON, with the area."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("w"), (F.col("p_size") * 2).alias("h"))
    js = F.to_json(F.struct(F.col("w").alias("width"), F.col("h").alias("height")))
    return p.select("p_partkey", (F.col("w") * F.col("h")).cast("long").alias("area"), js.alias("json"))


def j17_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and images paired by their places."""
    o = read(spark, sf_dir, "orders")
    w = W.orderBy("k")
    hits = o.orderBy("o_orderkey").limit(20).select(F.col("o_orderkey").alias("k")).select("k", F.row_number().over(w).alias("place"))
    images = read(spark, sf_dir, "pages").orderBy("page_id").limit(15).select(F.col("page_id").alias("k"), "url").select("url", F.row_number().over(w).alias("place"))
    return hits.join(images, "place", "left").select("k", "url")


def j20_delete_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return sync.delete(c, sync.deleted(c, c.where("CAST(id AS INT) % 3 <> 1"), "id"), "id")


def k7_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint log in the declared schema, with defaults for what is missing, read back by table."""
    u = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("t"))
    log = u.select(F.concat(F.lit("t"), "user_id").alias("table_name"), F.col("t").alias("last_sync_timestamp"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("records_processed"), F.when(F.col("user_id") % 2 == 0, "COMPLETED").alias("sync_status"), F.col("t").alias("updated_at"))
    filled = log.fillna(0, ["records_processed"]).fillna("IDLE", ["sync_status"])
    return sync.latest_checkpoints(filled).select("table_name", "records_processed", "sync_status")


def r12_record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the terms of their text, within some tables."""
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("rec"), "role", "text")
    return r.top(text_index.bm25(c.where("role = 'user'"), "rec", "text", ["the", "of"]), 10, "rec").withColumn("score", F.round("score", 6))


def r20_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").limit(1).agg((F.count("*") > 0).alias("alive"))


def r15_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An agent that searches twice, reads a result and answers: the documents it has kept."""
    d = read(spark, sf_dir, "documents")

    def search(query: str) -> list[tuple[int, str]]:
        hits = r.top(text_index.bm25(d, "doc_id", "text", query.split()), 3, "doc_id")
        return [(x["doc_id"], x["text"]) for x in hits.join(d, "doc_id").orderBy(F.col("score").desc(), "doc_id").select("doc_id", "text").collect()]

    plan = [("search", "token"), ("search", "the token"), ("text", "0"), ("answer", "done")]
    got = serving.Agent(search, lambda log: plan[len(log)]).run()
    return spark.createDataFrame([(i, k) for i, k in enumerate(got["documents"])], "place long, doc_id long")


def u4_changed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    return o.where("o_orderkey % 10 = 1").unionByName(o.where("o_orderkey % 10 = 2"))


def i7_incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table synchronised whole, changed, and synchronised again: what the store has of it then."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("name"), F.col("o_orderdate").alias("updated_at"), F.concat(F.lit("k/"), "o_orderkey", F.lit("/a.pdf")).alias("s3_key"))
    store = SnapshotStore(spark, f"{_dir(spark)}/docs", "doc_id")
    run = lambda rows, since, until: sync_flow.sync_table("orders", rows, store, since, until, "updated_at", {"customer_id": "customers"}, {"s3_key": "s3_key"}, 1_700_000_000_000)
    run(o, None, datetime(2002, 1, 1))
    changed = F.col("id") % 7 == 0
    later = o.where("id % 5 <> 0").withColumn("name", F.when(changed, F.lit("NEW")).otherwise(F.col("name"))).withColumn("s3_key", F.when(changed, F.lit("k/new.pdf")).otherwise(F.col("s3_key"))).withColumn("updated_at", F.when(changed, F.expr("TIMESTAMP_NTZ '2002-02-01 00:00:00'")).otherwise(F.col("updated_at")))
    run(later, datetime(2002, 1, 1), datetime(2002, 3, 1))
    return store.read().select("doc_id", "content_text", F.element_at("file_references", 1)["s3_key"].alias("s3_key"))


def i16_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of another model for documents that lack them, by a partial update."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.lit(4)).alias("patches"))
    made = etl.embed(d.where("patches IS NULL").select("doc_id", "text"), serving.Models({"hash": (16, lambda: etl.hashed_model(16, 2))}).make("hash"))
    new = made.select("doc_id", F.size("vectors").alias("patches"))
    return sync.update_fields(d.drop("text"), new, "doc_id", ["patches"]).select("doc_id", F.col("patches").cast("long").alias("patches"))


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return regions.drawn_pages(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id")))


def e5_vector_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of pages with two frames of paths, by paths alone."""
    got = vector_plan.page_regions(_drawn(spark, sf_dir).where("page_id % 3 = 0"), "pdf_vector")
    return got.where("region_type = 'detected'").select("page_id", "x", "y", "width", "height", F.col("content_hint").alias("hint"))


def e12_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small images of drawn pages: their sizes, corners and a point in the upper field."""
    return serving.thumbnails(_drawn(spark, sf_dir)).select("page_id", "height", "width", F.get("pixels", F.lit(0)).alias("first"), F.get("pixels", F.lit(2050)).alias("inside"))


def j12_patch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of token and patch pairs of each page."""
    return patches(spark, sf_dir).join(r.whole_query(tokens(spark, sf_dir))).groupBy("page").agg(F.count("*").alias("pairs"))


def f6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", "[?#].*$", "")
    return p.select("page_id", strings.basename(bare).alias("base"))


ORACLES = {
    "s15_union_dedupe": "SELECT doc_id, source FROM documents WHERE source LIKE 'src1%' OR doc_id % 2 = 0",
    "s27_one_field": "SELECT url FROM pages WHERE page_id = 5 AND url <> ''",
    "s19_download": "SELECT url AS key, CASE WHEN page_id % 3 = 1 THEN 'skipped' WHEN url LIKE 'http:%' THEN 'failed' ELSE 'downloaded' END AS status, CASE WHEN page_id % 3 <> 1 AND url NOT LIKE 'http:%' THEN octet_length(encode(url)) END AS size, CASE WHEN page_id % 3 = 1 THEN 'Unsupported type: doc' WHEN url LIKE 'http:%' THEN 'no route' END AS error FROM pages",
    "p14_scope": "SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(text), 'the')",
    "p16_name_filter": "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '7') OR contains(lower(c_mktsegment), 'auto')",
    "a12_profile_means": "SELECT CAST(l_linenumber AS BIGINT) AS row, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM lineitem GROUP BY l_linenumber",
    "a20_batch_totals": "SELECT count(*) FILTER (n_chars > 1000) AS ok, CAST(sum(n_chars // 3000 + 1) AS BIGINT) AS pages FROM documents",
    "c5_reference_lists": "SELECT o_orderkey, 'k/' || o_orderkey AS s3_key, CAST(NULL AS VARCHAR) AS url FROM orders",
    "d4_utc": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, strftime(ts, '%H') AS hour FROM events",
    "m14_query_ids": "SELECT count(DISTINCT text) AS ids, count(DISTINCT text) AS queries FROM conversations",
    "m15_areas": "SELECT p_partkey, CAST(p_size * p_size * 2 AS BIGINT) AS area, '{\"width\":' || p_size || ',\"height\":' || (p_size * 2) || '}' AS json FROM part",
    "j17_by_place": "WITH h AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders QUALIFY place <= 20), i AS (SELECT url, row_number() OVER (ORDER BY page_id) AS place FROM pages QUALIFY place <= 15) SELECT k, url FROM h LEFT JOIN i USING (place)",
    "j20_delete_gone": "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 3 <> 1",
    "k7_checkpoints": "SELECT DISTINCT 't' || user_id AS table_name, CASE WHEN user_id % 2 = 0 THEN user_id ELSE 0 END AS records_processed, CASE WHEN user_id % 2 = 0 THEN 'COMPLETED' ELSE 'IDLE' END AS sync_status FROM events",
    "r12_record_search": f"WITH c AS (SELECT conv_id * 1000 + turn AS rec, text FROM conversations WHERE role = 'user'), {_bm25_sql('s', 'c', 'rec', 'text', ['the', 'of'])} SELECT k AS rec, round(score, 6) AS score FROM s ORDER BY s.score DESC, k LIMIT 10",
    "r20_probe": "SELECT count(*) > 0 AS alive FROM documents",
    "r15_agent": f"WITH {_bm25_sql('la', 'documents', 'doc_id', 'text', ['token'])}, {_bm25_sql('lb', 'documents', 'doc_id', 'text', ['the', 'token'])}, f AS (SELECT k, row_number() OVER (ORDER BY score DESC, k) AS o FROM la QUALIFY o <= 3 UNION ALL SELECT k, 3 + row_number() OVER (ORDER BY score DESC, k) AS o FROM lb QUALIFY o <= 6) SELECT row_number() OVER (ORDER BY o) - 1 AS place, k AS doc_id FROM (SELECT k, min(o) AS o FROM f GROUP BY k)",
    "u4_changed_ids": "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 IN (1, 2)",
    "i7_incremental_sync": "SELECT 'orders:' || o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 = 0 THEN 'NEW' ELSE o_orderstatus END AS content_text, CASE WHEN o_orderkey % 7 = 0 THEN 'k/new.pdf' ELSE 'k/' || o_orderkey || '/a.pdf' END AS s3_key FROM orders WHERE o_orderkey % 5 <> 0",
    "i16_backfill": "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 2 END AS BIGINT) AS patches FROM documents",
    "e5_vector_regions": "SELECT CAST(n_nationkey AS BIGINT) AS page_id, x, 200 AS y, 800 AS width, 1600 AS height, 'drawing_view' AS hint FROM nation, (VALUES (100), (1040)) AS r(x) WHERE n_nationkey % 3 = 0",
    "e12_thumbnails": "SELECT CAST(n_nationkey AS BIGINT) AS page_id, 100 AS height, 100 AS width, 255 AS first, CASE WHEN n_nationkey % 3 = 1 THEN 0 ELSE 255 END AS inside FROM nation",
    "j12_patch_pairs": "SELECT vec_id // 8 AS page, count(*) * 3 AS pairs FROM embeddings GROUP BY vec_id // 8",
    "f6_paths": "SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS base FROM pages",
}
QUERIES = {name: globals()[name] for name in ORACLES}
