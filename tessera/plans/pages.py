"""Queries of page regions, windows and presentation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import etl, regions
from tessera.runtime import ship
from tessera.sources.tables import read

SIZES = ((1, 4000, 3000), (2, 800, 600), (3, 1800, 1800), (4, 9000, 150), (5, 3601, 5000))


def _sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIZES, "page_id long, width long, height long")


def p8_large_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark).select("page_id", regions.is_large(F.col("width"), F.col("height")).alias("large"), regions.is_big_enough(F.col("width"), F.col("height")).alias("enough"))


def e9_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.tiles(_sizes(spark))


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


def w4_gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = regions.gap_clusters(_times(spark, sf_dir), "user_id", "at", 36_000.0, "event_id")
    return c.groupBy("user_id", "cluster").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))


def a13_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions.regularity(_times(spark, sf_dir), ["user_id"], "at")
    return r.select("user_id", "n", F.round("spread", 6).alias("spread"), (F.col("spread") <= 0.9).alias("regular"))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by part number as a profile of densities for each brand."""
    p = read(spark, sf_dir, "part")
    return p.select("p_brand", "p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")).cast("long").alias("i"), F.when(F.col("p_size") < 30, 0.0).otherwise(F.col("p_size") / 50.0).alias("v"))


def w5_low_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.low_runs(_profile(spark, sf_dir), "p_brand", "i", "v", 0.02, 3)


def w6_sliding_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.sliding_minimum(_profile(spark, sf_dir), "p_brand", "i", "v", 3, F.col("i").between(5, 40))


def w3_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _times(spark, sf_dir)
    return t.select("event_id", (F.col("at") - F.lag("at").over(W.partitionBy("user_id").orderBy("at", "event_id"))).alias("step"))


def _boxes(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """Boxes on 40 pages from part keys and sizes."""
    p = read(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == odd)
    x, y = (F.col("p_partkey") * 37) % 1000, (F.col("p_partkey") * 91) % 800
    return p.select((F.col("p_partkey") % 40).alias("page_id"), F.col("p_partkey").alias("box"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size") * 3).alias("x1"), (y + F.col("p_size") * 2).alias("y1"))


def j13_bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = lambda odd: _boxes(spark, sf_dir, odd).withColumn("page_id", F.expr("page_id div 2"))
    return regions.overlaps(pages(0), pages(1)).select("page_id", "box", "o_box")


def j15_unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = _sizes(spark).crossJoin(spark.range(20).withColumnRenamed("id", "p")).where("page_id = 1").select(F.col("p").alias("page_id"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(500).alias("x1"), F.lit(400).alias("y1"))
    return regions.unclaimed(_boxes(spark, sf_dir, 0), areas).select("page_id", "box")


def a14_cluster_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir, 0).groupBy("page_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def a15_content_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("d"), F.count_if(F.col("l_returnflag") == "R").alias("t"))
    return l.select("l_orderkey", regions.content_hint(F.col("d"), F.col("t")).alias("hint"))


def p12_border_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir, 1)
    spans = regions.spans_page(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(100.0), F.lit(70.0))
    return b.select("box", spans.alias("spans"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= 1000 * 800 * regions.FRAME_AREA).cast("boolean").alias("frame"))


def p11_vector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.range(40).select(F.col("id").alias("page_id"), (F.col("id") % 3).alias("n_images"))
    return regions.vector_pages(_boxes(spark, sf_dir, 0), pages)


def _items(spark: SparkSession) -> DataFrame:
    """One page with an even grid, one with an uneven one, one with lines that nothing crosses."""
    rows = []
    for i in range(5):
        rows += [(1, "l", 100.0, 100.0 + 50 * i, 600.0, 100.0 + 50 * i), (1, "l", 100.0 + 125 * i, 100.0, 100.0 + 125 * i, 300.0), (2, "l", 0.0, float(i**3), 500.0, float(i**3)), (2, "l", 100.0 * i, 0.0, 100.0 * i, 90.0), (3, "l", 0.0, 30.0 * i, 90.0, 30.0 * i), (1, "l", 10.0 * i, 5.0, 10.0 * i + 40, 45.0)]
    return spark.createDataFrame(rows, "page_id long, shape string, x1 double, y1 double, x2 double, y2 double")


def e6_table_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.table_grids(_items(spark), spark.createDataFrame([(k, 792.0) for k in (1, 2, 3)], "page_id long, height_pt double"))


def e10_merge_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged boxes of each page. They stand in one row, where SQL can say what merging comes to."""
    b = _boxes(spark, sf_dir, 0).withColumn("y0", F.lit(0)).withColumn("y1", F.lit(10))
    return regions.merge_page_boxes(b, 20.0)


def t7_topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir, 0).select("page_id", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    return regions.largest(b, 12)


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return regions.drawn_pages(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id")))


def e7_image_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of drawn pages by pixels alone: dark fields where there are some, else tiles."""
    return regions.image_regions(_drawn(spark, sf_dir)).select("page_id", "x", "y", "width", "height", "region_type")


def e8_content_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles cut at the least content, of blank pages: the first places of the windows around even cuts."""
    got = regions.image_regions(_drawn(spark, sf_dir).where("page_id % 3 = 2"), "content_aware")
    return got.where("region_type <> 'full_page'").select("page_id", "x", "y", "width", "height", "region_type")


def e14_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".png", ".doc", "", ".tif")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return etl.dispatch(d.select("doc_id", F.concat(F.lit("f"), "doc_id", ext).alias("filename"))).select("doc_id", "processor", "error")


def _render(content: bytes) -> list[tuple[bytes, str]]:
    if content.startswith(b"bad"):
        raise ValueError("encrypted")
    return [(bytes([i]) + content[:8], part.decode()) for i, part in enumerate(content.split(b"\f"))]


def e1_page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of pages; every ninth can't be read."""
    d = read(spark, sf_dir, "documents")
    content = F.concat(F.when(F.col("doc_id") % 9 == 0, F.lit("bad")).otherwise(F.lit("ok ")), F.col("text"), F.lit("\f"))
    named = d.select(F.concat(F.lit("File "), "doc_id", F.lit(".pdf")).alias("filename"), content.cast("binary").alias("content"))
    return etl.page_documents(etl.pages(named, _render)).select("title", "page_number", F.length("text").cast("long").alias("n"), F.length("snippet").cast("long").alias("n_snippet"))


def e3_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page vectors of a stand-in encoder, packed; their count and the positive signs by both forms."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    e = etl.embed(d, etl.hashed_model(16, 3))
    ones = F.aggregate("vectors", F.lit(0), lambda a, v: a + F.size(F.filter(v, lambda x: x > 0)))
    bits = F.aggregate("packed", F.lit(0), lambda a, p: a + F.aggregate(p, F.lit(0), lambda b, x: b + F.bit_count(x.bitwiseAND(F.lit(255)))))
    return e.select("doc_id", F.size("vectors").cast("long").alias("patches"), (ones == bits).alias("agree"))


def w8_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last events of each user, one of a type, newest first, three at most."""
    e = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("last").desc()))
    return e.withColumn("place", r.cast("long")).where("place <= 3")


def w1_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the best orders: the limit comes first, so the window has that many rows."""
    top = read(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(W.orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long").alias("place"))


def t11_largest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars")).orderBy(F.col("chars").desc(), "source").limit(5)


def u5_full_page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with the whole page before them."""
    whole = _sizes(spark).select("page_id", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "width", "height", F.lit("full_page").alias("label"))
    return whole.unionByName(regions.tiles(_sizes(spark)))


_TILES = "t AS (SELECT page_id, width, height, greatest(1, CAST(ceil((width - 100) / 1700.0) AS INT)) AS nx, greatest(1, CAST(ceil((height - 100) / 1700.0) AS INT)) AS ny FROM (VALUES {v}) AS s(page_id, width, height)), g AS (SELECT t.*, r.range AS row, c.range AS col FROM t, range(10) r, range(10) c WHERE r.range < ny AND c.range < nx), xy AS (SELECT *, CASE WHEN nx > 1 THEN CAST(trunc(col * ((width - 1800)::DOUBLE / (nx - 1))) AS BIGINT) ELSE 0 END AS x, CASE WHEN ny > 1 THEN CAST(trunc(row * ((height - 1800)::DOUBLE / (ny - 1))) AS BIGINT) ELSE 0 END AS y FROM g), tiles AS (SELECT CAST(page_id AS BIGINT) AS page_id, x, y, CAST(least(1800, width - x) AS BIGINT) AS width, CAST(least(1800, height - y) AS BIGINT) AS height, 'tile_r' || row || '_c' || col AS label FROM xy WHERE least(1800, width - x) >= 200 AND least(1800, height - y) >= 200 AND least(1800, width - x) * least(1800, height - y) >= 100000)".format(v=", ".join(map(str, SIZES)))
_AT = "e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS tm FROM events)"
_PROFILE = "p AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, CASE WHEN p_size < 30 THEN 0.0::DOUBLE ELSE p_size / 50.0::DOUBLE END AS v FROM part)"


def _boxes_sql(odd: int) -> str:
    return f"SELECT p_partkey % 40 AS page_id, p_partkey AS box, p_partkey * 37 % 1000 AS x0, p_partkey * 91 % 800 AS y0, p_partkey * 37 % 1000 + p_size * 3 AS x1, p_partkey * 91 % 800 + p_size * 2 AS y1 FROM part WHERE p_partkey % 2 = {odd}"


ORACLES = {
    "p8_large_pages": "SELECT CAST(page_id AS BIGINT) AS page_id, w * h > 2800000 AS large, w >= 200 AND h >= 200 AND w * h >= 100000 AS enough FROM (VALUES {v}) AS s(page_id, w, h)".format(v=", ".join(map(str, SIZES))),
    "e9_tiles": f"WITH {_TILES} SELECT * FROM tiles",
    "w4_gap_clusters": f"WITH {_AT}, n AS (SELECT *, CASE WHEN tm - lag(tm) OVER w >= 36000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id)), c AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS BIGINT) AS cluster FROM n) SELECT user_id, cluster, min(tm) AS first, max(tm) AS last, count(*) AS n FROM c GROUP BY user_id, cluster",
    "a13_regularity": f"WITH {_AT}, d AS (SELECT DISTINCT user_id, tm FROM e), s AS (SELECT user_id, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm) AS step FROM d) SELECT user_id, count(*) AS n, round(stddev_pop(step) / avg(step), 6) AS spread, stddev_pop(step) / avg(step) <= 0.9 AS regular FROM s GROUP BY user_id",
    "w5_low_runs": f"WITH {_PROFILE}, r AS (SELECT *, v < 0.02 AS low, max(i) OVER (PARTITION BY p_brand) AS edge, i - row_number() OVER (PARTITION BY p_brand, v < 0.02 ORDER BY i) AS island FROM p) SELECT p_brand, min(i) + count(*) // 2 AS split FROM r WHERE low GROUP BY p_brand, island HAVING count(*) >= 3 AND max(i) < max(edge)",
    "w6_sliding_min": f"WITH {_PROFILE}, m AS (SELECT p_brand, i, round(avg(v) OVER (PARTITION BY p_brand ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 9) AS mean FROM p) SELECT p_brand, i FROM m WHERE i BETWEEN 5 AND 40 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY mean, i) = 1",
    "w3_differences": f"WITH {_AT} SELECT event_id, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS step FROM e",
    "j13_bbox_overlap": f"WITH a AS ({_boxes_sql(0)}), b AS ({_boxes_sql(1)}) SELECT a.page_id // 2 AS page_id, a.box, b.box AS o_box FROM a JOIN b ON a.page_id // 2 = b.page_id // 2 AND b.x0 < a.x1 AND b.x1 > a.x0 AND b.y0 < a.y1 AND b.y1 > a.y0",
    "j15_unclaimed": f"SELECT page_id, box FROM ({_boxes_sql(0)}) WHERE NOT (page_id < 20 AND x0 >= -5 AND y0 >= -5 AND x1 <= 505 AND y1 <= 405)",
    "a14_cluster_boxes": f"SELECT page_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({_boxes_sql(0)}) GROUP BY page_id",
    "a15_content_hints": "SELECT l_orderkey, CASE WHEN t / nullif(d + t, 0) > 0.7 THEN 'notes' WHEN t / nullif(d + t, 0) < 0.3 THEN 'drawing_view' ELSE 'detail' END AS hint FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS d, count(*) FILTER (l_returnflag = 'R') AS t FROM lineitem GROUP BY l_orderkey)",
    "p12_border_boxes": f"SELECT box, x1 - x0 > 85 AND y1 - y0 > 59.5 AS spans, (x1 - x0) * (y1 - y0) >= 16000 AS frame FROM ({_boxes_sql(1)})",
    "p11_vector_pages": f"SELECT page_id, page_id % 3 AS n_images FROM (SELECT page_id, count(*) AS n FROM ({_boxes_sql(0)}) GROUP BY page_id) WHERE n >= 10 AND NOT (page_id % 3 = 1 AND n < 20)",
    "e6_table_grids": "SELECT CAST(1 AS BIGINT) AS page_id, 100.0::DOUBLE AS x0, 100.0::DOUBLE AS y0, 600.0::DOUBLE AS x1, 300.0::DOUBLE AS y1",
    "e10_merge_boxes": f"WITH b AS ({_boxes_sql(0)}), m AS (SELECT *, max(x1) OVER (PARTITION BY page_id ORDER BY x0, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b), g AS (SELECT *, sum(CASE WHEN x0 - 20 <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY x0, box) AS run FROM m) SELECT page_id, CAST(min(x0) AS DOUBLE) AS x0, 0.0::DOUBLE AS y0, CAST(max(x1) AS DOUBLE) AS x1, 10.0::DOUBLE AS y1 FROM g GROUP BY page_id, run",
    "t7_topn_per_group": f"SELECT page_id, x0 AS x, y0 AS y, x1 - x0 AS width, y1 - y0 AS height FROM ({_boxes_sql(0)}) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY (x1 - x0) * (y1 - y0) DESC, x0, y0) <= 12",
    "e7_image_regions": "SELECT CAST(n_nationkey AS BIGINT) AS page_id, x, y, w AS width, h AS height, t AS region_type FROM nation, (VALUES (1, 0, 0, 2000, 2000, 'full_page'), (1, 50, 50, 1950, 950, 'detected'), (1, 50, 1000, 1950, 1000, 'detected'), (9, 0, 0, 2000, 2000, 'full_page'), (9, 0, 0, 1800, 1800, 'tile'), (9, 200, 0, 1800, 1800, 'tile'), (9, 0, 200, 1800, 1800, 'tile'), (9, 200, 200, 1800, 1800, 'tile')) AS r(k, x, y, w, h, t) WHERE k = CASE n_nationkey % 3 WHEN 1 THEN 1 ELSE 9 END",
    "e8_content_tiles": "WITH c AS (SELECT * FROM (VALUES (0, 626), (626, 667), (1293, 707)) AS c(a, n)) SELECT CAST(n_nationkey AS BIGINT) AS page_id, a.a AS x, b.a AS y, a.n AS width, b.n AS height, 'content_tile' AS region_type FROM nation, c a, c b WHERE n_nationkey % 3 = 2",
    "e14_dispatch": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 4 THEN 'image' ELSE 'unsupported' END AS processor, CASE doc_id % 5 WHEN 2 THEN 'Unsupported file type: doc' WHEN 3 THEN 'Unsupported file type: none' END AS error FROM documents",
    "e1_page_documents": "WITH d AS (SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) + 3 AS n FROM documents WHERE doc_id % 9 <> 0) SELECT 'File ' || doc_id AS title, CAST(1 AS BIGINT) AS page_number, n, CASE WHEN n > 200 THEN 203 ELSE n END AS n_snippet FROM d UNION ALL SELECT 'File ' || doc_id, 2, 0, length('Page 2 of File ' || doc_id || '.pdf') FROM d",
    "e3_embed": "SELECT doc_id, CAST(3 AS BIGINT) AS patches, true AS agree FROM documents",
    "w8_recency": "SELECT user_id, event_type, max(event_id) AS last, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS place FROM events GROUP BY user_id, event_type QUALIFY place <= 3",
    "w1_rank": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 100",
    "t11_largest_sources": "SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source ORDER BY chars DESC, source LIMIT 5",
    "u5_full_page_first": f"WITH {_TILES} SELECT CAST(page_id AS BIGINT) AS page_id, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, 'full_page' AS label FROM t UNION ALL SELECT * FROM tiles",
}
QUERIES = {name: globals()[name] for name in ORACLES}
