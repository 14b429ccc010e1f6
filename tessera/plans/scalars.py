"""Queries of the scalar functions: strings, time, arithmetic, arrays and JSON, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import nested, strings, vectors
from tessera.sources.tables import read

NAMES = ("projects", "companies", "address", "category", "class", "staff")


def _values(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")


def f1_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(strings.sanitize(F.concat(F.col("text"), F.lit("\x01\t\x7f"))).cast("binary")).alias("clean_md5"))


def f2_slug_docid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", strings.slug(F.col("text")).alias("slug"), strings.page_doc_id(F.col("text"), F.col("text"), F.lit(1)).alias("page_doc_id"))


def f5_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("t", F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.col("text")))
    return d.select("doc_id", strings.snippet(F.col("t"), F.col("doc_id"), F.lit("a.pdf")).alias("snippet"), strings.snippet(F.col("t"), F.col("doc_id"), F.lit("a.pdf"), F.col("source")).alias("labelled"))


def f7_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, "a/b/IMG_1128.JPG", "report.pdf", "no_extension", "x.tar.gz", "dir.d/file", "trailing/", ".hidden")
    return v.select("v", strings.basename(F.col("v")).alias("base"), strings.extension(F.col("v")).alias("ext"), strings.stem(F.col("v")).alias("stem"))


def f9_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", strings.without_stop_words(F.col("text")).alias("kept"))


def f10_content_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    blank = F.when(F.col("c_custkey") % 3 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), F.col("c_mktsegment")))
    return c.select("c_custkey", strings.content_text([F.col("c_name"), blank, F.lit(None).cast("string")]).alias("content_text"))


def f11_relationship_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, *NAMES, "project_id", "ids_id")
    return v.select("v", strings.outgoing_type(F.col("v")).alias("outgoing"), strings.incoming_type(F.col("v")).alias("incoming"))


def f12_plural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, "project", "company", "address", "category", "staff").select("v", strings.plural(F.col("v")).alias("plural"))


def f14_s3_key_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, "562/565/photos/56/IMG.jpg", "a/b/c", "1/2/x y/3/z", "1/2/é/3/z", "1/2/p/3/").select("v", strings.s3_key_shape(F.col("v")).alias("ok"))


def f15_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheme, host, name = strings.url_parts(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", scheme.alias("scheme"), host.alias("host"), name.alias("file"))


def f16_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(strings.redact(F.col("text")).cast("binary")).alias("redacted_md5"))


def f18_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, " a, b ,,c ", "", "ON", "true", "1", "Yes", "no", "x\ny")
    return v.select("v", F.to_json(strings.tags(F.col("v"))).alias("tags"), strings.truthy(F.col("v")).alias("flag"), strings.line_breaks(F.col("v")).alias("html"))


def f22_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", strings.ellipsis(F.col("c_name"), 10).alias("short"), strings.initials(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("initials"), strings.counted(F.col("c_custkey") % 3, "file").alias("files"))


def f22_relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("event_id", strings.relative_date(at, F.lit(1_706_659_140)).alias("shown"))


def f23_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(strings.highlight(F.col("text"), "the|token").cast("binary")).alias("marked_md5"))


def f24_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, "```json\n[1]\n```", "[1]", "  ```\nx\n```  ").select("i", strings.without_fences(F.col("v")).alias("body"))


def d1_epoch_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderkey") % 1000).alias("seconds"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("text"))
    ms = nested.epoch_millis(o, "seconds")
    return o.select("o_orderkey", nested.epoch_millis(o, "o_orderdate").alias("from_time"), ms.alias("from_number"), nested.epoch_millis(o, "text").alias("from_text"), nested.or_now(ms, 99).alias("or_now"))


def d3_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("t", F.expr("ts + make_dt_interval(0, 0, 0, (event_id % 3) * 0.25)"))
    return e.select("event_id", nested.iso(F.col("t")).alias("iso"))


def d5_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    ms = nested.epoch_millis(e, "ts")
    return e.select("event_id", F.round(nested.freshness(ms, 1_735_689_600_000), 6).alias("freshness"))


def d6_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("user_id", F.expr("timestampdiff(SECOND, a, b)").alias("seconds"))


def m10_grid_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1100).where("id < 1024").select(F.col("id").alias("patch"), F.expr("id div 32").alias("row"), (F.col("id") % 32).alias("col"))


def m11_scale_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to pixels, truncated, inside the page; with the crop that padding makes of it."""
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 700).cast("double").alias("x0"), F.col("p_size").cast("double").alias("w"))
    x = F.least(F.greatest((F.col("x0") * 1275.0 / 612.0).cast("long"), F.lit(0)), F.lit(1275).cast("long"))
    w = F.least((F.col("w") * 1275.0 / 612.0).cast("long"), 1275 - x)
    return p.select("p_partkey", x.alias("x"), w.alias("w"), F.greatest(x - 20, F.lit(0)).alias("crop0"), F.least(x + w + 20, F.lit(1275)).alias("crop1"), F.least(F.lit(1.0), F.col("w") / 100 * 10).alias("confidence"))


def m7_inverse_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(64).select(F.col("id").alias("distance"), F.round(vectors.inverse_distance(F.col("id")), 6).alias("similarity"))


def m2_unpack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed bytes unpacked again: the signs."""
    v = read(spark, sf_dir, "embeddings")
    bits = vectors.unpack_bits(vectors.pack_bits(F.col("embedding"), 64), pm1=True)
    return v.select("vec_id", F.posexplode(bits).alias("dim", "sign")).select("vec_id", F.col("dim").cast("long").alias("dim"), "sign")


def c1_row_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))).withColumn("late", F.col("o_orderkey") % 2 == 0)
    m = nested.row_map(o, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "late"])
    return o.select("o_orderkey", F.explode(m).alias("field", "value"))


def c2_json_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("props", F.when(F.col("event_id") % 7 == 0, F.lit("not json")).when(F.col("event_id") % 7 == 1, F.lit('["a"]')).when(F.col("event_id") % 7 == 2, F.lit('{"x": null, "y": "", "z": "k"}')).otherwise(F.col("props")))
    return e.select("event_id", F.explode(nested.key_map(F.col("props"))).alias("e")).select("event_id", F.col("e.key").alias("file_id"), F.col("e.value").alias("s3_key"))


def c3_struct_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs to JSON strings and back; empty optional fields are left out."""
    c = read(spark, sf_dir, "customer")
    js = F.to_json(F.struct(F.col("c_name").alias("name"), F.nullif(F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.col("c_mktsegment")), F.lit("")).alias("segment")))
    back = F.from_json(js, "name string, segment string")
    return c.select("c_custkey", js.alias("json"), back["name"].alias("name"), back["segment"].alias("segment"))


def c6_blocks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks keyed by numbers as text, which sort as numbers."""
    v = read(spark, sf_dir, "embeddings")
    m = v.groupBy(F.expr("vec_id div 12").alias("page")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("vec_id") % 12).cast("string").alias("k"), F.col("label").cast("long").alias("v")))).alias("blocks"))
    return m.select("page", F.array_join(nested.blocks_in_order(F.col("blocks")), ",").alias("labels"))


def c8_column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame([("a", "id", "bigint"), ("a", "name", "text"), ("b", "id", "bigint")], "t string, c string, k string")
    return c.groupBy("t").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "k"))))).alias("types"))


def c10_nested_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    got = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    return e.select("event_id", got.alias("k"), F.coalesce(F.get_json_object("props", "$.a.b"), F.lit("none")).alias("b"))


def c11_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return c.select("conv_id", F.array_join(F.flatten(F.array("turns", F.array(F.lit(-1).cast("long")))), ",").alias("turns"))


def c12_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("b", F.base64(F.col("c_name").cast("binary")))
    return c.select("c_custkey", "b", F.unbase64("b").cast("string").alias("back"))


def p17_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.where(F.col("url").like("http://%/en/%") & F.col("html").isNotNull()).select("page_id")


def t10_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", *[F.length(F.substring("text", 1, n)).cast("long").alias(f"n{n}") for n in (200, 300, 500)])


_STOP = ", ".join(f"'{w}'" for w in strings.STOP_WORDS)
_SLUG = "coalesce(nullif(lower(regexp_replace(substr(regexp_replace(text, '[^a-zA-Z0-9]', '_', 'g'), 1, 30), '^_+|_+$', '', 'g')), ''), 'document')"
_SNIP = "CASE WHEN length(t) = 0 THEN 'Page ' || doc_id || ' of a.pdf' WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END"


# Twice, as neighbours share the character between them; what is marked isn't marked again.
_MARK = r"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}>])(the|token)($|[^\p{{L}}\p{{N}}<])', '\1<strong>\2</strong>\3', 'gi')"


def _redacted(c: str) -> str:
    for p in strings.REDACTIONS:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '\\1[REDACTED]', 'gi')"
    return c


ORACLES = {
    "f1_sanitize": "SELECT doc_id, md5(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') || chr(9)) AS clean_md5 FROM documents",
    "f2_slug_docid": f"SELECT doc_id, {_SLUG} AS slug, {_SLUG} || '_' || substr(md5(text), 1, 12) || '_page_1' AS page_doc_id FROM documents",
    "f5_snippet": f"SELECT doc_id, {_SNIP} AS snippet, '[' || source || '] ' || {_SNIP} AS labelled FROM (SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS t FROM documents)",
    "f7_file_names": "SELECT * FROM (VALUES ('a/b/IMG_1128.JPG', 'IMG_1128.JPG', 'jpg', 'a/b/IMG_1128'), ('report.pdf', 'report.pdf', 'pdf', 'report'), ('no_extension', 'no_extension', NULL, 'no_extension'), ('x.tar.gz', 'x.tar.gz', 'gz', 'x.tar'), ('dir.d/file', 'file', 'd/file', 'dir'), ('trailing/', '', NULL, 'trailing/'), ('.hidden', '.hidden', 'hidden', '.hidden')) AS t(v, base, ext, stem)",
    "f9_stopwords": f"SELECT conv_id, turn, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE text END AS kept FROM (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '' AND lower(w) NOT IN ({_STOP})) AS k FROM conversations)",
    "f10_content_text": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || ' ' || c_mktsegment END AS content_text FROM customer",
    "f11_relationship_types": "SELECT v, regexp_replace(v, '_id$', '') AS outgoing, rtrim(v, 's') AS incoming FROM (VALUES ('projects'), ('companies'), ('address'), ('category'), ('class'), ('staff'), ('project_id'), ('ids_id')) AS t(v)",
    "f12_plural": "SELECT * FROM (VALUES ('project', 'projects'), ('company', 'companies'), ('address', 'addresses'), ('category', 'categories'), ('staff', 'staffs')) AS t(v, plural)",
    "f14_s3_key_shape": "SELECT * FROM (VALUES ('562/565/photos/56/IMG.jpg', true), ('a/b/c', false), ('1/2/x y/3/z', false), ('1/2/é/3/z', true), ('1/2/p/3/', false)) AS t(v, ok)",
    "f15_url_parts": "SELECT page_id, nullif(regexp_extract(url, '^([a-z]+)://', 1), '') AS scheme, nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '') AS host, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([^/]*)$', 1) AS file FROM pages",
    "f16_redact": f"SELECT doc_id, md5({_redacted('text')}) AS redacted_md5 FROM documents",
    "f18_form_fields": "SELECT v, CASE v WHEN ' a, b ,,c ' THEN '[\"a\",\"b\",\"c\"]' WHEN '' THEN '[]' WHEN 'x' || chr(10) || 'y' THEN '[\"x\\ny\"]' ELSE '[\"' || v || '\"]' END AS tags, lower(trim(v)) IN ('on', 'true', '1', 'yes') AS flag, replace(v, chr(10), '<br>') AS html FROM (VALUES (' a, b ,,c '), (''), ('ON'), ('true'), ('1'), ('Yes'), ('no'), ('x' || chr(10) || 'y')) AS t(v)",
    "f22_display": "SELECT c_custkey, CASE WHEN length(c_name) > 10 THEN left(c_name, 9) || '…' ELSE c_name END AS short, upper(left(c_mktsegment, 1) || left(c_name, 1)) AS initials, (c_custkey % 3) || ' file' || CASE WHEN c_custkey % 3 = 1 THEN '' ELSE 's' END AS files FROM customer",
    "f22_relative_dates": "SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 604800 THEN (s // 86400) || 'd ago' ELSE strftime(ts, '%b %-d') END AS shown FROM (SELECT event_id, ts, 1706659140 - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)",
    "f23_highlight": f"SELECT doc_id, md5({_MARK.format(t=_MARK.format(t='text'))}) AS marked_md5 FROM documents",
    "f24_fences": "SELECT CAST(i AS BIGINT) AS i, b AS body FROM (VALUES (0, '[1]'), (1, '[1]'), (2, 'x')) AS t(i, b)",
    "d1_epoch_millis": "SELECT o_orderkey, epoch_ms(o_orderdate) AS from_time, (o_orderkey % 1000) * 1000 AS from_number, epoch_ms(date_trunc('second', o_orderdate)) AS from_text, CASE WHEN o_orderkey % 1000 = 0 THEN 99 ELSE (o_orderkey % 1000) * 1000 END AS or_now FROM orders",
    "d3_iso": "SELECT event_id, strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(t) % 1000000 = 0 THEN '' ELSE strftime(t, '.%f') END AS iso FROM (SELECT event_id, ts + to_microseconds((event_id % 3) * 250000) AS t FROM events)",
    "d5_freshness": "SELECT event_id, round(greatest(0, 1 - greatest(1735689600000 - epoch_ms(ts), 0) / (1000.0::DOUBLE * 7776000)), 6) AS freshness FROM events",
    "d6_durations": "SELECT user_id, CAST(floor(epoch(max(ts) - min(ts))) AS BIGINT) AS seconds FROM events GROUP BY user_id",
    "m10_grid_places": "SELECT range AS patch, range // 32 AS row, range % 32 AS col FROM range(1024)",
    "m11_scale_clamp": "SELECT p_partkey, x, least(CAST(trunc(w0 * 1275.0::DOUBLE / 612.0) AS BIGINT), 1275 - x) AS w, greatest(x - 20, 0) AS crop0, least(x + least(CAST(trunc(w0 * 1275.0::DOUBLE / 612.0) AS BIGINT), 1275 - x) + 20, 1275) AS crop1, least(1.0::DOUBLE, w0 / 100 * 10) AS confidence FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w0, least(greatest(CAST(trunc((p_partkey % 700)::DOUBLE * 1275.0::DOUBLE / 612.0) AS BIGINT), 0), 1275) AS x FROM part)",
    "m7_inverse_distance": "SELECT range AS distance, round(1.0::DOUBLE / (range + 1), 6) AS similarity FROM range(64)",
    "m2_unpack_bits": "SELECT vec_id, d - 1 AS dim, CASE WHEN embedding[d] > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS d FROM embeddings)",
    "c1_row_map": "SELECT o_orderkey, field, value FROM (SELECT o_orderkey, 'o_orderkey' AS field, CAST(o_orderkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders UNION ALL SELECT o_orderkey, 'o_orderstatus', CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END FROM orders UNION ALL SELECT o_orderkey, 'o_orderdate', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders UNION ALL SELECT o_orderkey, 'late', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END FROM orders) WHERE value IS NOT NULL",
    "c2_json_map_explode": "SELECT event_id, 'z' AS file_id, 'k' AS s3_key FROM events WHERE event_id % 7 = 2 UNION ALL SELECT event_id, 'k', json_extract_string(props, '$.k') FROM events WHERE event_id % 7 > 2 AND json_extract_string(props, '$.k') <> ''",
    "c3_struct_json": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{\"name\":\"' || c_name || '\"}' ELSE '{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}' END AS json, c_name AS name, CASE WHEN c_custkey % 2 <> 0 THEN c_mktsegment END AS segment FROM customer",
    "c6_blocks_in_order": "SELECT vec_id // 12 AS page, string_agg(CAST(label AS VARCHAR), ',' ORDER BY vec_id) AS labels FROM embeddings GROUP BY vec_id // 12",
    "c8_column_types": "SELECT * FROM (VALUES ('a', '{\"id\":\"bigint\",\"name\":\"text\"}'), ('b', '{\"id\":\"bigint\"}')) AS t(t, types)",
    "c10_nested_default": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.a.b'), 'none') AS b FROM events",
    "c11_flatten": "SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) || ',-1' AS turns FROM conversations GROUP BY conv_id",
    "c12_base64": "SELECT c_custkey, to_base64(encode(c_name)) AS b, c_name AS back FROM customer",
    "p17_like": "SELECT page_id FROM pages WHERE url LIKE 'http://%/en/%' AND html IS NOT NULL",
    "t10_truncate": "SELECT doc_id, length(left(text, 200)) AS n200, length(left(text, 300)) AS n300, length(left(text, 500)) AS n500 FROM documents",
}
QUERIES = {name: globals()[name] for name in ORACLES}
ORACLES = {name: sql for name, sql in ORACLES.items() if sql}
