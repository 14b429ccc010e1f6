"""Queries of the parts that retrieval and its profiles are made of, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions import nested, strings, vectors
from tessera.operators import retrieval as r
from tessera.operators import text_index
from tessera.plans.ingestion import _catalog
from tessera.plans.retrieval import _ANN, _B01, _BSIM, _CROSS, _CUBE, _DIST, _DOT, DIMS, TERMS, _bm25_sql, _maxsim_sql, _six, patches, tokens
from tessera.sources.tables import read


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as search hits: a relevance with many equals, and a score of a language model for some."""
    o = read(spark, sf_dir, "orders")
    llm = F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 11).cast("double"))
    return o.select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 97).cast("double").alias("score"), llm.alias("llm_score"))


def j11_candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are near for any token, and for how many they are."""
    p, t = patches(spark, sf_dir), tokens(spark, sf_dir)
    distance = p.join(r.query_tokens(t)).groupBy("page", "tok").agg(F.min(r.bit_distance(DIMS)).alias("distance"))
    rank = F.row_number().over(W.partitionBy("tok").orderBy("distance", "page"))
    return distance.withColumn("r", rank).where("r <= 20").groupBy("page").agg(F.count("*").alias("tokens"))


def u1_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of vectors or of words, each once."""
    near = r.ann_candidates(patches(spark, sf_dir), tokens(spark, sf_dir), 10, DIMS)
    words = text_index.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", TERMS).select(F.col("doc_id").alias("page"))
    return near.unionByName(words).distinct()


def r3_lexical_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return text_index.bm25(d, "doc_id", "text", ["secret"]).select("doc_id")


def w2_topn_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each token the nearest pages, in order."""
    p, t = patches(spark, sf_dir), tokens(spark, sf_dir)
    distance = p.join(r.query_tokens(t)).groupBy("page", "tok").agg(F.min(r.bit_distance(DIMS)).cast("long").alias("distance"))
    rank = F.row_number().over(W.partitionBy("tok").orderBy("distance", "page")).cast("long")
    return distance.withColumn("place", rank).where("place <= 10")


def a9_cube_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page the least and greatest cell of its cube."""
    cells = patches(spark, sf_dir).join(r.whole_query(tokens(spark, sf_dir))).select("page", r.sign_similarity(False).alias("s"))
    return _six(cells.groupBy("page").agg(F.min("s").alias("low"), F.max("s").alias("high")), "low", "high")


def a10_distinct_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of all conversations, each once."""
    c = read(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    asked = c.groupBy("conv_id").agg(F.collect_list("text").alias("questions"))
    return asked.select(F.explode("questions").alias("question")).distinct()


def m5_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = patches(spark, sf_dir).join(r.whole_query(tokens(spark, sf_dir)))
    return _six(cells.select("page", "patch", "tok", r.float_similarity().alias("dot")), "dot")


def m6_maxsim_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxSim of all pages; one without patches has 0."""
    p, t = patches(spark, sf_dir), tokens(spark, sf_dir)
    scores = r.maxsim(p.where("page % 4 <> 1"), t, r.float_similarity())
    return _six(p.select("page").distinct().join(scores, "page", "left").select("page", F.coalesce("score", F.lit(0.0)).alias("score")), "score")


def t1_second_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred by signs, all of them scored again."""
    return _six(r.two_phase(patches(spark, sf_dir), tokens(spark, sf_dir), DEFAULT.rerank_count, DEFAULT.rerank_count, DIMS), "score")


def t2_default_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.top(_hits(spark, sf_dir), DEFAULT.default_hits).select("page", "score")


def t3_rerank_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty are fetched, five kept after the rerank."""
    some = r.top(_hits(spark, sf_dir), DEFAULT.app_rerank_fetch).select("page", (-F.col("page")).cast("double").alias("score"))
    return r.top(some, DEFAULT.app_rerank_keep)


def t4_final_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asked number of hits, five at most, for each of several requests."""
    asked = spark.createDataFrame([(n,) for n in (1, 3, 5, 8)], "asked long")
    top = r.top(_hits(spark, sf_dir), DEFAULT.app_rerank_keep).select("page", "score")
    place = F.row_number().over(W.orderBy(F.desc("score"), "page"))  # over five rows
    return asked.join(F.broadcast(top.withColumn("place", place))).where(F.col("place") <= F.least("asked", F.lit(DEFAULT.app_rerank_keep))).select("asked", "page")


def t5_stable_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the best hits; equals keep the order of their ids."""
    top = r.top(_hits(spark, sf_dir), 50)
    return top.select("page", F.row_number().over(W.orderBy(F.desc("score"), "page")).cast("long").alias("place"))  # over 50 rows


def t6_llm_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by a model's score, then by place; without a score as 0."""
    h = _hits(spark, sf_dir).withColumnRenamed("page", "pos")
    return r.llm_rerank(h.select("pos"), h.where("llm_score IS NOT NULL").select("pos", "llm_score"), 15)


def t9_suggestions_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    return r.suggestions(c.groupBy("conv_id").agg(F.collect_list("text").alias("questions")), "the", 6)


def r1_packed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of a hundred tokens: its packed side is cut, its floats are not."""
    v = read(spark, sf_dir, "embeddings").where("vec_id < 100")
    t = v.select(F.col("vec_id").alias("tok"), F.col("embedding").alias("q_vec"), vectors.pack_longs(F.col("embedding"), DIMS).alias("q_bin"))
    packed, whole = r.query_tokens(t).select(F.lit("packed").alias("side"), "tok"), r.whole_query(t).select(F.lit("floats").alias("side"), "tok")
    return packed.unionByName(whole).groupBy("side").agg(F.count("*").alias("n"), F.max("tok").alias("last"))


def r5_hybrid_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid profile's second phase over its first hundred pages: signs plus twice the words' score."""
    p, t = patches(spark, sf_dir), tokens(spark, sf_dir)
    sim = r.two_phase(p, t, DEFAULT.rerank_count, DEFAULT.rerank_count, DIMS)
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text").join(F.broadcast(sim.select("page")), "page", "left_semi")
    words = text_index.bm25(d, "page", "text", TERMS).withColumnRenamed("score", "lexical")
    both = sim.join(words, "page", "left").select("page", (F.col("score") + 2 * F.coalesce("lexical", F.lit(0.0))).alias("score"))
    return _six(r.top(both.select("page", F.round("score", 6).alias("score")), 10), "score")


def r7_sim_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile with maps: the cubes of its hits alone."""
    base, maps = r.parse_profile("colpali_sim")
    hits = r.two_phase(patches(spark, sf_dir), tokens(spark, sf_dir), 20, 5, DIMS).select("page")
    asked = patches(spark, sf_dir).join(F.broadcast(hits), "page", "left_semi")
    cube = r.similarity_cube(asked, tokens(spark, sf_dir))
    return cube.where(F.lit(base == "colpali" and maps))


def r10_similarity_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube to grid: of each page and token the brightest cell of the map."""
    cells = patches(spark, sf_dir).join(r.whole_query(tokens(spark, sf_dir))).select("page", "tok", "patch", r.sign_similarity(False).alias("s"))
    grid = r.similarity_grid(cells, "s", side=4, patches=8)
    best = grid.groupBy("page", "tok").agg(F.max("value").alias("value"), F.min_by(F.struct("row", "col"), F.struct(-F.round("value", 9), "row", "col")).alias("at"))
    return _six(best.select("page", "tok", "value", F.col("at.row").alias("row"), F.col("at.col").alias("col")), "value")


def r13_schema_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by the words of their columns and of their descriptions, both scores added."""
    c, _ = _catalog(spark)
    docs = c.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list(F.replace("column_name", F.lit("_"), F.lit(" ")))), " ").alias("content_text"))
    docs = docs.withColumn("table_description", F.concat(F.lit("table of "), F.replace("table_name", F.lit("_"), F.lit(" "))))
    found = text_index.bm25_fields(docs, "table_name", {"content_text": ["project", "key"], "table_description": ["orders", "photos"]})
    return _six(found.select("table_name", (F.col("score_content_text") + F.col("score_table_description")).alias("score")), "score")


def r16_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of profiles resolved to a ranking and whether maps are made."""
    rows = [(p, *r.parse_profile(p), r.profile_name(*r.parse_profile(p))) for p in ("colpali", "colpali_sim", "hybrid_sim", "bm25", "bm25_x")]
    return spark.createDataFrame(rows, "profile string, ranking string, maps boolean, again string")


def r19_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of three results: what is left after five queries, one of them asked again in between."""
    cache = r.ResultCache(3)
    ids = {q: r.ResultCache.query_id(q, "hybrid") for q in "abcde"}
    for q in "abc":
        cache.put(ids[q], q)
    cache.get(ids["a"])
    for q in "de":
        cache.put(ids[q], q)
    return spark.createDataFrame([(q, cache.get(i) is not None) for q, i in ids.items()], "query string, held boolean")


def c7_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tensor as a list of cells, each an address and a value, as rows."""
    v = read(spark, sf_dir, "embeddings")
    cells = F.to_json(F.struct(F.array(*[F.struct(F.struct(F.lit(str(k)).alias("patch")).alias("address"), F.round(F.get("embedding", F.lit(k)), 4).cast("double").alias("value")) for k in range(3)]).alias("cells")))
    return v.select("vec_id", F.explode(nested.cells(cells)).alias("c")).select("vec_id", F.col("c.address.patch").cast("long").alias("patch"), F.round("c.value", 4).alias("value"))


def c9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's scores as JSON: indices out of range and items without a score are dropped."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit('[{"index": '), F.col("o_orderkey") % 7, F.lit(', "score": 2.5}, {"index": 9, "score": 1}, {"index": 1}]')).alias("said"))
    return o.select("o_orderkey", F.explode(nested.scored(F.col("said"), 5)).alias("pos", "score"))


def f21_token_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", strings.token_text(F.concat(F.lit("▁"), "c_mktsegment", F.lit("▁x"))).alias("token"))


_HITS = "h AS (SELECT o_orderkey AS page, CAST(o_orderkey % 97 AS DOUBLE) AS score, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 11 AS DOUBLE) END AS llm_score FROM orders)"
_HEAD = f"{_CROSS}, {_maxsim_sql('one', _BSIM)}, head AS (SELECT page FROM one ORDER BY score DESC, page LIMIT {{first}}), {_maxsim_sql('two', _B01, '(SELECT * FROM x WHERE page IN (SELECT page FROM head))')}"
_NEAR = f"dist AS (SELECT page, tok, min({_DIST}) AS distance FROM x GROUP BY page, tok), near AS (SELECT page, CAST(tok AS BIGINT) AS tok, distance, row_number() OVER (PARTITION BY tok ORDER BY distance, page) AS place FROM dist)"
_C = "(SELECT DISTINCT table_name, column_name FROM (VALUES {}) AS t(table_name, column_name, kind))"


def _catalog_sql() -> str:
    from tessera.plans.ingestion import CATALOG

    return _C.format(", ".join(map(str, CATALOG)))


_DOCS = f"docs AS (SELECT table_name, string_agg(replace(column_name, '_', ' '), ' ' ORDER BY replace(column_name, '_', ' ')) AS content_text, 'table of ' || replace(table_name, '_', ' ') AS table_description FROM {_catalog_sql()} GROUP BY table_name)"

ORACLES = {
    "j11_candidate_union": f"WITH {_CROSS}, {_NEAR} SELECT page, count(*) AS tokens FROM near WHERE place <= 20 GROUP BY page",
    "u1_candidates": f"WITH {_CROSS}, {_ANN}, {_bm25_sql('s', 'documents', 'doc_id', 'text', TERMS)} SELECT page FROM near UNION SELECT k FROM s",
    "r3_lexical_candidates": f"WITH {_bm25_sql('s', 'documents', 'doc_id', 'text', ['secret'])} SELECT k AS doc_id FROM s",
    "w2_topn_per_token": f"WITH {_CROSS}, {_NEAR} SELECT page, tok, distance, place FROM near WHERE place <= 10",
    "a9_cube_range": f"WITH {_CROSS} SELECT page, round(min({_B01}), 6) AS low, round(max({_B01}), 6) AS high FROM x GROUP BY page",
    "a10_distinct_questions": "SELECT DISTINCT text AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL",
    "m5_dot": f"WITH {_CROSS} SELECT page, patch, CAST(tok AS BIGINT) AS tok, round({_DOT}, 6) AS dot FROM x",
    "m6_maxsim_empty": f"WITH {_CROSS}, {_maxsim_sql('s', _DOT)} SELECT page, CASE WHEN page % 4 = 1 THEN 0 ELSE round(score, 6) END AS score FROM s",
    "t1_second_phase": f"WITH {_HEAD.format(first=100)} SELECT page, round(score, 6) AS score FROM two",
    "t2_default_hits": f"WITH {_HITS} SELECT page, score FROM h ORDER BY score DESC, page LIMIT 3",
    "t3_rerank_fetch": f"WITH {_HITS}, f AS (SELECT page FROM h ORDER BY score DESC, page LIMIT 20) SELECT page, CAST(-page AS DOUBLE) AS score FROM f ORDER BY page LIMIT 5",
    "t4_final_hits": f"WITH {_HITS}, f AS (SELECT page, row_number() OVER (ORDER BY score DESC, page) AS place FROM h QUALIFY place <= 5) SELECT CAST(asked AS BIGINT) AS asked, page FROM f, (VALUES (1), (3), (5), (8)) AS t(asked) WHERE place <= least(asked, 5)",
    "t5_stable_sort": f"WITH {_HITS} SELECT page, row_number() OVER (ORDER BY score DESC, page) AS place FROM h QUALIFY place <= 50",
    "t6_llm_sort": f"WITH {_HITS} SELECT page AS pos, coalesce(llm_score, 0) AS llm_score FROM h ORDER BY coalesce(llm_score, 0) DESC, page LIMIT 15",
    "t9_suggestions_cap": "SELECT DISTINCT text AS question FROM conversations WHERE role = 'user' AND contains(lower(text), 'the') AND text <> 'string' ORDER BY question LIMIT 6",
    "r1_packed_query": "SELECT 'packed' AS side, CAST(64 AS BIGINT) AS n, CAST(63 AS BIGINT) AS last UNION ALL SELECT 'floats', count(*), max(vec_id) FROM embeddings WHERE vec_id < 100",
    "r5_hybrid_profile": f"WITH {_HEAD.format(first=100)}, hd AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT page FROM head)), {_bm25_sql('l', 'hd', 'doc_id', 'text', TERMS)} SELECT page, s AS score FROM (SELECT page, round(two.score + 2 * coalesce(l.score, 0), 6) AS s FROM two LEFT JOIN l ON l.k = page) ORDER BY s DESC, page LIMIT 10",
    "r7_sim_profile": f"WITH {_HEAD.format(first=20)}, hits AS (SELECT page FROM two ORDER BY score DESC, page LIMIT 5), c AS (SELECT page, tok, patch, {_B01} AS s FROM x WHERE page IN (SELECT page FROM hits)) SELECT page, CAST(tok AS BIGINT) AS tok, patch, CAST(floor((s - min(s) OVER (PARTITION BY page)) / (max(s) OVER (PARTITION BY page) - min(s) OVER (PARTITION BY page) + 0.001) * 254) AS BIGINT) AS quantised FROM c",
    "r10_similarity_maps": f"WITH {_CROSS}, c AS (SELECT page, tok, patch, {_B01} AS s FROM x), g AS (SELECT page, tok, patch, (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w + 1e-6) AS value FROM c WINDOW w AS (PARTITION BY page, tok)) SELECT page, CAST(tok AS BIGINT) AS tok, round(value, 6) AS value, patch // 4 AS row, patch % 4 AS col FROM g QUALIFY row_number() OVER (PARTITION BY page, tok ORDER BY round(value, 9) DESC, patch) = 1",
    "r13_schema_search": f"WITH {_DOCS}, {_bm25_sql('ma', 'docs', 'table_name', 'content_text', ['project', 'key'])}, {_bm25_sql('mb', 'docs', 'table_name', 'table_description', ['orders', 'photos'])} SELECT table_name, round(coalesce(ma.score, 0) + coalesce(mb.score, 0), 6) AS score FROM docs LEFT JOIN ma ON ma.k = table_name LEFT JOIN mb ON mb.k = table_name WHERE ma.k IS NOT NULL OR mb.k IS NOT NULL",
    "r16_profiles": "SELECT * FROM (VALUES ('colpali', 'colpali', false, 'colpali'), ('colpali_sim', 'colpali', true, 'colpali_sim'), ('hybrid_sim', 'hybrid', true, 'hybrid_sim'), ('bm25', 'bm25', false, 'bm25'), ('bm25_x', 'bm25', false, 'bm25')) AS t(profile, ranking, maps, again)",
    "r19_cache": "SELECT * FROM (VALUES ('a', true), ('b', false), ('c', false), ('d', true), ('e', true)) AS t(query, held)",
    "c7_cells": "SELECT vec_id, k AS patch, round(CAST(embedding[k + 1] AS DOUBLE), 4) AS value FROM (SELECT vec_id, embedding, unnest(range(3)) AS k FROM embeddings)",
    "c9_scores": "SELECT o_orderkey, CAST(o_orderkey % 7 AS INT) AS pos, 2.5::DOUBLE AS score FROM orders WHERE o_orderkey % 7 < 5",
    "f21_token_text": "SELECT c_custkey, c_mktsegment || 'x' AS token FROM customer",
}
QUERIES = {name: globals()[name] for name in ORACLES}
