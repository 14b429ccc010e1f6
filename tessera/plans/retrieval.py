"""Queries of retrieval over ``embeddings``, ``documents`` and ``conversations``, and their SQL.

A page is eight neighbouring vectors, a patch one of them; the query's tokens are three fixed vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import nested, strings, vectors
from tessera.operators import retrieval as r
from tessera.operators import ranks, text_index
from tessera.sources.tables import read

DIMS = 64
TOKENS = {3: 0, 141: 1, 277: 2}
TERMS = ["the", "token"]


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return v.select(F.expr("vec_id div 8").alias("page"), (F.col("vec_id") % 8).alias("patch"), F.col("embedding").alias("vec"), vectors.pack_longs(F.col("embedding"), DIMS).alias("bin"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*TOKENS))
    tok = F.element_at(F.create_map(*[F.lit(x) for kv in TOKENS.items() for x in kv]), F.col("vec_id").cast("int"))
    return v.select(tok.cast("long").alias("tok"), F.col("embedding").alias("q_vec"), vectors.pack_longs(F.col("embedding"), DIMS).alias("q_bin"))


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def a7_maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(r.top(r.maxsim(patches(spark, sf_dir), tokens(spark, sf_dir), r.float_similarity()), 5), "score")


def m1_packbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.posexplode(vectors.pack_bits(F.col("embedding"), DIMS)).alias("byte_no", "byte")).select("vec_id", F.col("byte_no").cast("long").alias("byte_no"), F.col("byte").cast("long").alias("byte"))


def m4_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = patches(spark, sf_dir), tokens(spark, sf_dir)
    return p.join(r.query_tokens(t)).select("page", "patch", "tok", r.bit_distance(DIMS).cast("long").alias("distance"))


def a8_binary_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(r.top(r.maxsim(patches(spark, sf_dir), tokens(spark, sf_dir), r.bit_similarity(DIMS)), 20), "score")


def r4_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(r.two_phase(patches(spark, sf_dir), tokens(spark, sf_dir), 20, 5, DIMS), "score")


def m2_maxsim_bits01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(r.maxsim(patches(spark, sf_dir), tokens(spark, sf_dir), r.sign_similarity(False)), "score")


def m3_maxsim_bits_pm1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(r.maxsim(patches(spark, sf_dir), tokens(spark, sf_dir), r.sign_similarity(True)), "score")


def r8_app_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page has lost its floats, every sixth its signs too."""
    p, t = patches(spark, sf_dir), tokens(spark, sf_dir)
    hits = r.two_phase(p, t, 100, 20, DIMS).withColumnRenamed("score", "relevance")
    p = p.join(F.broadcast(hits.select("page")), "page", "left_semi")  # 20 ids
    floats = r.maxsim(p.where("page % 3 <> 0"), t, r.float_similarity())
    signs = r.maxsim(p.where("page % 6 <> 0"), t, r.sign_similarity(True))
    return _six(r.rerank(hits, floats, signs, 5), "relevance", "rerank_score")


def r2_ann_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.ann_candidates(patches(spark, sf_dir), tokens(spark, sf_dir), 10, DIMS)


def w9_simmap_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.similarity_cube(patches(spark, sf_dir), tokens(spark, sf_dir))


def w10_simmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = patches(spark, sf_dir).join(r.whole_query(tokens(spark, sf_dir))).select("page", "tok", "patch", r.float_similarity().alias("s"))
    return _six(r.similarity_grid(cells, "s", side=4, patches=7), "value")


def a19_bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    df = text_index.postings(d, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return df.where("df >= 5").join(F.broadcast(text_index.statistics(d, "text"))).select("term", "df", "tf", "n_docs", F.round("avg_len", 6).alias("avg_len"))


def m9_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(r.top(text_index.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", TERMS), 10, "doc_id"), "score")


def m8_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxSim plus twice the lexical scores of text and title; candidates of either kind."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text", F.col("source").alias("title"))
    p, t = patches(spark, sf_dir), tokens(spark, sf_dir)
    near = r.ann_candidates(p, t, 10, DIMS)
    lexical = text_index.bm25_fields(d, "page", {"text": TERMS, "title": ["src3"]})
    lexical = lexical.withColumnsRenamed({"score_text": "s1", "score_title": "s2"})
    ids = near.unionByName(lexical.select("page")).distinct()
    sim = r.maxsim(p.join(ids, "page", "left_semi"), t, r.sign_similarity(False)).withColumnRenamed("score", "s0")
    both = ids.join(sim, "page", "left").join(lexical, "page", "left")
    score = F.coalesce("s0", F.lit(0.0)) + 2 * (F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0)))
    return _six(r.top(both.select("page", F.round(score, 6).alias("score")), 10), "score")


def a22_relative_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(r.relative(r.maxsim(patches(spark, sf_dir), tokens(spark, sf_dir), r.float_similarity())).drop("score"), "relative")


def r11_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    return r.suggestions(c.groupBy("conv_id").agg(F.collect_list("text").alias("questions")), " The ")


def r14_llm_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus")
    said = "```json\n[{\"index\": 7, \"score\": 9.5}, {\"index\": 3, \"score\": 9.5}, {\"index\": 77, \"score\": 10}, {\"index\": 12, \"score\": 2}]\n```"
    scores = spark.range(1).select(F.explode(nested.scored(strings.without_fences(F.lit(said)), 50)).alias("pos", "llm_score"))
    return r.llm_rerank(hits, scores.withColumn("pos", F.col("pos").cast("long")), 10)


def r18_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("rank"), F.col("source").alias("title"), F.col("doc_id").alias("page_number"), "text")
    return r.context(d)


def p10_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, t) for i, t in enumerate(("2", "0", "3", "▁2", "▁hi", "norwegian", "unlisted", "<bos>", "Question", ":", "<pad>", "\n", "▁", "?", ")", "%", "/)", "_x", "é", "中", "a b"))]
    t = spark.createDataFrame(rows, "tok long, token string")
    return t.select("tok", strings.is_content_token(F.col("token")).alias("kept"), strings.token_text(F.col("token")).alias("shown"))


def j16_token_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells joined to the kept tokens' texts by token number; the least cell of each."""
    names = spark.createDataFrame([(0, "▁hi"), (1, "<bos>"), (2, "2")], "tok long, token string").where(strings.is_content_token(F.col("token")))
    cube = r.similarity_cube(patches(spark, sf_dir), tokens(spark, sf_dir))
    return cube.join(F.broadcast(names), "tok").groupBy("page", strings.token_text(F.col("token")).alias("token")).agg(F.max("quantised").alias("most"), F.min_by("patch", F.struct(-F.col("quantised"), "patch")).alias("patch"))


def r17_wide_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column a token instead of a row."""
    cube = r.similarity_cube(patches(spark, sf_dir), tokens(spark, sf_dir))
    wide = cube.groupBy("page", "patch").pivot("tok", [0, 1, 2]).agg(F.first("quantised"))
    return wide.select("page", "patch", *[F.col(str(k)).alias(f"sim_map_{k}") for k in range(3)])


def r6_unranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.top(patches(spark, sf_dir).select("page").distinct().withColumn("score", F.lit(0.0)), 5)


def r9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    runs = {"bm25": lambda text: text_index.bm25(d, "doc_id", "text", text.lower().split()).withColumnRenamed("doc_id", "page")}
    return _six(r.search("what is the token of this", r.profile_name("bm25", False), runs), "score")


def a11_ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of several searches, each once, in the order in which they came first."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("step"))
    return ranks.numbered(first, "step").select("user_id", "step", "place")


_P = "SELECT vec_id // 8 AS page, vec_id % 8 AS patch, embedding AS vec FROM embeddings"
_Q = "SELECT CASE vec_id WHEN 3 THEN 0 WHEN 141 THEN 1 ELSE 2 END AS tok, embedding AS q FROM embeddings WHERE vec_id IN (3, 141, 277)"
_CROSS = f"p AS ({_P}), q AS ({_Q}), x AS (SELECT page, patch, tok, vec, q FROM p, q)"
_DOT = "list_dot_product(CAST(q AS DOUBLE[]), CAST(vec AS DOUBLE[]))"
_BITS = "list_dot_product(CAST(q AS DOUBLE[]), list_transform(vec, lambda v: CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE {low}::DOUBLE END))"
_DIST = "CAST(list_sum(list_transform(range(1, 65), lambda k: CASE WHEN (q[k] > 0) <> (vec[k] > 0) THEN 1 ELSE 0 END)) AS BIGINT)"


def _maxsim_sql(name: str, expr: str, source: str = "x") -> str:
    return f"{name} AS (SELECT page, sum(best) AS score FROM (SELECT page, tok, max({expr}) AS best FROM {source} GROUP BY page, tok) GROUP BY page)"


_B01, _PM1, _BSIM = _BITS.format(low="0.0"), _BITS.format(low="-1.0"), f"1.0 / (1 + {_DIST})"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _bm25_sql(name: str, table: str, key: str, column: str, terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
{name}w AS (SELECT {key} AS k, {_WORDS.format(c=column)} AS w FROM {table}),
{name}s AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM {name}w),
{name}t AS (SELECT k, term, count(*) AS tf, any_value(len) AS len FROM (SELECT k, len(w) AS len, unnest(w) AS term FROM {name}w) WHERE term IN ({listed}) GROUP BY k, term),
{name}d AS (SELECT term, count(*) AS df FROM {name}t GROUP BY term),
{name} AS (SELECT k, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)))) AS score FROM {name}t JOIN {name}d USING (term), {name}s GROUP BY k)"""


_TWO = f"{_CROSS}, {_maxsim_sql('one', _BSIM)}, head AS (SELECT page FROM one ORDER BY score DESC, page LIMIT {{first}}), {_maxsim_sql('two', _B01, '(SELECT * FROM x WHERE page IN (SELECT page FROM head))')}"
_CUBE = f"{_CROSS}, c AS (SELECT page, tok, patch, {_B01} AS s FROM x), cube AS (SELECT page, tok, patch, CAST(floor((s - min(s) OVER (PARTITION BY page)) / (max(s) OVER (PARTITION BY page) - min(s) OVER (PARTITION BY page) + 0.001) * 254) AS BIGINT) AS quantised FROM c)"
_ANN = f"dist AS (SELECT page, tok, min({_DIST}) AS distance FROM x GROUP BY page, tok), near AS (SELECT DISTINCT page FROM (SELECT page, row_number() OVER (PARTITION BY tok ORDER BY distance, page) AS r FROM dist) WHERE r <= 10)"

ORACLES = {
    "a7_maxsim_topk": f"WITH {_CROSS}, {_maxsim_sql('s', _DOT)} SELECT page, round(score, 6) AS score FROM s ORDER BY s.score DESC, page LIMIT 5",
    "m1_packbits": "SELECT vec_id, b AS byte_no, CAST(CASE WHEN v > 127 THEN v - 256 ELSE v END AS BIGINT) AS byte FROM (SELECT vec_id, b, list_sum(list_transform(range(1, 9), lambda k: CASE WHEN embedding[b * 8 + k] > 0 THEN 1 << (8 - k) ELSE 0 END)) AS v FROM (SELECT vec_id, embedding, unnest(range(8)) AS b FROM embeddings))",
    "m4_hamming": f"WITH {_CROSS} SELECT page, patch, CAST(tok AS BIGINT) AS tok, {_DIST} AS distance FROM x",
    "a8_binary_maxsim": f"WITH {_CROSS}, {_maxsim_sql('s', _BSIM)} SELECT page, round(score, 6) AS score FROM s ORDER BY s.score DESC, page LIMIT 20",
    "r4_two_phase": f"WITH {_TWO.format(first=20)} SELECT page, round(score, 6) AS score FROM two ORDER BY two.score DESC, page LIMIT 5",
    "m2_maxsim_bits01": f"WITH {_CROSS}, {_maxsim_sql('s', _B01)} SELECT page, round(score, 6) AS score FROM s",
    "m3_maxsim_bits_pm1": f"WITH {_CROSS}, {_maxsim_sql('s', _PM1)} SELECT page, round(score, 6) AS score FROM s",
    "r8_app_rerank": f"WITH {_TWO.format(first=100)}, hits AS (SELECT page, score AS relevance FROM two ORDER BY score DESC, page LIMIT 20), {_maxsim_sql('f', _DOT, '(SELECT * FROM x WHERE page % 3 <> 0)')}, {_maxsim_sql('b', _PM1, '(SELECT * FROM x WHERE page % 6 <> 0)')} SELECT page, round(relevance, 6) AS relevance, round(rr, 6) AS rerank_score FROM (SELECT hits.page, relevance, coalesce(f.score, b.score, relevance) AS rr FROM hits LEFT JOIN f USING (page) LEFT JOIN b USING (page)) ORDER BY rr DESC, relevance DESC, page LIMIT 5",
    "r2_ann_candidates": f"WITH {_CROSS}, {_ANN} SELECT page FROM near",
    "w9_simmap_quantized": f"WITH {_CUBE} SELECT page, patch, CAST(tok AS BIGINT) AS tok, quantised FROM cube",
    "w10_simmap_grid": f"WITH {_CROSS}, c AS (SELECT page, tok, patch, {_DOT} AS s FROM x WHERE patch < 7) SELECT page, CAST(tok AS BIGINT) AS tok, patch // 4 AS row, patch % 4 AS col, round((s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w + 1e-6), 6) AS value FROM c WINDOW w AS (PARTITION BY page, tok)",
    "a19_bm25_stats": f"WITH w AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents), t AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY term) SELECT term, df, tf, (SELECT count(*) FROM w) AS n_docs, (SELECT round(avg(len(w)), 6) FROM w) AS avg_len FROM t WHERE df >= 5",
    "m9_bm25_topk": f"WITH {_bm25_sql('s', 'documents', 'doc_id', 'text', TERMS)} SELECT k AS doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, k LIMIT 10",
    "m8_hybrid_topk": f"WITH {_CROSS}, {_ANN}, {_maxsim_sql('v', _B01)}, {_bm25_sql('la', 'documents', 'doc_id', 'text', TERMS)}, {_bm25_sql('lb', 'documents', 'doc_id', 'source', ['src3'])}, ids AS (SELECT page FROM near UNION SELECT k FROM la UNION SELECT k FROM lb) SELECT page, score FROM (SELECT ids.page, round(coalesce(v.score, 0) + 2 * (coalesce(la.score, 0) + coalesce(lb.score, 0)), 6) AS score FROM ids LEFT JOIN v ON v.page = ids.page LEFT JOIN la ON la.k = ids.page LEFT JOIN lb ON lb.k = ids.page) ORDER BY score DESC, page LIMIT 10",
    "a22_relative_score": f"WITH {_CROSS}, {_maxsim_sql('s', _DOT)} SELECT page, round(CASE WHEN (SELECT max(score) FROM s) > 0 THEN least(score / (SELECT max(score) FROM s), 1) ELSE 0 END, 6) AS relative FROM s",
    "r11_suggestions": "SELECT DISTINCT text AS question FROM conversations WHERE role = 'user' AND contains(lower(text), 'the') AND text <> 'string'",
    "r14_llm_rerank": "SELECT o_orderkey AS pos, o_orderstatus, CAST(CASE o_orderkey WHEN 7 THEN 9.5 WHEN 3 THEN 9.5 WHEN 12 THEN 2 ELSE 0 END AS DOUBLE) AS llm_score FROM orders ORDER BY llm_score DESC, pos LIMIT 10",
    "r18_context": "SELECT string_agg('[' || (doc_id + 1) || '] ' || source || ', page ' || doc_id || ': ' || left(text, 300), chr(10) ORDER BY doc_id) AS context FROM documents WHERE doc_id < 5",
    "p10_token_filter": "SELECT CAST(tok AS BIGINT) AS tok, token IN ('2', '0', '3', '▁2', '▁hi', 'norwegian', 'unlisted', 'é', '中', 'a b') AS kept, replace(token, '▁', '') AS shown FROM (VALUES (0, '2'), (1, '0'), (2, '3'), (3, '▁2'), (4, '▁hi'), (5, 'norwegian'), (6, 'unlisted'), (7, '<bos>'), (8, 'Question'), (9, ':'), (10, '<pad>'), (11, chr(10)), (12, '▁'), (13, '?'), (14, ')'), (15, '%'), (16, '/)'), (17, '_x'), (18, 'é'), (19, '中'), (20, 'a b')) AS t(tok, token)",
    "j16_token_maps": f"WITH {_CUBE} SELECT page, CASE tok WHEN 0 THEN 'hi' ELSE '2' END AS token, max(quantised) AS most, arg_min(patch, -quantised * 100 + patch) AS patch FROM cube WHERE tok <> 1 GROUP BY page, tok",
    "r17_wide_maps": f"WITH {_CUBE} SELECT page, patch, max(quantised) FILTER (tok = 0) AS sim_map_0, max(quantised) FILTER (tok = 1) AS sim_map_1, max(quantised) FILTER (tok = 2) AS sim_map_2 FROM cube GROUP BY page, patch",
    "r6_unranked": f"SELECT DISTINCT page, CAST(0 AS DOUBLE) AS score FROM ({_P}) ORDER BY page LIMIT 5",
    "r9_search": f"WITH {_bm25_sql('s', 'documents', 'doc_id', 'text', ['token'])} SELECT k AS page, round(score, 6) AS score FROM s ORDER BY s.score DESC, k LIMIT 3",
    "a11_ordered_ids": "SELECT user_id, step, row_number() OVER (ORDER BY step) AS place FROM (SELECT user_id, min(event_id) AS step FROM events GROUP BY user_id)",
}
QUERIES = {name: globals()[name] for name in ORACLES}
