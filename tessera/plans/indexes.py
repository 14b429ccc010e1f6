"""Queries through persisted indexes and change logs, and interval joins: each is built from a whole table, then asked. Their SQL
compares everything."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import intervals, sign_index
from tessera.operators.bounded_maxsim import BoundedMaxSim
from tessera.operators.postings_index import PostingsIndex, TextStatistics
from tessera.operators.substring_index import SubstringIndex
from tessera.plans.flows import ORACLES as FLOWS
from tessera.plans.ranking import ORACLES as RANKING
from tessera.plans.retrieval import _CROSS, _DIST, _WORDS, DIMS, TERMS, _six, patches, tokens
from tessera.plans.retrieval import ORACLES as RETRIEVAL
from tessera.runtime import shared_dir, ship
from tessera.sources.change_store import ChangeStore
from tessera.sources.sinks import SnapshotStore
from tessera.sources.tables import read

#: Flips of a search: 16 over four bands, four in each, find all within a distance of 19.
FLIPS = 16


def _at(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def _postings(spark: SparkSession, docs: DataFrame, key: str) -> PostingsIndex:
    ship(spark)
    return PostingsIndex(spark, _at(spark, "postings"), key, buckets=16).build(docs, "text")


def m9_postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 from an index that skips ranges of documents below the tenth score."""
    index = _postings(spark, read(spark, sf_dir, "documents"), "doc_id")
    return _six(index.search(TERMS, 10).rows, "score")


def r3_postings_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a term, from its postings alone."""
    return _postings(spark, read(spark, sf_dir, "documents"), "doc_id").candidates(["secret"])


def r12_postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one kind by the terms of their text."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    index = _postings(spark, c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("rec"), "text"), "rec")
    return _six(index.search(["the", "of"], 10).rows, "score")


def a19_kept_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of terms that have followed a store through inserts, updates and deletes."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    store = SnapshotStore(spark, _at(spark, "store"), "doc_id", buckets=16)
    kept = TextStatistics(spark, _at(spark, "counts"), "doc_id", "text")
    old = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old "), F.substring("text", 1, 40))).otherwise(F.col("text"))
    store.upsert(d.where("doc_id % 5 <> 0").withColumn("text", old))
    kept.follow(store)
    store.upsert(d.where("doc_id % 5 = 0 OR doc_id % 7 = 0"))
    kept.follow(store)
    store.delete(d.where("doc_id % 11 = 0").select("doc_id"))
    kept.follow(store)
    total, average = kept.totals()
    return kept.terms().where("df >= 5").select("term", "df", "tf", F.lit(total).alias("n_docs"), F.round(F.lit(average), 6).alias("avg_len"))


def r2_indexed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest pages of each token among those that the index of signs finds."""
    rows = patches(spark, sf_dir).select("page", "patch", "bin")
    index = sign_index.SignIndex(spark, _at(spark, "signs"), DIMS).build(rows)
    return sign_index.page_candidates(index.found(tokens(spark, sf_dir).select("tok", "q_bin"), FLIPS), 10)


def r2_index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many flips each token takes to find its hundred nearest patches, and what is read on the way."""
    rows = patches(spark, sf_dir).select("page", "patch", "bin")
    return sign_index.levels(rows, tokens(spark, sf_dir).select("tok", "q_bin"), 100, DIMS).select("tok", "flips", "near", "rows")


def a7_bounded_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best pages by floats, read for those pages alone that the bounds from small codes leave open."""
    p = patches(spark, sf_dir).select("page", "patch", "vec")
    best = BoundedMaxSim(spark, _at(spark, "codes")).build(p).top(p, tokens(spark, sf_dir).select("tok", "q_vec"), 5)
    return _six(best.rows, "score")


def _substrings(spark: SparkSession, rows: DataFrame, key: str, needle: str) -> DataFrame:
    ship(spark)
    return SubstringIndex(spark, _at(spark, "trigrams"), key).build(rows, "text").search(rows, "text", needle).rows


def p15_indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a phrase, blind to case, from an index of trigrams."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return _substrings(spark, d, "doc_id", "Licensed under the Apache").select("doc_id")


def r11_indexed_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that hold what is being typed."""
    c = read(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL AND text <> 'string'")
    c = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("rec"), "text")
    return _substrings(spark, c, "rec", "tion ").select(F.col("text").alias("question")).distinct()


def k1_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a store whose upserts, updates and deletions are files of their own, merged when it is read."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    store = ChangeStore(spark, _at(spark, "changes"), "o_orderkey", buckets=8)
    store.upsert(o.where("o_orderkey % 3 <> 0"))
    store.compact()
    store.update(o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderstatus"])
    store.delete(o.where("o_orderkey % 7 = 0").select("o_orderkey"))
    store.upsert(o.where("o_orderkey % 3 = 0"))
    return store.read()


def j14_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier the pairs of a returned and an accepted item that are under way on the same day, a day for each piece."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", day.alias("low"), (day + F.floor("l_quantity")).alias("high"))
    met = intervals.overlap_join(items.where("l_returnflag = 'R'"), items.where("l_returnflag = 'A'"), ["l_suppkey"])
    shared = F.least("high", "o_high") - F.greatest("low", "o_low") + 1
    return met.groupBy("l_suppkey").agg(F.count("*").alias("pairs"), F.sum(shared).alias("days"))


def _band(b: int) -> str:
    return f"list_sum(list_transform(range({16 * b + 1}, {16 * b + 17}), lambda k: CASE WHEN (q[k] > 0) <> (vec[k] > 0) THEN 1 ELSE 0 END))"


_LEVEL = "least(" + ", ".join(f"CASE WHEN {_band(b)} = 0 THEN 0 ELSE ({_band(b)} - 1) * 4 + {b + 1} END" for b in range(4)) + ")"
_LEVELS = f"{_CROSS}, l AS (SELECT page, patch, CAST(tok AS BIGINT) AS tok, {_DIST} AS distance, CAST({_LEVEL} AS INTEGER) AS flips FROM x)"
_KEPT_WORDS = _WORDS.format(c="text")

ORACLES = {
    "m9_postings_topk": RETRIEVAL["m9_bm25_topk"],
    "r3_postings_candidates": RANKING["r3_lexical_candidates"],
    "r12_postings_search": FLOWS["r12_record_search"],
    "a7_bounded_maxsim": RETRIEVAL["a7_maxsim_topk"],
    "p15_indexed_search": "SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under the apache')",
    "r11_indexed_suggestions": "SELECT DISTINCT text AS question FROM conversations WHERE role = 'user' AND contains(lower(text), 'tion ') AND text <> 'string'",
    "a19_kept_statistics": f"""WITH w AS (SELECT doc_id, {_KEPT_WORDS} AS w FROM documents WHERE doc_id % 11 <> 0),
t AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY term)
SELECT term, df, tf, (SELECT count(*) FROM w) AS n_docs, (SELECT round(avg(len(w)), 6) FROM w) AS avg_len FROM t WHERE df >= 5""",
    "k1_change_log": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 <> 0""",
    "j14_interval_join": """WITH i AS (SELECT l_suppkey, l_returnflag, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS low, low + CAST(floor(l_quantity) AS BIGINT) AS high FROM lineitem)
SELECT a.l_suppkey, count(*) AS pairs, CAST(sum(least(a.high, b.high) - greatest(a.low, b.low) + 1) AS BIGINT) AS days
FROM i a JOIN i b ON a.l_suppkey = b.l_suppkey AND a.low <= b.high AND b.low <= a.high WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A' GROUP BY a.l_suppkey""",
    "r2_indexed_candidates": f"""WITH {_LEVELS}, d AS (SELECT page, tok, min(distance) AS distance FROM l WHERE flips <= {FLIPS} GROUP BY page, tok)
SELECT DISTINCT page FROM (SELECT page, row_number() OVER (PARTITION BY tok ORDER BY distance, page) AS r FROM d) WHERE r <= 10""",
    "r2_index_levels": f"""WITH {_LEVELS}, r AS (SELECT tok, flips, row_number() OVER (PARTITION BY tok ORDER BY distance, page, patch) AS r FROM l)
SELECT tok, flips, count(*) FILTER (r <= 100) AS near, count(*) AS rows FROM r GROUP BY tok, flips""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
