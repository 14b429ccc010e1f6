"""Queries over a catalog that is discovered from the given tables, and their SQL.

Tables are named in the plural and keys ``id`` and ``x_id``, as a source's are, so that their relationships can be told by name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import strings
from tessera.operators import ingestion as ing
from tessera.operators import text_index
from tessera.plans.retrieval import _six
from tessera.sources.tables import read

#: Names that the given tables go by, and their own keys.
NAMES = {"customer": "custs", "lineitem": "lineitems", "nation": "nations", "orders": "orders", "part": "parts", "region": "regions", "supplier": "supps"}
#: Given foreign keys: table, column, target and its key.
KEYS = (
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
)


def _column(column: str, table: str) -> str:
    """o_custkey to cust_id, and the table's own key to id."""
    name = re.sub("^[a-z]+_", "", column)
    if not name.endswith("key"):
        return name
    stem = name.removesuffix("key")
    return "id" if f"{stem}s" == NAMES[table] else f"{stem}_id"


def _frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    out = {}
    for table, name in NAMES.items():
        df = read(spark, sf_dir, table)
        out[name] = df.toDF(*[_column(c, table) for c in df.columns])
    return out


def j1_verified_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys told by the names of discovered columns, each held against the rows."""
    frames = _frames(spark, sf_dir)
    return ing.verified(ing.discover(spark, frames)["relationships"], frames)


def j3_discovered_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways back to each discovered table, and how many rows the busiest of its rows has there."""
    frames = _frames(spark, sf_dir)
    found = ing.discover(spark, frames)["relationships"]
    most = ing.verified(found, frames).select("source_table", "source_column", "most")
    return ing.incoming_hints(found).join(F.broadcast(most), ["source_table", "source_column"])


def i13_discovered_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ways lead back to each discovered table, and over how many rows."""
    frames = _frames(spark, sf_dir)
    held = ing.verified(ing.discover(spark, frames)["relationships"], frames)
    return held.groupBy("target_table").agg(F.count("*").alias("ways"), F.sum("rows").alias("rows"))


def p6_discovered_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered tables that no pattern excludes, with their rows."""
    counts = ing.discover(spark, _frames(spark, sf_dir))["counts"]
    return counts.where(~strings.matches_any_glob(F.col("table_name"), ("n*s", "cust?", "*_x")))


def r13_discovered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered tables by the words of their columns."""
    columns = ing.discover(spark, _frames(spark, sf_dir))["columns"]
    docs = columns.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list(F.replace("column_name", F.lit("_"), F.lit(" ")))), " ").alias("text"))
    return _six(text_index.bm25(docs, "table_name", "text", ["nation", "cust", "name"]), "score")


def _as(table: str) -> str:
    return f"'{NAMES[table]}'"


_HELD = " UNION ALL ".join(
    f"SELECT {_as(t)} AS source_table, '{_column(c, t)}' AS source_column, {_as(g)} AS target_table, (SELECT count({c}) FROM {t}) AS rows, "
    f"(SELECT count(*) FROM {t} WHERE {c} NOT IN (SELECT {k} FROM {g})) AS orphans, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM {t} WHERE {c} IN (SELECT {k} FROM {g}) GROUP BY {c})), 0) AS most"
    for t, c, g, k in KEYS
)
_COUNTS = " UNION ALL ".join(f"SELECT {_as(t)} AS table_name, count(*) AS row_count FROM {t}" for t in NAMES)
_TABLE_NAME = "CASE table_name " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in NAMES.items()) + " END"
_STEM = "regexp_replace(regexp_replace(column_name, '^[a-z]+_', ''), 'key$', '')"
_COLUMN = f"CASE WHEN column_name NOT LIKE '%key' THEN {_STEM} WHEN {_STEM} || 's' = {_TABLE_NAME} THEN 'id' ELSE {_STEM} || ' id' END"

ORACLES = {
    "j1_verified_keys": _HELD,
    "j3_discovered_hints": f"SELECT source_table, source_column, target_table, rtrim(source_table, 's') AS relationship_type, 'one_to_many' AS cardinality, 'Find ' || source_table || ' where ' || source_column || ' = id' AS query_hint, most FROM ({_HELD})",
    "i13_discovered_hints": f"SELECT target_table, count(*) AS ways, CAST(sum(rows) AS BIGINT) AS rows FROM ({_HELD}) GROUP BY target_table",
    "p6_discovered_selection": f"SELECT * FROM ({_COUNTS}) WHERE NOT regexp_matches(table_name, '^(n.*s|cust.|.*_x)$')",
    "r13_discovered_search": f"""WITH w AS (SELECT {_TABLE_NAME} AS k, replace({_COLUMN}, '_', ' ') AS said FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in NAMES)})),
t AS (SELECT k, unnest(string_split(said, ' ')) AS term FROM w), n AS (SELECT k, count(*) AS len FROM t GROUP BY k),
s AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM n), f AS (SELECT k, term, count(*) AS tf FROM t WHERE term IN ('nation', 'cust', 'name') GROUP BY k, term), d AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT k AS table_name, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)))), 6) AS score FROM f JOIN d USING (term) JOIN n USING (k), s GROUP BY k""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
