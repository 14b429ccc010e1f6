"""Scans of tables, databases and catalogs."""

from __future__ import annotations

import re
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.runtime import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc_options(url: str) -> dict[str, str]:
    """Options of spark.read.format("jdbc") for a database URL; TLS unless sslmode=disable. A JDBC URL is taken as it is."""
    if url.startswith("jdbc:"):
        return {"url": url}
    parts = urlsplit(url)
    if parts.scheme not in ("postgresql", "postgres"):
        raise ValueError(f"Not a PostgreSQL URL: {parts.scheme or url!r}")
    disabled = parse_qs(parts.query).get("sslmode", [""])[0] == "disable"
    at = f"jdbc:postgresql://{parts.hostname}:{parts.port or 5432}/{parts.path.lstrip('/')}"
    return {"url": at + ("" if disabled else "?sslmode=require"), "user": unquote(parts.username or ""), "password": unquote(parts.password or ""), "driver": "org.postgresql.Driver"}


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, fetch: int = 10_000) -> DataFrame:
    """A database table or parenthesised query, read in ranges of its key at once if bounds are given."""
    options = jdbc_options(url) | {"dbtable": table, "fetchsize": str(fetch)}
    if key and bounds:
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options).load()


def key_bounds(spark: SparkSession, url: str, table: str, key: str) -> tuple[int, int] | None:
    """The least and greatest key, asked of the database; none of an empty table."""
    row = jdbc(spark, url, f"(SELECT MIN({safe_identifier(key)}) AS LOW, MAX({safe_identifier(key)}) AS HIGH FROM {safe_identifier(table)}) T").first()
    return None if row[0] is None else (int(row[0]), int(row[1]) + 1)


def jdbc_scan(spark: SparkSession, url: str, table: str, key: str, partitions: int = 16, fetch: int = 10_000) -> DataFrame:
    """A whole table in ranges of its key, read at once by as many connections; filters and columns are the database's work."""
    return jdbc(spark, url, safe_identifier(table), safe_identifier(key), key_bounds(spark, url, table, key), partitions, fetch)


def jdbc_append(rows: DataFrame, url: str, table: str, batch: int = 10_000, types: str | None = None) -> None:
    """Add rows to a database table, so many in one statement; each task is a transaction. ``types``: column types of a table that is made."""
    options = jdbc_options(url) | {"dbtable": safe_identifier(table), "batchsize": str(batch)}
    rows.write.format("jdbc").options(**options | ({"createTableColumnTypes": types} if types else {})).mode("append").save()


def timestamp_column(columns: list[str], preferred: tuple[str, ...] = DEFAULT.timestamp_columns) -> str | None:
    """The first of the preferred columns that the table has: one for the whole table, not one a row."""
    return next((c for c in preferred if c in columns), None)


def incremental(df: DataFrame, column: str | None, since: object | None, until: object | None = None, overlap_s: int = 0) -> DataFrame:
    """Rows changed after ``since`` (and not after ``until``); without a column or mark all. Not sorted.

    ``overlap_s``: changes of so many seconds before the mark are read again, as some may have come late; the
    store replaces by key, so a row read twice counts once.
    """
    if column is None:
        return df
    if since is not None:
        mark = F.lit(since)
        df = df.where(F.col(column) > (mark - F.make_dt_interval(secs=F.lit(overlap_s)) if overlap_s else mark))
    return df if until is None else df.where(F.col(column) <= F.lit(until))


def limited(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first rows by key: a top-n, not a sort."""
    return df.orderBy(key).limit(n)


def sample(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n rows at random, the same ones for the same seed and layout."""
    return df.orderBy(F.rand(seed)).limit(n)


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def fetch(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with these ids, in one join; unknown ids are dropped."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def catalog(frames: dict[str, DataFrame]) -> tuple[list[tuple], list[tuple]]:
    """(tables, columns) of named frames: metadata only, read on the driver."""
    tables = [(name,) for name in sorted(frames)]
    columns = [(name, f.name, f.dataType.simpleString(), f.nullable, i) for name in sorted(frames) for i, f in enumerate(frames[name].schema.fields, 1)]
    return tables, columns


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) in one job: counts are united, not collected one by one."""
    out = None
    for name in sorted(frames):
        one = frames[name].agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def database_name(spark: SparkSession) -> str:
    try:
        return spark.catalog.currentDatabase() or "unknown"
    except Exception:  # a catalog that can't say
        return "unknown"


def safe_identifier(name: str) -> str:
    """A quoted table name; anything that isn't a plain name is an error."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"Not a table name: {name!r}")
    return f'"{name}"'
