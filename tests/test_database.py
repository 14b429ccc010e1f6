"""Scans of a live database: the one that comes with Spark, embedded in the session's own process."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.sources import tables


@pytest.fixture
def database(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    tables.jdbc_append(orders, url, "ORDERS", types="o_orderstatus VARCHAR(8), o_orderpriority VARCHAR(32)")
    return url, orders


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table_in_partitions(spark, database):
    url, orders = database
    scan = tables.jdbc_scan(spark, url, "ORDERS", "o_orderkey", partitions=8)
    assert scan.rdd.getNumPartitions() == 8
    assert rows(scan.select(orders.columns)) == rows(orders)
    sizes = [r[0] for r in scan.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)


def test_filters_and_columns_reach_the_database(spark, database):
    url, orders = database
    some = tables.jdbc_scan(spark, url, "ORDERS", "o_orderkey", partitions=4).where("o_orderstatus = 'F' AND o_orderkey > 100").select("o_orderkey")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(o_orderstatus)" in plan and "EqualTo(o_orderstatus,F)" in plan and "ReadSchema: struct<o_orderkey" in plan
    assert rows(some) == rows(orders.where("o_orderstatus = 'F' AND o_orderkey > 100").select("o_orderkey"))


def test_batches_by_a_cursor(spark, database):
    url, orders = database
    whole = tables.jdbc(spark, url, "(SELECT \"o_orderkey\" FROM ORDERS WHERE \"o_orderkey\" < 50) T", fetch=7)
    assert rows(whole) == rows(orders.where("o_orderkey < 50").select("o_orderkey"))


def test_appended_rows_and_an_empty_table(spark, database):
    url, orders = database
    tables.jdbc_append(orders.limit(0), url, "NONE")
    assert tables.key_bounds(spark, url, "NONE", "o_orderkey") is None
    assert tables.jdbc_scan(spark, url, "NONE", "o_orderkey").count() == 0
    tables.jdbc_append(orders.where("o_orderkey < 10"), url, "ORDERS")
    assert tables.jdbc_scan(spark, url, "ORDERS", "o_orderkey", partitions=3).count() == orders.count() + orders.where("o_orderkey < 10").count()
    with pytest.raises(ValueError, match="Not a table name"):
        tables.jdbc_scan(spark, url, "ORDERS; DROP TABLE X", "o_orderkey")
