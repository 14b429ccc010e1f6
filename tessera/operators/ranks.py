"""Places in a total order over rows of any number, without one task that sees them all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.runtime import shared_dir


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``rows`` with their places from 1 in the given order, which has to be total.

    Rows are dealt by ranges of the order and written with their partition; places are counted within a partition, after
    those of the partitions before: a row a partition is all that one task adds up.
    """
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/tessera-places-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(*order).withColumn("place_part", F.spark_partition_id())
    dealt.write.parquet(at)
    held = spark.read.schema(dealt.schema).parquet(at)
    before = F.sum("n").over(W.orderBy("place_part").rowsBetween(W.unboundedPreceding, -1))
    parts = held.groupBy("place_part").agg(F.count("*").alias("n"))
    parts = parts.select("place_part", F.coalesce(before, F.lit(0)).alias("place_before"))
    within = F.row_number().over(W.partitionBy("place_part").orderBy(*order))
    out = held.withColumn("place_within", within).join(F.broadcast(parts), "place_part")
    return out.withColumn(name, F.col("place_before") + F.col("place_within")).drop("place_part", "place_before", "place_within")
