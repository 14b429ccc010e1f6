"""Joins of intervals that overlap, by bins whose width follows their length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(low: Column, high: Column) -> Column:
    """The power of two that is at least the length, as its exponent: an interval reaches at most two bins of that width."""
    length = F.greatest(high - low, F.lit(1)).cast("double")
    return F.ceil(F.log2(length)).cast("int")


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], low: str = "low", high: str = "high", prefix: str = "o_") -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` that are equal in ``on`` and whose closed intervals [low, high] share a point, each pair once.

    Bounds are numbers; ``b``'s further columns get the prefix. Rows with a null in ``on``, a null bound or low above high match nothing.

    An interval lies in the bins of its own level, two at most however long it is, and for each coarser level that the other side has
    intervals of, in the bins of that level. Two intervals meet at the coarser of their levels, in the bin of
    the greater of their starts. Levels are at most one for each power of two and are collected first.
    """
    a = a.where(F.col(low) <= F.col(high)).withColumn("__level", _level(F.col(low), F.col(high)))
    kept = [c for c in b.columns if c not in on]
    b = b.where(F.col(low) <= F.col(high)).select(*on, *[F.col(c).alias(f"{prefix}{c}") for c in kept])
    o_low, o_high = f"{prefix}{low}", f"{prefix}{high}"
    b = b.withColumn("__o_level", _level(F.col(o_low), F.col(o_high)))
    levels = [sorted(r[0] for r in side.select(name).distinct().collect()) for side, name in ((a, "__level"), (b, "__o_level"))]

    def binned(rows: DataFrame, level: str, start: str, end: str, others: list[int]) -> DataFrame:
        wanted = F.array_distinct(F.concat(F.array(F.col(level)), F.filter(F.array(*map(F.lit, others)), lambda k: k > F.col(level))))
        rows = rows.withColumn("__at", F.explode(wanted))
        width = F.pow(F.lit(2.0), F.col("__at"))
        first, last = F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long")
        return rows.withColumn("__bin", F.explode(F.sequence(first, last)))

    left = binned(a, "__level", low, high, levels[1])
    right = binned(b, "__o_level", o_low, o_high, levels[0])
    met = left.join(right, [*on, "__at", "__bin"])
    met = met.where(F.col("__at") == F.greatest("__level", "__o_level"))
    met = met.where((F.col(low) <= F.col(o_high)) & (F.col(o_low) <= F.col(high)))
    start = F.greatest(F.col(low), F.col(o_low)) / F.pow(F.lit(2.0), F.col("__at"))
    return met.where(F.col("__bin") == F.floor(start).cast("long")).drop("__level", "__o_level", "__at", "__bin")


def crossings(h: DataFrame, v: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, h_at, v_at ...) of flat and upright lines (page, at, low, high) that cross: each lies within the other's reach."""
    flat = h.select(page, F.col("at").alias("h_at"), F.col("low").alias("h_low"), F.col("high").alias("h_high"))
    up = v.select(page, F.col("at").alias("v_at"), F.col("low").alias("v_low"), F.col("high").alias("v_high"))
    # The upright line's place is a point among the flat lines' intervals.
    points = up.withColumns({"low": F.col("v_at"), "high": F.col("v_at")})
    spans = flat.withColumns({"low": F.col("h_low"), "high": F.col("h_high")})
    met = overlap_join(spans, points, [page]).drop("low", "high", "o_low", "o_high").withColumnsRenamed({f"o_{c}": c for c in ("v_at", "v_low", "v_high")})
    return met.where(F.col("h_at").between(F.col("v_low"), F.col("v_high")))
