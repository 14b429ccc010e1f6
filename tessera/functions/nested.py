"""Maps, arrays, JSON and time as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_document_string(df: DataFrame, name: str) -> Column:
    """A field as a document stores it: booleans in lower case, timestamps in ISO form with
    microseconds only if there are any, arrays and structs as JSON, others as text; null stays null."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def iso(ts: Column) -> Column:
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")))


def row_map(df: DataFrame, names: list[str]) -> Column:
    """The named fields as a map of strings without nulls."""
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[as_document_string(df, n) for n in names]))
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def epoch_millis(df: DataFrame, name: str) -> Column:
    """Milliseconds since 1970: timestamps as they are, numbers as seconds, strings in ISO form; else null."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        return (c * 1000).cast("long")
    if isinstance(kind, T.StringType):
        return F.unix_millis(F.try_to_timestamp(c))
    return F.unix_millis(c.cast("timestamp"))


def or_now(millis: Column, now: int) -> Column:
    """Zero counts as missing."""
    return F.coalesce(F.nullif(millis, F.lit(0).cast("long")), F.lit(now).cast("long"))


def key_map(json: Column) -> Column:
    """A JSON object as (file_id, key) structs, without null and empty keys; other JSON gives none."""
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    return F.coalesce(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")), F.array().cast("array<struct<key:string,value:string>>"))


def scored(json: Column, n: int) -> Column:
    """A JSON list of {index, score} as a map of the indices in [0, n); anything else: null."""
    items = F.from_json(json, "array<struct<index:int,score:double>>")
    return F.map_from_entries(F.filter(items, lambda s: s["index"].between(0, n - 1) & s["score"].isNotNull()))


def blocks_in_order(blocks: Column) -> Column:
    """A map keyed by numbers in text as its values in the order of the numbers."""
    keyed = F.transform(F.map_entries(blocks), lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v")))
    return F.transform(F.array_sort(keyed), lambda e: e["v"])


def freshness(millis: Column, now: int, max_age_s: int = 3 * 30 * 24 * 3600) -> Column:
    """1 for now, falling linearly to 0 at the greatest age."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.greatest(F.lit(now) - millis, F.lit(0)) / (1000.0 * max_age_s))


def cells(json: Column) -> Column:
    """A tensor as JSON cells, as an array of (address map, value); anything else: null."""
    return F.from_json(json, "cells array<struct<address:map<string,string>,value:double>>")["cells"]
