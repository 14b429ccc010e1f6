"""Approximate nearest neighbours by signs: a persisted multi-index over bands of packed signs, probed by flips.

Each row's signs are cut into bands of 16 bits, and the row is stored once for each band under the band's code, in folders by band and
the code's highest bits, in order of codes. A search probes each band with the query's code and all codes of a few flipped bits, reads
what lies there, and measures the full distance of what it finds, which is stored along. ``flips`` are dealt over
the bands, so no row within a distance of flips + bands - 1 is missed.

How many flips a wanted recall takes depends on the data: ``calibrate`` finds out from sampled rows against an exact scan. Where
probing would read more than a given share of the rows, the exact scan is cheaper, and is what ``nearest`` does.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors

BAND = 16
_FOLDER_BITS = 6


def band_code(packed: Column, band: int) -> Column:
    """The 16 signs of a band of packed longs."""
    word = F.get(packed, F.lit(band // 4))
    return F.call_function("shiftrightunsigned", word, F.lit(48 - 16 * (band % 4))).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")


def allowed(flips: int, band: int, bands: int) -> int:
    """The flips of one band: the first bands have the remainder."""
    return flips // bands + (band < flips % bands)


def level(a: Column, b: Column, bands: int) -> Column:
    """The least number of flips with which a search from ``a`` finds ``b``."""
    best = None
    for band in range(bands):
        d = F.bit_count(band_code(a, band).bitwiseXOR(band_code(b, band)))
        asked = F.when(d == 0, F.lit(0)).otherwise((d - 1) * bands + band + 1)
        best = asked if best is None else F.least(best, asked)
    return best


@dataclass(frozen=True)
class Calibration:
    """What sampled queries say of a number of flips: the recall of the exact nearest and the share of rows read."""

    flips: int
    recall: float
    read: float


class SignIndex:
    """An index of rows (key columns, bin array<long>) under ``path``. ``dims``: a multiple of 16. ``most_flips``: in one band; beyond it the
    codes to probe are too many to be sent to tasks (6,885 a band and query at 5)."""

    def __init__(self, spark: SparkSession, path: str, dims: int, key: tuple[str, ...] = ("page", "patch"), most_flips: int = 5) -> None:
        self.spark, self.path, self.dims, self.key, self.most_flips = spark, path.rstrip("/"), dims, key, most_flips
        self.bands = dims // BAND

    def build(self, rows: DataFrame) -> SignIndex:
        codes = F.array(*[F.struct(F.lit(b).alias("band"), band_code(F.col("bin"), b).alias("code")) for b in range(self.bands)])
        each = rows.select(*self.key, "bin", F.explode(codes).alias("c")).select(*self.key, "bin", "c.band", "c.code")
        each = each.withColumn("part", F.expr(f"shiftright(code, {BAND - _FOLDER_BITS})"))
        dealt = each.repartitionByRange("band", "code").sortWithinPartitions("band", "code")
        dealt.write.mode("overwrite").partitionBy("band", "part").parquet(f"{self.path}/bands")
        return self

    def _probes(self, tokens: DataFrame, flips: int) -> DataFrame:
        """(tok, q_bin, band, part, code): every code that a token asks for. Masks are a table of their own, tokens few."""
        deepest = allowed(flips, 0, self.bands)
        if deepest > self.most_flips:
            raise ValueError(f"{flips} flips are more than {self.most_flips} in a band")
        masks = [(n, sum(1 << i for i in bits)) for n in range(deepest + 1) for bits in itertools.combinations(range(BAND), n)]
        masks = self.spark.createDataFrame(masks, "n int, mask int")
        own = F.array(*[F.struct(F.lit(b).alias("band"), band_code(F.col("q_bin"), b).alias("own"), F.lit(allowed(flips, b, self.bands)).alias("most")) for b in range(self.bands)])
        asked = tokens.select("tok", "q_bin", F.explode(own).alias("o")).select("tok", "q_bin", "o.*")
        probes = asked.join(F.broadcast(masks), F.col("n") <= F.col("most")).withColumn("code", F.col("own").bitwiseXOR(F.col("mask")))
        return probes.select("tok", "q_bin", "band", F.expr(f"shiftright(code, {BAND - _FOLDER_BITS})").alias("part"), "code")

    def found(self, tokens: DataFrame, flips: int) -> DataFrame:
        """(tok, key ..., distance) of the rows that probing finds, each once a token.

        Probes go to every task: tokens are limited by the caller, codes a token by ``most_flips``. Folders without a probed code
        aren't read.
        """
        rows = self.spark.read.parquet(f"{self.path}/bands")
        hit = rows.join(F.broadcast(self._probes(tokens, flips)), ["band", "part", "code"])
        distance = vectors.hamming_longs(F.col("q_bin"), F.col("bin"), -(-self.dims // 64)).cast("int")
        return hit.groupBy("tok", *self.key).agg(F.min(distance).alias("distance"))

    def nearest(self, tokens: DataFrame, k: int, flips: int) -> DataFrame:
        """(tok, key ..., distance): each token's k nearest among the found, equal distances by key."""
        return _first(self.found(tokens, flips), k, self.key)


def _first(rows: DataFrame, k: int, key: tuple[str, ...]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("tok").orderBy("distance", *key))
    return rows.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def scan(rows: DataFrame, tokens: DataFrame, k: int, dims: int, key: tuple[str, ...] = ("page", "patch")) -> DataFrame:
    """The same by measuring every row; k rows a token and task reach the shuffle."""
    distance = vectors.hamming_longs(F.col("q_bin"), F.col("bin"), -(-dims // 64)).cast("int")
    return _first(rows.join(F.broadcast(tokens)).select("tok", *key, distance.alias("distance")), k, key)


def levels(rows: DataFrame, tokens: DataFrame, k: int, dims: int, key: tuple[str, ...] = ("page", "patch")) -> DataFrame:
    """(tok, flips, near, rows): for each token how many rows, and how many of its k nearest, are found from so many flips."""
    bands = dims // BAND
    distance = vectors.hamming_longs(F.col("q_bin"), F.col("bin"), -(-dims // 64)).cast("int")
    each = rows.join(F.broadcast(tokens)).select("tok", *key, distance.alias("distance"), level(F.col("q_bin"), F.col("bin"), bands).alias("flips"))
    near = _first(each, k, key).groupBy("tok", "flips").agg(F.count("*").alias("near"))
    return each.groupBy("tok", "flips").agg(F.count("*").alias("rows")).join(near, ["tok", "flips"], "left").select("tok", "flips", F.coalesce("near", F.lit(0)).alias("near"), "rows")


def calibrate(rows: DataFrame, k: int, dims: int, recall: float = 0.9, sample: int = 16, key: tuple[str, ...] = ("page", "patch")) -> Calibration:
    """The least flips that find ``recall`` of the k nearest of ``sample`` rows (those of the least hashes) on average, by one scan."""
    tokens = rows.orderBy(F.xxhash64("bin", *key)).limit(sample).select(F.xxhash64(*key).alias("tok"), F.col("bin").alias("q_bin"))
    sums = levels(rows, tokens, k, dims, key).groupBy("flips").agg(F.sum("near").alias("near"), F.sum("rows").alias("rows")).orderBy("flips").collect()
    near, read = sum(r["near"] for r in sums), sum(r["rows"] for r in sums)
    some = got = 0
    for r in sums:
        some, got = some + r["near"], got + r["rows"]
        if some >= recall * near:
            return Calibration(r["flips"], some / near, got / read)
    return Calibration(0, 1.0, 1.0)


def nearest(index: SignIndex, rows: DataFrame, tokens: DataFrame, k: int, tuned: Calibration, most_read: float = 0.2) -> DataFrame:
    """Each token's k nearest: by the index as calibrated, or by a scan where the index would read more than ``most_read`` of the rows."""
    if tuned.read > most_read or allowed(tuned.flips, 0, index.bands) > index.most_flips:
        return scan(rows, tokens, k, index.dims, index.key)
    return index.nearest(tokens, k, tuned.flips)


def page_candidates(found: DataFrame, per_token: int) -> DataFrame:
    """(page): the nearest pages of each token by their nearest found patch, united."""
    pages = found.groupBy("tok", "page").agg(F.min("distance").alias("distance"))
    return _first(pages, per_token, ("page",)).select("page").distinct()
