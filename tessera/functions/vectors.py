"""Vector expressions: bit packing, Hamming distance, dot products and late interaction, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_bits(vector: Column, dims: int) -> Column:
    """The signs of a vector (positive is 1) packed to signed bytes, first dimension in the highest bit."""

    def byte(start: Column) -> Column:
        value = F.aggregate(F.slice(vector, start * 8 + 1, 8), F.lit(0), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0))
        return F.when(value > 127, value - 256).otherwise(value).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(dims // 8 - 1)), byte)


def pack_longs(vector: Column, dims: int) -> Column:
    """The signs packed to 64-bit words, for distances by two instructions a word."""

    def word(start: Column) -> Column:
        bits = F.slice(vector, start * 64 + 1, 64)
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: F.call_function("shiftleft", acc, F.lit(1)).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))

    return F.transform(F.sequence(F.lit(0), F.lit(-(-dims // 64) - 1)), word)


def unpack_bits(packed: Column, pm1: bool = False) -> Column:
    """Packed bytes to 0/1 (or -1/+1) doubles, highest bit first."""
    bits = F.flatten(F.transform(packed, lambda b: F.transform(F.sequence(F.lit(7), F.lit(0)), lambda k: F.call_function("shiftright", b.cast("int"), k).bitwiseAND(F.lit(1)).cast("double"))))
    return F.transform(bits, lambda x: x * 2 - 1) if pm1 else bits


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of packed bytes. Bytes are masked: a negative one would extend its sign."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("int").bitwiseXOR(y.cast("int")).bitwiseAND(F.lit(255)))), F.lit(0), lambda acc, x: acc + x)


def hamming_longs(a: Column, b: Column, words: int | None = None) -> Column:
    """Differing bits of two arrays of longs. With their number of ``words`` it is plain arithmetic, which
    whole-stage code generation takes; without, a fold."""
    if words is None:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    out = F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0))))
    for i in range(1, words):
        out = out + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return out


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def inverse_distance(distance: Column) -> Column:
    return F.lit(1.0) / (distance + 1)
