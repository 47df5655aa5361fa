"""Bitmaps and Bloom filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(rows: DataFrame, position: str, by: list[str] | None = None) -> DataFrame:
    """Bitmaps of the values of ``position``: bucket and 4 KB of bits for each 32,768 positions that occur."""
    keys = [*(by or []), F.bitmap_bucket_number(position).alias("bucket")]
    return rows.groupBy(*keys).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits"))


def bits_set(bitmaps: DataFrame, by: list[str]) -> DataFrame:
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def bits_clear(bitmaps: DataFrame, by: list[str]) -> DataFrame:
    return bitmaps.groupBy(*by).agg(F.sum(8 * F.octet_length("bits") - F.bitmap_count("bits")).alias("n"))


def _bytes(bits: Column) -> Column:
    pairs = F.regexp_extract_all(F.hex(bits), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda two: F.conv(two, 16, 10).cast("int"))


def _binary(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def bit_op(a: Column, b: Column, how: str) -> Column:
    """Bitmaps of one length, byte by byte: and, or, xor, andnot."""
    ops = {"and": lambda x, y: x.bitwiseAND(y), "or": lambda x, y: x.bitwiseOR(y), "xor": lambda x, y: x.bitwiseXOR(y), "andnot": lambda x, y: x.bitwiseAND(F.bitwise_not(y))}
    return _binary(F.zip_with(_bytes(a), _bytes(b), ops[how]))


def bit_not(a: Column) -> Column:
    """All bits of a bitmap the other way round."""
    return _binary(F.transform(_bytes(a), lambda x: x.bitwiseXOR(F.lit(255))))


def bit_get(a: Column, position: Column) -> Column:
    """Whether a bit is set; false beyond the map's ends."""
    inside = (position >= 0) & (position < 8 * F.octet_length(a))
    byte = F.conv(F.hex(F.substr(a, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return inside & (F.call_function("shiftright", byte, (position % 8).cast("int")) % 2 == 1)


def bit_range(a: Column, first: Column, last: Column, value: bool) -> Column:
    """A bitmap with the bits ``first`` to ``last`` (both included) set or cleared; what lies outside is ignored."""
    low = lambda k: F.greatest(F.lit(0), F.least(F.lit(8), first - 8 * k)).cast("int")
    high = lambda k: F.greatest(F.lit(0), F.least(F.lit(8), last + 1 - 8 * k)).cast("int")
    one = lambda n: F.call_function("shiftleft", F.lit(1), n)
    mask = lambda k: F.greatest(F.lit(0), one(high(k)) - one(low(k)))
    change = (lambda x, k: x.bitwiseOR(mask(k))) if value else (lambda x, k: x.bitwiseAND(F.lit(255) - mask(k)))
    return _binary(F.transform(_bytes(a), change))


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Positions (one column, the same name in both) in both (and), either (or), one only (xor), or a only (andnot)."""
    if how == "and":
        return a.intersect(b)
    if how == "or":
        return a.union(b).distinct()
    if how == "andnot":
        return a.subtract(b)
    if how == "xor":
        return a.subtract(b).union(b.subtract(a))
    raise ValueError(how)


def _places(key: str, size: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), key), F.lit(size)) for seed in range(hashes)]


def bloom_semi_join(rows: DataFrame, keys: DataFrame, key: str, *, size: int = 1 << 16, hashes: int = 2) -> DataFrame:
    """Rows whose key is in ``keys``: what a Bloom filter lets through, then an exact semi-join.

    The filter is ``size`` bits whatever the number of keys (8 KB as bit positions at most), so
    it is broadcast and drops most rows before they are shuffled.
    """
    places = [keys.select(p.alias("bit")).distinct().withColumn("hit", F.lit(True)) for p in _places(key, size, hashes)]
    passed = rows
    for k, (place, bits) in enumerate(zip(_places(key, size, hashes), places, strict=True)):
        name = f"__bit{k}"
        passed = passed.withColumn(name, place).join(F.broadcast(bits.select(F.col("bit").alias(name))), name, "left_semi")
    return passed.select(*rows.columns).join(keys.select(key).distinct(), key, "left_semi").select(*rows.columns)


def bloom_bits(keys: DataFrame, key: str, *, size: int = 1 << 16, hashes: int = 2) -> DataFrame:
    """The bit positions that a Bloom filter of ``keys`` sets."""
    return reduce(DataFrame.union, (keys.select(p.alias("bit")) for p in _places(key, size, hashes))).distinct()


def set_ranges(ranges: DataFrame, first: str, last: str, size: int) -> DataFrame:
    """The positions that inclusive ranges set in a map of ``size`` bits; what lies outside is ignored."""
    low, high = F.greatest(F.col(first), F.lit(0)), F.least(F.col(last), F.lit(size - 1))
    return ranges.where((F.col(first) <= F.col(last)) & (low <= high)).select(F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("p")).distinct()
