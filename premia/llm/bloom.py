"""A two-pass Bloom filter as a small table of bitmaps, built and asked with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's bitmap functions.
SEGMENT = 32768
#: Hash functions; each has its own share of the bits.
HASHES = 2


def filter_bits(rows: int, bits_a_row: int = 32, most: int = 1 << 30) -> int:
    """Bits for so many rows: a power of two, at most `most` (128 MiB), which bounds what is broadcast.

    Past that bound the filter lets more rows through that aren't repeated; results stay the same.
    """
    return min(most, max(1 << 17, 1 << (rows * bits_a_row - 1).bit_length()))


def _cell(key: Column, i: int, bits: int) -> Column:
    share = bits // HASHES
    return F.lit(i * share) + F.pmod(F.xxhash64(F.lit(i), key), F.lit(share))


def _segments(cells: DataFrame) -> DataFrame:
    return cells.groupBy((F.col("cell") / SEGMENT).cast("int").alias("segment")).agg(F.bitmap_construct_agg((F.col("cell") % SEGMENT)).alias("bitmap"))


def repeated(df: DataFrame, key: Column, bits: int) -> DataFrame:
    """First pass: the cells that two rows or more hit, as (segment, bitmap). What is shuffled are counts of cells."""
    cells = df.select(F.explode(F.array(*(_cell(key, i, bits) for i in range(HASHES)))).alias("cell"))
    return _segments(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell"))


def holding(df: DataFrame, key: Column, bits: int) -> DataFrame:
    """The cells of all keys of df, as (segment, bitmap)."""
    return _segments(df.select(F.explode(F.array(*(_cell(key, i, bits) for i in range(HASHES)))).alias("cell")))


def flag(df: DataFrame, key: Column, segments: DataFrame, bits: int, to: str) -> DataFrame:
    """Second pass: adds boolean `to`, false only where the key can't be in the filter. Broadcasts at most bits / 8 bytes."""
    columns = df.columns
    hits = []
    for i in range(HASHES):
        cell = _cell(key, i, bits)
        own = F.broadcast(segments.select(F.col("segment").alias(f"__segment{i}"), F.col("bitmap").alias(f"__bitmap{i}")))
        df = df.join(own, (cell / SEGMENT).cast("int") == F.col(f"__segment{i}"), "left")
        at = cell % SEGMENT
        byte = F.conv(F.hex(F.substring(F.col(f"__bitmap{i}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hits.append(F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False)))
    return df.select(*(F.col(f"`{c}`") for c in columns), (hits[0] & hits[1]).alias(to))
