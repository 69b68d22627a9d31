"""Column functions on byte strings, positions and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_bytes(c: Column) -> Column:
    return c.cast("binary")


def kmer(data: Column, pos: Column, size: int) -> Column:
    """The bytes pos .. pos+size-1, fewer at the end. Binary order is unsigned and a prefix sorts first, so no end marks are needed."""
    return F.substring(data, pos + 1, F.lit(size))


def byte_at(data: Column, pos: Column) -> Column:
    """0..255, null outside the text."""
    return F.conv(F.hex(F.substring(data, pos + 1, F.lit(1))), 16, 10).cast("long")


def range_bucket(x: Column, width: int, buckets: int) -> Column:
    """min(x div width, buckets - 1)."""
    return F.least(F.floor(x / F.lit(width)), F.lit(buckets - 1)).cast("long")


def rank_bucket(rank: Column, width: int, buckets: int) -> Column:
    """The same for ranks that start at 1."""
    return range_bucket(rank - 1, width, buckets)


def sample_index(pos: Column) -> Column:
    """Place of a text position with pos mod 3 = 1 or 2 in the sample, where the two classes alternate."""
    return (F.floor(pos / 3) * 2 + pos % 3 - 1).cast("long")


def sample_position(index: Column) -> Column:
    return (F.floor(index / 2) * 3 + index % 2 + 1).cast("long")
