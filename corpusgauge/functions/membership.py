"""A bitmap over keys that is made, sent and asked with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 4,096 rows of 4 KB, 16 MB whatever the number of keys.
BITS = 1 << 27


def _bit(keys: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS)) + 1


def key_bitmap(rows: DataFrame, *keys: str) -> DataFrame:
    """``bucket, bits``: one bit set for each combination of ``keys``.

    Bits are combined before the shuffle, so a task sends 16 MB at most.
    """
    return (
        rows.select(_bit(keys).alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    )


def maybe_among(rows: DataFrame, bitmap: DataFrame, *keys: str) -> DataFrame:
    """The ``rows`` whose ``keys`` may be in the bitmap; none that is in it is lost.

    The bitmap has a fixed size, so it is broadcast and rows are dropped where they are
    scanned.  With more than some ten million keys it fills up and drops fewer rows.
    """
    asked = rows.withColumn("_bit", _bit(keys))
    place = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substr("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return (
        asked.join(F.broadcast(bitmap), F.bitmap_bucket_number("_bit") == F.col("bucket"))
        .filter(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1)
        .select(*rows.columns)
    )
