"""A bitmap of bounded size that thins out rows before they are fetched in full."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap's size at least and at most: 1 MB and 32 MB are broadcast. Where the most would fill up, nothing is thinned.
LEAST_BITS, MOST_BITS = 23, 28


def thinned(df: DataFrame, key: str, wanted: DataFrame, count: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` (a hash) may be in ``wanted`` (one column, ``count`` rows): none that is there gets lost, some others stay. The bitmap has some 16 bits a row."""
    size = max(LEAST_BITS, (16 * count).bit_length())
    if count > 1 << (MOST_BITS - 1):
        return df
    at = f"pmod({key}, {2 ** min(size, MOST_BITS)})"
    hashed = f"`{wanted.columns[0]}`"
    bits = wanted.selectExpr(f"pmod({hashed}, {2 ** min(size, MOST_BITS)}) AS _at").groupBy(F.expr("bitmap_bucket_number(_at)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_at))").alias("_bits"))
    held = df.withColumn("_at", F.expr(at)).withColumn("_bucket_of", F.expr("bitmap_bucket_number(_at)"))
    there = "getbit(cast(conv(hex(substring(_bits, cast(shiftright(bitmap_bit_position(_at), 3) AS int) + 1, 1)), 16, 10) AS bigint), cast(bitmap_bit_position(_at) % 8 AS int)) = 1"
    return held.join(F.broadcast(bits), F.col("_bucket_of") == F.col("_bucket")).where(there).drop("_at", "_bucket", "_bucket_of", "_bits")
