"""Joins with a key set that spare most rows the shuffle, at any size of the key set.

The keys set bits of a bitmap of fixed size, which is broadcast: its size does not depend on the
data. Rows whose bit is off cannot be in the set and stay where they are; the others are decided by
an ordinary join. With so many keys that most bits are on, most rows take the join; the result is
the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.sources.scratch import materialise

#: Bits of the filter: 4 MB. Spark's bitmap functions hold 32,768 bits a bucket, so it has 1,024 rows.
FILTER_BITS = 1 << 25


def _bit(key: Column) -> Column:
    # A finalising multiply keeps these bits apart from those that hash partitioning uses.
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(FILTER_BITS))


def bitmap_of(keys: DataFrame, key: Column) -> DataFrame:
    """At most 1,024 rows (bucket, bits): the bit of every key is on."""
    bit = _bit(key)
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("__bits")
    )


def flagged(df: DataFrame, key: Column, bitmap: DataFrame, flag: str) -> DataFrame:
    """Add whether the key's bit is on: false means surely not in the set."""
    position = F.bitmap_bit_position(_bit(key))
    byte = F.conv(F.hex(F.substring("__bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    on = F.getbit(byte.cast("int"), (position % 8).cast("int")) == 1
    tagged = df.withColumn("__bucket", F.bitmap_bucket_number(_bit(key)))
    joined = tagged.join(F.broadcast(bitmap), "__bucket", "left")
    return joined.select(*df.columns, F.coalesce(on, F.lit(False)).alias(flag))


def semi_join(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``keys`` (one column of that name, not NULL)."""
    near = flagged(df, F.col(key), bitmap_of(keys, F.col(key)), "__on").where("__on").drop("__on")
    return near.join(keys, key, "left_semi")


def anti_join(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``keys``. ``df`` is read twice: give a stored table."""
    bitmap = materialise(bitmap_of(keys, F.col(key)), "bitmap")
    seen = flagged(df, F.col(key), bitmap, "__on")
    off = seen.where("not __on").drop("__on")
    on = seen.where("__on").drop("__on").join(keys, key, "left_anti")
    return off.unionByName(on)
