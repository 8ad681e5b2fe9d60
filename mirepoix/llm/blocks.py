"""Cuts the shards of a join within groups in blocks of a bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GUEST, PARTNER, RESIDENT = 0, 1, 2


def in_blocks(rows: DataFrame, shard: list[str], key: str, cap: int) -> DataFrame:
    """rows (shard columns, role, key, ...) with the block (i, j) of their shard that they go to, and their role there.

    In a shard all residents must meet each other and all guests. One with up to `cap` of each is one block. A larger
    one is cut by a hash of `key` in chunks of about cap / 2: a block for each chunk of residents (all RESIDENT),
    for each pair of such chunks (one as GUEST, one as PARTNER), and for each chunk of guests with each of residents
    (GUEST and PARTNER). So every pair that must meet does so in just one block, and no task holds a shard whole.
    """
    count = lambda role: F.sum(F.when(F.col("role") == role, 1).otherwise(0))
    sizes = rows.groupBy(*shard).agg(count(RESIDENT).alias("homes"), count(GUEST).alias("guests"))
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) * 2 / cap)).cast("int")
    large = sizes.where(F.greatest("homes", "guests") > cap).select(*shard, chunks("homes").alias("kh"), chunks("guests").alias("kg"))
    others = [c for c in rows.columns if c != "role"]
    return rows.join(large, shard, "left").select(*others, F.inline(_blocks(key)))


def _blocks(key: str) -> Column:
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    kh, own = F.col("kh"), F.pmod(F.xxhash64(key, F.lit(3)), F.col("kh")).cast("int")
    guest_chunk = kh + F.pmod(F.xxhash64(key, F.lit(3)), F.col("kg")).cast("int")
    with_chunk = lambda j: _block(F.least(j, own), F.greatest(j, own), F.when(j == own, RESIDENT).when(j > own, GUEST).otherwise(PARTNER))
    resident = F.concat(F.transform(upto("kh"), with_chunk), F.transform(upto("kg"), lambda g: _block(kh + g, own, F.lit(PARTNER))))
    guest = F.transform(upto("kh"), lambda i: _block(guest_chunk, i, F.lit(GUEST)))
    whole = F.array(_block(F.lit(0), F.lit(0), F.col("role")))
    return F.when(kh.isNull(), whole).when(F.col("role") == GUEST, guest).otherwise(resident)


def _block(i: Column, j: Column, role: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.cast("byte").alias("role"))
