"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Each shard has a preference order over a prime number of slots (an offset and a skip from its name's hash); shards take
turns, each claiming the first slot of its order that is still free, until the table is full. A row's slot is its key's
hash modulo the table size, and a broadcast of the table, whose size is the fixed prime, gives the shard: constant time
per row, no shuffle. Shards differ by one slot at most, and a changed list of shards moves few slots.

Defined cases: a null key hashes like the empty string; repeated rows go to the same shard; an empty table gives no
rows; columns ``slot`` and ``shard`` of the input are replaced.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 4099      # prime, over 100 slots per shard
SHARDS = 32
MAX_TABLE = 1 << 20    # bound of what is broadcast: 12 MB


def digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the owning shard by slot."""
    if size > MAX_TABLE or size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"the table size must be a prime up to {MAX_TABLE}")
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("shard names must be distinct, and no more than slots")
    offsets = [digest(f"{s}|offset") % size for s in shards]
    skips = [digest(f"{s}|skip") % (size - 1) + 1 for s in shards]
    owner, at, left = [-1] * size, offsets[:], size
    while left:
        for i in range(min(len(shards), left)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skips[i]) % size
            owner[at[i]] = i
            left -= 1
    return owner


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    owner = lookup_table(shards, size)
    return spark.createDataFrame([(slot, shards[i]) for slot, i in enumerate(owner)], "slot long, shard string")


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(size)


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row."""
    table = table_frame(df.sparkSession, shards, size).withColumnRenamed("slot", "_slot")
    placed = df.drop("shard").withColumn("slot", slot_of(F.col(key), size))
    return placed.join(F.broadcast(table), F.col("slot") == F.col("_slot")).drop("_slot")


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, files_per_shard: int = 1,
                 size: int = TABLE_SIZE) -> None:
    """Write one folder per shard; rows of a shard are spread over ``files_per_shard`` tasks by their slot."""
    placed = place(df, key, shards, size)
    part = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    (placed.repartition(len(shards) * files_per_shard, "shard", part)
     .write.mode("errorifexists").partitionBy("shard").parquet(path))
