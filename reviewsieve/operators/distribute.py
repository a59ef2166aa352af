"""Ranking and joining patterns that stay spread out when one key holds much of the data."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_BUCKETS = 4096
SALTS = 64


def hash_rank(df: DataFrame, id_col: str, seed: int, within: Sequence[str] = (),
              buckets: int = RANK_BUCKETS, name: str = "hash_rank") -> DataFrame:
    """Add the exact 0-based rank of every row in pseudo-random order, per ``within`` group.

    The order is that of the MD5 of "seed|id", which other engines have too, so it does not depend on how
    rows are partitioned. A group may be the whole table: rows are ranked inside
    hash buckets, and the sizes of the earlier buckets (groups x buckets numbers)
    are added. Also adds the group size as ``group_size``.
    """
    keys = list(within)
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")))
    # buckets in the order of the hash, by its first six digits
    lead = F.conv(F.substring("_h", 1, 6), 16, 10).cast("long")
    hashed = hashed.withColumn("_b", F.floor(lead * buckets / F.lit(16 ** 6)).cast("int"))
    sizes = hashed.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_ob"),
        (F.sum("_n").over(whole.orderBy("_b")) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(whole).alias("group_size"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", id_col)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_ob")]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return (hashed.withColumn("_r", F.row_number().over(inside)).join(offsets, condition)
            .withColumn(name, F.col("_offset") + F.col("_r") - 1)
            .drop("_h", "_b", "_r", "_ob", "_offset", *[f"_k{i}" for i in range(len(keys))]))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          name: str = "rank") -> DataFrame:
    """First ``k`` rows per group with their 1-based rank.

    Spark limits each group inside the map tasks before the shuffle, so a large
    group sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def salted_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Column,
               salt_of: Column, name: str = "rank") -> DataFrame:
    """First rows per group, where the number to keep is a column.

    A first pass ranks within salted parts of the group and drops what cannot be
    among the first; the second pass ranks the few rows left.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(SALTS)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= keep).drop("_r", "_salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    return few.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= keep)


def running_total(df: DataFrame, order_col: str, value_cols: Sequence[str], parts: int = 256) -> DataFrame:
    """Add ``before_<v>``: the sum of ``v`` over all rows with a smaller ``order_col``.

    ``order_col`` must be unique. The table is cut at approximate quantiles so
    that no task sees more than a share of it; only one row per part is summed
    in one place.
    """
    cuts = df.agg(F.percentile_approx(order_col, [i / parts for i in range(1, parts)], 10 * parts).alias("c"))
    placed = df.withColumn("_edges", F.array_distinct(cuts.scalar())).withColumn(
        "_p", F.size(F.filter("_edges", lambda e: e <= F.col(order_col)))).drop("_edges")
    whole = Window.partitionBy(F.lit(0)).orderBy("_p")
    sums = placed.groupBy("_p").agg(*[F.sum(v).alias(v) for v in value_cols]).select(
        F.col("_p").alias("_q"), *[(F.sum(v).over(whole) - F.col(v)).alias(f"_base_{v}") for v in value_cols])
    inside = Window.partitionBy("_p").orderBy(order_col)
    ranked = placed.select("*", *[(F.sum(v).over(inside) - F.col(v)).alias(f"_in_{v}") for v in value_cols])
    out = ranked.join(F.broadcast(sums), F.col("_p") == F.col("_q"))  # one row per part
    return out.select(*df.columns, *[(F.col(f"_base_{v}") + F.col(f"_in_{v}")).alias(f"before_{v}")
                                     for v in value_cols])
