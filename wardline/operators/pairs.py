"""Exact top-k selection that stays small when one key holds much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 32
# Spark cuts row_number groups on the map side up to this k (windowGroupLimitThreshold).
MAP_SIDE_K = 1000


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, salt_on: str | None = None,
          rank: str = "rank") -> DataFrame:
    """First k rows per key. With `salt_on`, a hot key is cut down in 32 parts first.

    Up to MAP_SIDE_K every map task sends at most k rows per key; for a larger k the
    rows of one input partition form the first part, so no group outgrows a split.
    """
    if salt_on is not None and k > MAP_SIDE_K:
        w = Window.partitionBy(*keys, "_split").orderBy(*order)
        df = (df.withColumn("_split", F.spark_partition_id())
              .withColumn(rank, F.row_number().over(w))
              .where(F.col(rank) <= k).drop("_split", rank))
    if salt_on is not None:
        part = F.pmod(F.xxhash64(salt_on), F.lit(SALTS))
        w = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (df.withColumn("_part", part).withColumn(rank, F.row_number().over(w))
              .where(F.col(rank) <= k).drop("_part", rank))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_pairs(left: DataFrame, right: DataFrame, keys: list[str],
                left_order: list[Column], right_order: list[Column], k: int,
                left_salt: str, right_salt: str) -> DataFrame:
    """The first k pairs per key of the inner join, ordered by the left then the right row.

    Row i of the left with row j of the right is pair number (i-1)*n + j, n being the
    right rows of the key, so only the first k rows of each side can take part and no
    more than k pairs per key leave the join, however often the key repeats.
    """
    a = top_k(left, keys, left_order, k, left_salt, "_i")
    b = top_k(right, keys, right_order, k, right_salt, "_j")
    b = b.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return (
        a.join(b, keys)
        .where((F.col("_i") - 1) * F.col("_n") + F.col("_j") <= k)
        .drop("_i", "_j", "_n")
    )


def name_fanout(gold: DataFrame, silver: DataFrame) -> DataFrame:
    """Rows per name on each side and in the name join, without forming the pairs."""
    a = gold.groupBy("name").agg(F.count(F.lit(1)).alias("gold_rows"))
    b = silver.groupBy("name").agg(F.count(F.lit(1)).alias("silver_rows"))
    return a.join(b, "name").withColumn("pair_rows", F.col("gold_rows") * F.col("silver_rows"))


def name_pairs(gold: DataFrame, silver: DataFrame) -> DataFrame:
    """Per name of the join: its pairs, the trust summed over them in tenths, the best trust and
    the states. Both sides are summed per name first, so no pair is formed."""
    a = gold.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.max("trust_score").alias("best_trust"),
        F.sum(F.round(F.col("trust_score") * 10).cast("bigint")).alias("tenths"))
    b = silver.groupBy("name").agg(F.count(F.lit(1)).alias("m"),
                                   F.count_distinct("address_state").alias("states"))
    return a.join(b, "name").select(
        "name", (F.col("n") * F.col("m")).alias("pair_rows"),
        (F.col("tenths") * F.col("m")).alias("trust_tenths"), "best_trust", "states")
