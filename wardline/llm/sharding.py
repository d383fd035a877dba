"""Contiguous shards of near equal bytes, by DataFrame functions only.

Rows are range-partitioned in id order; every partition sums its sizes, the running sum of
these totals (one row per partition) gives each partition its place in the global order, and a
running sum inside the partition gives each row its place. The global sum is cut at equal
targets; a row belongs to the shard that holds its middle byte.

Defined cases: null texts have size 16 and a null crc; rows with equal ids are ordered by text
hash and copies of a row are interchangeable; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wardline.llm.common import Steps

SHARDS = 40
#: Rows that one range partition of the narrow rows holds, about.
ROWS_PER_PART = 200_000
LAW = "bytes"


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS,
                   rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    spark = docs.sparkSession
    steps = Steps(spark)
    narrow = steps.put("sizes", docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32")))
    order = ["doc_id", "text_crc32", "size"]
    parts = max(1, -(-narrow.count() // rows_per_part),
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = steps.put("ordered", narrow.withColumn("tie", F.rand(17)).repartitionByRange(
        parts, *order, "tie").withColumn("part", F.spark_partition_id()))
    steps.drop("sizes")
    inside = Window.partitionBy("part").orderBy(*order, "tie")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"),
                                         F.count(F.lit(1)).alias("rows")).select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    whole = ordered.agg(F.sum("size").alias("whole"))
    placed = ordered.select("*", F.sum("size").over(inside.rowsBetween(
        Window.unboundedPreceding, 0)).alias("bytes_in"), F.row_number().over(inside).alias("row_in")) \
        .join(totals, "part").crossJoin(F.broadcast(whole))
    end = F.col("bytes_before") + F.col("bytes_in")
    middle = (2 * end - F.col("size")).cast("decimal(38,0)")
    shard = F.least(F.floor(middle * shards / (2 * F.col("whole"))), F.lit(shards - 1)).cast("int")
    placed = steps.put("placed", placed.select(
        "doc_id", "size", "text_crc32", shard.alias("shard"),
        (F.col("rows_before") + F.col("row_in") - 1).alias("place")))
    steps.drop("ordered")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
