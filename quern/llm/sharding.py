"""Contiguous shards of nearly equal size, by global prefix sums.

Rows are ordered by key and dealt by range into blocks, one block to a partition.
Each block's total is a row of a small table; a running sum over those totals gives
each block its offset, and a running sum inside the block completes the global prefix
sum. Cutting the prefix sums at equal targets gives contiguous shards. All of it is
DataFrame code, no row's text is shuffled, and no task holds more than a block.

Cases: null text has size 0 before the per-row overhead and no checksum; null keys come
first; rows that are equal in key, checksum and size are told apart by their place in the
input; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def byte_shards(df: DataFrame, key: str, text: str, shards: int, row_overhead: int = 16, blocks: int | None = None) -> DataFrame:
    """``(key, size, text_crc32, shard, slot)``: ``shards`` contiguous ranges of equal bytes.

    A row belongs to the shard in which its middle byte falls, so a shard differs from
    the target by half a row at either end. ``slot`` counts a shard's rows from 0.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.col(text).cast("binary")
    rows = df.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + F.lit(row_overhead)).alias("_size"),
        F.crc32(body).alias("_crc"),
        F.monotonically_increasing_id().alias("_at"),
    )
    order = ["_key", "_crc", "_size", "_at"]
    dealt = cut(rows.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()), "shard-rows")

    # One row a block: as many as there are partitions, whatever the number of rows.
    totals = dealt.groupBy("_block").agg(F.sum("_size").alias("_bytes"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        "_block",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_offset"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_block").orderBy(*order)
    placed = (
        dealt.withColumn("_inside", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(inside).cast("long") - 1)
        .join(F.broadcast(offsets), "_block")
        .withColumn("_twice", 2 * (F.col("_offset") + F.col("_inside")) - F.col("_size"))
        .withColumn("shard", F.least(F.expr(f"_twice * {shards} div (2 * _total)"), F.lit(shards - 1)).cast("int"))
    )
    # A shard's rows in one block are adjacent: its slot is the rank in the block, less the first
    # rank that the shard has there, plus its rows in earlier blocks. At most blocks + shards groups.
    groups = placed.groupBy("_block", "shard").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("_block", "shard", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(starts), ["_block", "shard"]).select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "shard",
        (F.col("_row") - F.col("_first") + F.col("_base")).alias("slot"),
    )
