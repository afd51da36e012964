"""Operator 5, sharding: global prefix sums of byte sizes, cut at equal targets.

Rows are dealt into ranges of their key and written with the number of their range. Totals of the ranges,
summed up in order, say how many bytes and rows stand before each range; within a range a window adds up
its own rows. A row goes to the shard in which its middle byte falls, so shards are contiguous and no
shard's size is further from the mean than one row.

Order: the key ascending, nulls last, then checksum and size; rows that still tie are alike in all that is
used here, and a last number only makes ranges that cut through a run of them. Null texts have size 1. An
empty table gives no rows. Columns other than the key and the text aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, table, whole_text

SHARDS = 8


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, size (bytes and 1), text_crc32, shard, slot (from 0 in its shard) and byte_start (bytes before
    it in all)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    n = partitions(spark)
    text = whole_text(text_column)
    sizes = scratch.write(docs.select(F.col(id_column).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc")), "sizes")
    keyed = sizes.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_last(), F.col("crc"), F.col("size"), F.col("tie")]
    # the range of a row is written down: later readers can't come to another division
    ranged = scratch.write(keyed.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged")
    scratch.drop(sizes)
    # one row a range: as many as shuffle partitions, however large the input
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy(*order)
    row = (
        ranged.withColumn("end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("number", F.row_number().over(within))
        .join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("bytes_before") + F.col("end") - F.col("size"))
    )
    # (start + size / 2) * shards / total, in whole numbers
    shard = F.least(F.lit(shards - 1), F.expr(f"(2 * start + size) * {shards} div (2 * total)")).cast("int")
    placed = scratch.write(row.select("id", "size", "crc", shard.alias("shard"), (F.col("rows_before") + F.col("number") - 1).alias("rank"), "start"), "placed")
    scratch.drop(ranged)
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.col("start").alias("byte_start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents in 8 shards of near equal bytes."""
    rows = shard_by_bytes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
