"""Balanced contiguous shards from global prefix sums of byte sizes; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import checkpoint, partitions


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts the rows, in the order of their ids, into contiguous shards of nearly equal byte size.

    A row's size is the UTF-8 length of its text (null: 0) plus 1. Rows are range-partitioned by id; the totals of the
    partitions give each one's offset; a row goes to the shard in whose equal part of all bytes its first byte falls, so a
    shard is off its target by one text at most. Texts never move: only id, size and checksum are shuffled.

    Null ids come first; equal ids are ordered by checksum and size; equal rows are interchangeable. An empty table gives
    an empty result. More columns of the input, whatever their names, play no part.
    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null: of law "key").
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    # The range bounds come from a sample, so the placed rows are written before anything is derived from their places.
    placed = checkpoint(sized.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    before, everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = (
        placed.groupBy("part")
        .agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"), F.sum("b").over(everything).alias("total"))
    )  # one row for each partition
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (
        placed.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.count("*").over(inside))
        .join(F.broadcast(offsets), "part")
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((byte0 + upto - size) * {int(n_shards)}) div total")).cast("int"))
        .withColumn("row", F.col("row0") + F.col("nth") - 1)
    )
    first = at.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows
    return at.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
