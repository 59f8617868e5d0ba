"""Contiguous shards of equal bytes, from one global prefix sum. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import plain_columns, settled

RESULT = ("size", "text_crc32", "shard", "slot")
LONG = "long"


def byte_shards(docs: DataFrame, shards: int = 40, row_bytes: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the carried columns, size, text_crc32, shard, slot.

    Rows are laid out in the order of doc_id (null first; then by checksum and size of the text), and the line of all their bytes is cut at equal
    targets: a row belongs to the shard in which the middle of its bytes falls, so a shard differs from the target by half of its first and last row
    at most. Shards are contiguous in that order; slot counts the rows of a shard from 0.

    The prefix sum has two levels. Rows without their texts are range-partitioned; a total per partition (one small row each) gives
    the partition's offset; running sums inside a partition do the rest. No partition holds more than its share of the rows, whatever their keys, and
    what meets in one task is one row per partition. Only whole partitions' totals and one row per shard are broadcast.

    size is the UTF-8 bytes of the text (null: none) plus row_bytes. A null text has the checksum of the empty text. Repeated rows take neighbouring
    slots, no matter which is which. Fewer rows than shards leave shards empty; an empty table gives no rows. Other columns are not looked at.
    """
    octets = F.coalesce(F.octet_length("text"), F.lit(0)).cast(LONG)
    slim = docs.select("doc_id", *carry, (octets + row_bytes).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    dealt = settled(slim.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(F.sum("size").alias("_part_bytes"), F.count("*").alias("_part_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_part_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_part_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_part_bytes").over(Window.partitionBy()).alias("_all_bytes"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    running = dealt.withColumn("_bytes_to", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_row_at", F.row_number().over(inside))
    placed = running.join(F.broadcast(offsets), "_part").select(
        "doc_id",
        *carry,
        "size",
        "text_crc32",
        (F.col("_rows_before") + F.col("_row_at")).alias("_place"),
        # twice the middle of the row on the line of all bytes, against twice the length of the line
        F.expr(f"least(cast(({shards}L * (2 * (_bytes_before + _bytes_to) - size)) div (2 * _all_bytes) as int), {shards - 1})").alias("shard"),
    )
    placed = settled(placed, "placed")
    starts = placed.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(starts), "shard").select("doc_id", *carry, "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).cast(LONG).alias("slot"))


def sharded(docs: DataFrame, shards: int = 40, row_bytes: int = 16) -> DataFrame:
    """byte_shards with the columns of docs other than text and its own carried along."""
    return byte_shards(docs, shards, row_bytes, tuple(c for c in plain_columns(docs, *RESULT) if c not in ("doc_id", "text")))
