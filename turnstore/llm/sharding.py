"""Sharding (operator 9): contiguous shards of equal bytes, from global prefix sums; DataFrame operations only.

Rows are range-partitioned by id; the total bytes and rows of each partition (a few numbers for each) are summed up
in order, and added to running sums inside each partition. A row goes to the shard in whose equal share of all bytes
its middle lies, so shards are contiguous in the order and their bytes differ by the size of a row at most.

Defined cases: a null text has no bytes, so size 1, and the CRC of the empty string; a null id comes first; repeated
rows and ids are ordered by CRC and then by place, so that a single id may hold any share of the rows; an empty table
gives an empty result; a shard may stay empty where rows are larger than a share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstore.llm.common import materialise, text_or_empty

SHARDS = 8


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, shard and slot (the row's place in its shard, from 0)."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_or_empty(text), "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_at"),
    )
    order = [F.col(id_col), F.col("text_crc32"), F.col("_at")]
    rows = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    before = F.col("_bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    twice_middle = 2 * before + F.col("size")
    # bounded: as many rows as partitions
    placed = rows.join(F.broadcast(starts), "_part").select(
        id_col,
        "size",
        "text_crc32",
        F.call_function("div", twice_middle * shards, 2 * F.col("_total")).cast("int").alias("shard"),
        (F.col("_rows_before") + F.row_number().over(inside) - 1).alias("_index"),
    )
    placed = materialise(placed)
    begins = placed.groupBy("shard").agg(F.min("_index").alias("_first"))  # one row for each shard
    return placed.join(F.broadcast(begins), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot"))
