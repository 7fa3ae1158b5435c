"""Sharding by bytes: contiguous runs of documents, cut at equal targets of the global prefix sum.

Documents are put in order by range partitions; each partition has a total of bytes and rows, the running sums of these
few totals give every partition its offset, and a sum inside the partition gives every document its place in the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, text_key
from tidemark.session import staged

SHARDS = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every document: doc_id, size, text_crc32, shard (from 0), slot (gapless from 0 in each shard).

    Order: doc_id (NULL last), then a digest of the text, so the shards are contiguous runs of doc_id. Size is the text's UTF-8
    bytes plus 1 (NULL text: 1, and the crc of an empty text). A document goes to the shard that holds the middle of its
    bytes, so shards differ from the equal target by less than the largest document. Repeated rows each
    have a slot of their own. Other columns are not read. No documents: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("size"),
                       F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), text_key(F.col("text")).alias("th"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("th"), F.col("size")]
    # written once: the partition and the row's number in it are then fixed, whatever is lost and run again
    rows = staged(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
                  .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("uid")))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(every).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy("uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.withColumn("end", F.sum("size").over(inside)).withColumn("place", F.row_number().over(inside))
              .join(offsets, "part")
              .withColumn("shard", F.expr(f"cast(((2 * (bytes_before + `end`) - size) * {shards}) div (2 * all_bytes) as int)"))
              .withColumn("place", F.col("rows_before") + F.col("place") - 1))
    # the shards' first places follow from the first and last row of each (partition, shard)
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return placed.join(starts, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("start")).alias("slot"))
