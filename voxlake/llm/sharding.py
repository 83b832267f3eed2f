"""Contiguous shards of near equal size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.tables import saved, whole


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in the order of their ids, into ``shards`` runs of near equal bytes.

    A document's size is its UTF-8 length plus ``overhead``. The narrow rows (id, size, checksum) are
    range-partitioned by id; every partition adds up its own rows, the partition totals (one row each) give
    the offsets of the partitions, and a document belongs to the shard in whose share of all bytes its middle
    lies. Texts are never shuffled.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``. Null texts have no bytes, null ids
    come first, equal ids follow their checksum and size; an empty table gives no rows; columns of ``docs``
    other than the two named play no part.
    """
    text = whole(text_col)
    narrow = docs.select(
        F.col(id_col).alias("key"),
        (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
    )
    order = ["key", "crc", "size"]
    placed = saved(
        narrow.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "shard-rows",
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
        )
    )
    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition: its size is bounded by the number of partitions.
    cut = (
        placed.withColumn("own_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(F.broadcast(parts), "part")
        .withColumn("nth", F.col("rows_before") + F.col("nth"))
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("own_before")) + F.col("size"))
        .withColumn("shard", F.least(F.expr(f"(middle * {shards}) div (2 * all_bytes)"), F.lit(shards - 1)).cast("int"))
    )
    cut = saved(cut.select("key", "size", "crc", "nth", "shard"), "shard-cut")
    first = cut.groupBy("shard").agg(F.min("nth").alias("first"))  # at most ``shards`` rows
    return cut.join(F.broadcast(first), "shard").select(
        F.col("key").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sql(shards: int = 40, overhead: int = 16) -> str:
    """The same for DuckDB; the checksum is made byte by byte from the table of the CRC-32 polynomial."""
    bits = "list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"""
WITH crc AS (SELECT list({bits} ORDER BY i) AS steps FROM range(0, 256) t(i)
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + {overhead} AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents
), sized AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc
), placed AS (
  SELECT *, row_number() OVER w - 1 AS nth, 2 * sum(size) OVER w - size AS middle, sum(size) OVER () AS whole FROM sized
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), cut AS (SELECT *, CAST(least(middle * {shards} // (2 * whole), {shards - 1}) AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""
