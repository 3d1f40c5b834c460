"""Contiguous balanced shards: global byte prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeforge.llm.prefix_sums import range_staged, with_totals_before

OVERHEAD = 16


def contiguous_shards(docs: DataFrame, shards: int, overhead: int = OVERHEAD) -> DataFrame:
    """Put (doc_id, text) rows, in doc_id order, into ``shards`` runs of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes plus ``overhead``; null text has none), text_crc32 (null text: of no
    bytes), start (bytes before the row), shard and slot (place within the shard, from 0). A row belongs to the shard that holds
    the middle of its bytes, so a shard misses its target by less than one row at either end. Rows with a
    null doc_id come first; rows with equal doc_id are ordered by size and checksum, and rows equal in
    these too are alike in the result. An empty table gives no row. Only the three small columns are shuffled.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()]
    staged = range_staged(sized, order, "shard-sizes")
    placed = with_totals_before(staged, order, {"start": F.col("size"), "row": F.lit(1)})
    total = staged.agg(F.sum("size").alias("total"))  # one row
    middle = F.expr(f"CAST((CAST(2 * start + size AS DECIMAL(38, 0)) * {int(shards)}) DIV (2 * total) AS INT)")
    sharded = placed.crossJoin(F.broadcast(total)).withColumn("shard", F.least(middle, F.lit(int(shards) - 1)))
    firsts = sharded.groupBy("shard").agg(F.min("row").alias("first"))  # a row per shard
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "start", "shard", (F.col("row") - F.col("first")).alias("slot")
    )
