"""Running totals over a whole table without a single-task sort: range partitions, then their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeforge.session import stage_table


def range_staged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written once, with ``part_`` naming the partition.

    The partition number is written with the rows, so that a recomputed task cannot renumber them.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage_table(parts.withColumn("part_", F.spark_partition_id()), name)


def with_totals_before(staged: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, per (name, value), the sum of value over all rows before this one in ``order``; rows that
    tie in ``order`` get one fixed but arbitrary order.

    Totals of the partitions are summed first (one row each), then rows within each partition; the
    number of partitions follows ``spark.sql.shuffle.partitions``, and no partition holds more than a
    range of the order.
    """
    totals = staged.groupBy("part_").agg(*[F.sum(v).alias(f"{n}_total_") for n, v in sums.items()])
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "part_", *[F.coalesce(F.sum(f"{n}_total_").over(earlier), F.lit(0)).alias(f"{n}_base_") for n in sums]
    )
    within = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = staged.select(
        "*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"{n}_within_") for n, v in sums.items()]
    ).join(F.broadcast(bases), "part_")  # one row per shuffle partition
    for n in sums:
        out = out.withColumn(n, F.col(f"{n}_base_") + F.col(f"{n}_within_")).drop(f"{n}_base_", f"{n}_within_")
    return out
