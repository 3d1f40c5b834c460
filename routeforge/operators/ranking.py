"""Running totals and ranks that never put one whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeforge.session import stage_table


def ranges(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` in ranges of ``order`` of about equal rows, written, with ``range`` numbering them: slices for running_total whatever
    the values are. The number is written with the rows, so that a recomputed task cannot change it."""
    return stage_table(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)


def running_total(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[Column],
    weights: list[str],
) -> DataFrame:
    """Add ``<weight>_before``: sum of each weight over the earlier rows of the group.

    ``bucket`` must be monotone in ``order`` and cut every group into slices of bounded
    size. Slices are summed first (map-side combine), the few slice totals of a group
    are accumulated, and only one slice at a time is ordered: a group of any size is
    spread over as many tasks as it has slices.
    """
    df = df.withColumn("_slice", bucket)
    slice_keys = [*keys, "_slice"]
    earlier_slices = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = df.groupBy(*slice_keys).agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    offsets = offsets.select(
        *slice_keys,
        *[F.coalesce(F.sum(f"_{w}").over(earlier_slices), F.lit(0)).alias(f"_{w}") for w in weights],
    )
    earlier_rows = (
        Window.partitionBy(*slice_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = df.join(offsets, slice_keys)
    return joined.select(
        *[c for c in df.columns if c != "_slice"],
        *[
            (F.col(f"_{w}") + F.coalesce(F.sum(w).over(earlier_rows), F.lit(0))).alias(f"{w}_before")
            for w in weights
        ],
    )


def position_in_group(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str
) -> DataFrame:
    """1-based position of every row in its group, by the same two levels."""
    ranked = running_total(df.withColumn("_one", F.lit(1)), keys, bucket, order, ["_one"])
    return ranked.withColumn(name, (F.col("_one_before") + 1).cast("int")).drop("_one", "_one_before")
