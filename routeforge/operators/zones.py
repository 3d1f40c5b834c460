"""Clusters of routes: nearest exemplar, route class, reception zone, complete plays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeforge.constants import (
    PLAY_KEYS,
    ROUTE_CLASS,
    ROUTE_KEYS,
    SECONDS_PER_FRAME,
    SHAPE_FEATURES,
    ZONE_COLUMNS,
)
from routeforge.operators.nearest import FEW, nearest, nearest_of_few, shape_struct
from routeforge.operators.tracking import route_runners, targeted
from routeforge.session import stage_table

#: Up to so many exemplars are compared with every route where it lies; more are looked up in an index.
EXEMPLAR_BLOCK = FEW


def nearest_exemplar(
    features: DataFrame, exemplars: DataFrame, columns: list[str] = SHAPE_FEATURES
) -> DataFrame:
    """Add ``cluster``: the exemplar nearest to each row, ties to the lowest number.

    ``exemplars`` is a table of (cluster, columns...). Up to EXEMPLAR_BLOCK of them are
    compared with each row. Of more, distinct shapes look theirs up in a
    metric index, by equi-joins on cells, so neither table is held in one piece anywhere. A
    missing spread (one-frame route) counts as zero.
    """
    if exemplars.limit(EXEMPLAR_BLOCK + 1).count() <= EXEMPLAR_BLOCK:
        shaped = features.drop("cluster").select(F.struct("*").alias("row"), shape_struct(columns))
        found = nearest_of_few(shaped, exemplars.select("cluster", shape_struct(columns)), columns)
        return found.select("row.*", "cluster")
    marked = features.drop("cluster").withColumn("_shape", shape_struct(columns))
    shapes = marked.select(F.col("_shape").alias("shape")).distinct()
    shapes = stage_table(shapes.withColumn("id", F.monotonically_increasing_id()), "shapes")
    known = stage_table(exemplars.select("cluster", shape_struct(columns)), "exemplars")
    looked_up = nearest(shapes, known, columns).select(F.col("shape").alias("_shape"), "cluster")
    return marked.join(looked_up, "_shape").drop("_shape")


def first_exemplars(features: DataFrame, player_play: DataFrame) -> DataFrame:
    """One route per charted name, that of least key, as a model-free set of exemplars."""
    named = features.join(
        route_runners(player_play).select(*ROUTE_KEYS, "routeRan"), ROUTE_KEYS
    ).filter(F.col("routeRan").isNotNull())
    key = F.struct(*ROUTE_KEYS)
    picked = named.groupBy("routeRan").agg(
        F.min_by(F.struct(*SHAPE_FEATURES), key).alias("shape")
    )
    # One row per name is left: numbering them is a small ordered step.
    number = F.row_number().over(Window.orderBy("routeRan")) - 1
    return picked.select(number.alias("cluster"), "shape.*")


def with_clusters(data: DataFrame, clusters: DataFrame, how: str = "left") -> DataFrame:
    return data.join(clusters.select(*ROUTE_KEYS, "cluster"), ROUTE_KEYS, how)


def route_class(name: Column) -> Column:
    """Class of a charted route name; unknown names pass through."""
    known = F.create_map(*[F.lit(v) for pair in ROUTE_CLASS.items() for v in pair])
    return F.coalesce(F.element_at(known, name), name)


def cluster_modes(player_play: DataFrame, clusters: DataFrame) -> DataFrame:
    """Most frequent charted name of each cluster, as a class; ties to the smallest name.

    Counting by (cluster, name) first keeps a cluster of any size down to a few rows.
    """
    counted = (
        with_clusters(player_play.select(*ROUTE_KEYS, "routeRan"), clusters, "inner")
        .groupBy("cluster", "routeRan")
        .agg(F.count("*").alias("n"))
    )
    order = F.struct(F.col("routeRan").isNull(), -F.col("n"), F.col("routeRan"))
    return counted.groupBy("cluster").agg(F.min_by("routeRan", order).alias("routeRan")).select(
        "cluster", route_class(F.col("routeRan")).alias("route_mode")
    )


def zone_bounds(arrivals: DataFrame, keys: list[str]) -> DataFrame:
    """Extent and centre of the arrival points of each group, before widening."""
    return arrivals.groupBy(*keys).agg(
        *[
            how(f"relative_{axis}").alias(f"relative_{axis}_{name}")
            for axis in ("x", "y")
            for name, how in (("min", F.min), ("max", F.max), ("mean", F.avg))
        ],
        F.avg("route_frameId").alias("route_frameId_mean"),
    )


def widen_zones(zones: DataFrame) -> DataFrame:
    """Push out an edge within a yard of the centre, and add the mean time of arrival."""
    changed = {}
    for axis in ("x", "y"):
        low, high, mean = (F.col(f"relative_{axis}_{k}") for k in ("min", "max", "mean"))
        changed[f"relative_{axis}_min"] = F.when(F.abs(mean - low) < 1, mean - 3).otherwise(low)
        changed[f"relative_{axis}_max"] = F.when(F.abs(high - mean) < 1, mean + 3).otherwise(high)
    changed["route_time_mean"] = F.col("route_frameId_mean") * SECONDS_PER_FRAME
    return zones.withColumns(changed)


def arrival_frames(relative: DataFrame, player_play: DataFrame) -> DataFrame:
    """Frames in which a pass arrived at its targeted receiver."""
    aimed = targeted(player_play).select(*ROUTE_KEYS)
    return aimed.join(relative.filter(F.col("event") == "pass_arrived"), ROUTE_KEYS)


def reception_zones(player_play: DataFrame, clustered_frames: DataFrame) -> DataFrame:
    known = clustered_frames.filter(F.col("cluster").isNotNull())
    zones = zone_bounds(arrival_frames(known, player_play), ["cluster"])
    return widen_zones(zones).select(*ZONE_COLUMNS)


def complete_plays(player_play: DataFrame, clusters: DataFrame) -> DataFrame:
    """Plays in which every route runner has a cluster."""
    return _runner_coverage(player_play, clusters).filter("complete").select(*PLAY_KEYS)


def incomplete_play_count(player_play: DataFrame, clusters: DataFrame) -> DataFrame:
    return _runner_coverage(player_play, clusters).agg(
        F.count_if(~F.col("complete")).alias("incomplete_plays")
    )


def _runner_coverage(player_play: DataFrame, clusters: DataFrame) -> DataFrame:
    runners = route_runners(player_play).select(*ROUTE_KEYS)
    return (
        with_clusters(runners, clusters)
        .groupBy(*PLAY_KEYS)
        .agg(F.bool_and(F.col("cluster").isNotNull()).alias("complete"))
    )


def on_plays(plays: DataFrame, data: DataFrame) -> DataFrame:
    """Restrict data to the given plays."""
    return data.join(plays.select(*PLAY_KEYS), PLAY_KEYS)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").count()


def largest_clusters(clusters: DataFrame, how_many: int = 10) -> DataFrame:
    return cluster_sizes(clusters).orderBy(F.desc("count"), "cluster").limit(how_many)
