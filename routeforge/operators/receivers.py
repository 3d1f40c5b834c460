"""Labels and features of receivers before the snap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeforge.constants import (
    DEPTH_BANDS,
    FIELD_LENGTH,
    FIELD_WIDTH,
    PLAY_KEYS,
    ROUTE_CLASSES,
    ROUTE_KEYS,
)
from routeforge.functions import geometry as G
from routeforge.operators import tracking as T
from routeforge.operators.zones import on_plays


def eligible_plays(plays: DataFrame) -> DataFrame:
    """Plays with a result, without a spike, and without a sack in the first 4 seconds."""
    spike, sack = F.col("qbSpike"), F.col("timeToSack")
    return plays.filter(
        F.col("passResult").isNotNull()
        & (~spike | spike.isNull())
        & ((sack > 4) | sack.isNull())
    )


def open_labels(complete: DataFrame, plays: DataFrame, player_play: DataFrame) -> DataFrame:
    """1 for a completed pass that gained more than two yards, 0 for the rest.

    Thrown balls count for the targeted receiver; sacks and scrambles for every runner.
    """
    outcome = eligible_plays(on_plays(complete, plays)).select(
        *PLAY_KEYS, "passResult", "prePenaltyYardsGained"
    )
    runners = T.route_runners(on_plays(complete, player_play)).select(*ROUTE_KEYS, "wasTargettedReceiver")
    result = F.col("passResult")
    counts = (result.isin("C", "I", "IN") & (F.col("wasTargettedReceiver") == 1)) | result.isin("S", "R")
    gained = (result == "C") & (F.col("prePenaltyYardsGained") > 2)
    return (
        outcome.join(runners, PLAY_KEYS)
        .filter(counts)
        .select(*ROUTE_KEYS, F.when(gained, 1).otherwise(0).alias("orpsp_target"))
    )


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("orpsp_target").count().orderBy("orpsp_target")


def play_features(complete: DataFrame, plays: DataFrame) -> DataFrame:
    return on_plays(complete, plays).select(
        *PLAY_KEYS, "down", "yardsToGo", "absoluteYardlineNumber",
        "offenseFormation", "receiverAlignment", "playAction",
    )


def cluster_features(
    complete: DataFrame, clusters: DataFrame, modes: DataFrame, zones: DataFrame
) -> DataFrame:
    centres = zones.select("cluster", "relative_x_mean", "relative_y_mean", "route_time_mean")
    return (
        on_plays(complete, clusters)
        .select(*ROUTE_KEYS, "cluster")
        .join(modes, "cluster")
        .join(centres, "cluster")
    )


def tracking_features(complete: DataFrame, tracking: DataFrame) -> DataFrame:
    """Frames of complete plays, all running right, with the side of each route."""
    kept = tracking.join(T.hashed(complete.select(*PLAY_KEYS)), PLAY_KEYS)
    frames = T.route_direction(T.mirror_left_plays(kept))
    return frames.select(
        *ROUTE_KEYS, "frameType", "frameId", "playDirection", "x", "y", "o", "event", "route_left"
    )


def start_features(frames: DataFrame) -> DataFrame:
    """Last frame before the snap of each player, with the ball's place at that time.

    Takes mirrored frames, or tracking_features that carry route_left already. Without it
    the side is attached to the one start row of a player, not to all frames. Plays
    without a ball drop out. The frame is kept in fixed-width pieces, which lets the
    aggregation run on hashes instead of sorting the frames.
    """
    known_side = "route_left" in frames.columns
    parts = [
        F.max("frameId").alias("frameId"),
        F.max_by(F.col("playDirection") == "left", "frameId").alias("_left"),
        *[F.max_by(c, "frameId").alias(c) for c in ("x", "y", "o")],
    ]
    if known_side:
        parts.append(F.max_by("route_left", "frameId").alias("route_left"))
    starts = T.before_snap(frames).groupBy(*ROUTE_KEYS).agg(*parts)
    ball = starts.filter(F.col("nflId").isNull()).select(
        *PLAY_KEYS, F.col("x").alias("x_ball"), F.col("y").alias("y_ball")
    )
    if not known_side:
        starts = starts.join(T.directions(frames), ROUTE_KEYS, "left")
    direction = F.when(F.col("_left"), "left").when(~F.col("_left"), "right")
    return starts.withColumn("playDirection", direction).drop("_left").join(ball, PLAY_KEYS)


def absolute_zones(features: DataFrame) -> DataFrame:
    """Place the cluster's zone relative to the receiver's start, held on the field."""
    return (
        features.withColumns(
            {
                "absoluteYardlineNumber": F.when(
                    F.col("playDirection") == "left", FIELD_LENGTH - F.col("absoluteYardlineNumber")
                ).otherwise(F.col("absoluteYardlineNumber").cast("double")),
                "relative_y_mean": G.negate_when(~F.col("route_left"), F.col("relative_y_mean")),
            }
        )
        .withColumns(
            {
                "x_recep_zone": G.hold_on_field(F.col("x") + F.col("relative_x_mean"), FIELD_LENGTH),
                "y_recep_zone": G.hold_on_field(F.col("y") + F.col("relative_y_mean"), FIELD_WIDTH),
            }
        )
    )


def receiver_rows(
    play_feats: DataFrame, cluster_feats: DataFrame, starts: DataFrame, players: DataFrame
) -> DataFrame:
    """One row per receiver of a complete play, with its zone on the field."""
    positioned = starts.join(players.select("nflId", "position"), "nflId")
    joined = cluster_feats.join(play_feats, PLAY_KEYS).join(positioned, ROUTE_KEYS)
    return absolute_zones(joined)


def geometry_features(rows: DataFrame) -> DataFrame:
    x, y, zx, zy = (F.col(c) for c in ("x", "y", "x_recep_zone", "y_recep_zone"))
    bx, by, line = (F.col(c) for c in ("x_ball", "y_ball", "absoluteYardlineNumber"))
    return rows.withColumns(
        {
            "dis_recep_zone": G.distance(x, y, zx, zy),
            "dir_recep_zone": G.compass_angle(x, y, zx, zy),
            "recep_zone_dis_out_of_bounds": G.sideline_distance(zy),
            "recep_zone_dis_yard_line": G.from_line(zx, line),
            "dis_ball_to_recep_zone": G.distance(bx, by, zx, zy),
            "dir_ball_to_recep_zone": G.compass_angle(bx, by, zx, zy),
            "dis_out_of_bounds": G.sideline_distance(y),
            "dis_back_of_endzone": G.from_line(x, F.lit(FIELD_LENGTH)),
            "dis_yard_line": G.from_line(x, line),
        }
    )


def play_route_counts(rows: DataFrame) -> DataFrame:
    """Per play: how many routes of each class, and how many zones in each depth band."""
    depth = F.col("x_recep_zone") - F.col("absoluteYardlineNumber")
    bands = []
    for name, (low, high) in DEPTH_BANDS.items():
        inside = F.lit(True)
        if low is not None:
            inside = inside & (depth >= low)
        if high is not None:
            inside = inside & (depth < high)
        bands.append(F.count_if(inside).alias(name))
    classes = [F.count_if(F.col("route_mode") == c).alias(f"nb_{c}") for c in ROUTE_CLASSES]
    return rows.groupBy(*PLAY_KEYS).agg(*classes, F.count("route_mode").alias("nb_routes"), *bands)


def open_features(rows: DataFrame) -> DataFrame:
    """All model features. ``rows`` is read twice, so hand over a written table."""
    return geometry_features(rows).join(play_route_counts(rows), PLAY_KEYS)
