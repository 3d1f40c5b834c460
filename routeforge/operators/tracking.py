"""From raw player tracking to routes measured from their start point.

Keys can be skewed, so per-player values are aggregated (with map-side combine) and
joined back: the joins can be split by AQE, a window over the raw frames could not.
What is joined to frames is hashed, so that frames are never sorted, and frames that are
filed by play are not moved either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeforge.constants import FIELD_WIDTH, MAX_ROUTE_FRAME, ROUTE_KEYS
from routeforge.functions import geometry as G


def before_snap(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("frameType") == "BEFORE_SNAP")


def after_snap(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("frameType") == "AFTER_SNAP")


def mirror_left_plays(frames: DataFrame) -> DataFrame:
    """Turn plays that run left so that all run right.

    The two angles are only known for turned plays; they are null on the others.
    """
    left = F.col("playDirection") == "left"
    return frames.withColumns(
        {
            "x": G.mirrored_x(F.col("x"), F.col("playDirection")),
            "y": G.mirrored_y(F.col("y"), F.col("playDirection")),
            "o": F.when(left, G.half_turn(F.col("o"))),
            "dir": F.when(left, G.half_turn(F.col("dir"))),
        }
    )


def hashed(df: DataFrame) -> DataFrame:
    """Rows per player or play, to be joined to frames."""
    return df.hint("shuffle_hash")


def route_runners(player_play: DataFrame) -> DataFrame:
    return player_play.filter(F.col("wasRunningRoute") == 1)


def targeted(player_play: DataFrame) -> DataFrame:
    return player_play.filter(F.col("wasTargettedReceiver") == 1)


def route_tracking(frames: DataFrame, player_play: DataFrame) -> DataFrame:
    """Frames of players who ran a route, with the charted route name."""
    return frames.join(hashed(route_runners(player_play).select(*ROUTE_KEYS, "routeRan")), ROUTE_KEYS)


def start_points(frames: DataFrame) -> DataFrame:
    """Last position before the snap, per player of a play."""
    return (
        before_snap(frames)
        .groupBy(*ROUTE_KEYS)
        .agg(
            F.max_by("x", "frameId").alias("x_start"),
            F.max_by("y", "frameId").alias("y_start"),
            F.max("frameId").alias("frameId_start"),
        )
    )


def _on_route(max_route_frame: int):
    return (F.col("frameId") - F.col("frameId_start") - 1) <= max_route_frame


def _reach(frames: DataFrame, starts: DataFrame, max_route_frame: int) -> DataFrame:
    """Start points of players who moved after the snap, with the side they went to.

    Only keys, frame and y of the frames are shuffled here.
    """
    moving = after_snap(frames).select(*ROUTE_KEYS, "frameId", "y")
    carried = [c for c in starts.columns if c not in ROUTE_KEYS]
    return (
        moving.join(hashed(starts), ROUTE_KEYS)
        .filter(_on_route(max_route_frame))
        .groupBy(*ROUTE_KEYS)
        .agg(F.max_by("y", "frameId").alias("_y_end"), *[F.max(c).alias(c) for c in carried])
        .withColumn("route_left", F.col("_y_end") > F.col("y_start"))
        .drop("_y_end")
    )


def directions(frames: DataFrame, max_route_frame: int = MAX_ROUTE_FRAME) -> DataFrame:
    """(game, play, player) -> route_left; players without frames after the snap are absent."""
    known = frames.filter(F.col("nflId").isNotNull())
    return _reach(known, start_points(known).drop("x_start"), max_route_frame).select(
        *ROUTE_KEYS, "route_left"
    )


def route_direction(frames: DataFrame, max_route_frame: int = MAX_ROUTE_FRAME) -> DataFrame:
    """Add route_left: the last frame on the route lies left of the start (a tie is right)."""
    return frames.join(hashed(directions(frames, max_route_frame)), ROUTE_KEYS, "left")


def mirror_right_routes(frames: DataFrame) -> DataFrame:
    """Turn routes that go right so that all go left; an unknown side is left alone."""
    return frames.withColumn("y", G.flip_when(~F.col("route_left"), F.col("y"), FIELD_WIDTH))


def _measure(frames: DataFrame, anchors: DataFrame, max_route_frame: int) -> DataFrame:
    return (
        after_snap(frames)
        .join(hashed(anchors), ROUTE_KEYS)
        .filter(_on_route(max_route_frame))
        .withColumns(
            {
                "relative_x": F.col("x") - F.col("x_start"),
                "relative_y": F.col("y") - F.col("y_start"),
                "route_frameId": F.col("frameId") - F.col("frameId_start") - 1,
            }
        )
    )


def _arrivals(frames: DataFrame, starts: DataFrame, player_play: DataFrame, max_route_frame: int) -> DataFrame:
    """Per targeted receiver, the route frames in which the pass arrived, with counts.

    Counting first bounds the list by the route horizon, whatever the number of copies.
    """
    aimed = targeted(player_play).select(*ROUTE_KEYS)
    return (
        after_snap(frames)
        .filter(F.col("event") == "pass_arrived")
        .select(*ROUTE_KEYS, "frameId")
        .join(hashed(aimed), ROUTE_KEYS)
        .join(hashed(starts.select(*ROUTE_KEYS, "frameId_start")), ROUTE_KEYS)
        .filter(_on_route(max_route_frame))
        .groupBy(*ROUTE_KEYS, (F.col("frameId") - F.col("frameId_start") - 1).alias("at"))
        .agg(F.count("*").alias("times"))
        .groupBy(*ROUTE_KEYS)
        .agg(F.collect_list(F.struct("at", "times")).alias("arrivals"))
    )


def _arrivals_from(frame: Column) -> Column:
    """How often the pass arrived at this route frame or later."""
    return F.aggregate(
        "arrivals",
        F.lit(0).cast("bigint"),
        lambda total, a: total + F.when(a["at"] >= frame, a["times"]).otherwise(F.lit(0)),
    )


def _kept_copies(measured: DataFrame) -> DataFrame:
    """Keep a receiver's frames up to each arrival; ``copies`` counts the arrivals that
    keep a frame. Receivers without an arrival keep every frame once."""
    copies = F.when(F.col("arrivals").isNull(), F.lit(1)).otherwise(_arrivals_from(F.col("route_frameId")))
    return (
        measured.withColumn("copies", copies)
        .filter(F.col("copies") > 0)
        .drop("arrivals")
    )


def repeat_copies(df: DataFrame) -> DataFrame:
    """One row per copy, as an arrival-by-arrival join would give."""
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).drop(
        "_copy", "copies"
    )


def relative_route(
    frames: DataFrame,
    player_play: DataFrame,
    max_route_frame: int = MAX_ROUTE_FRAME,
    weighted: bool = False,
) -> DataFrame:
    """Route frames measured from their start point, cut where the pass arrived.

    With ``weighted`` each frame comes once, with its number of ``copies``.
    """
    starts = start_points(frames)
    measured = _measure(frames, starts, max_route_frame)
    arrivals = _arrivals(frames, starts, player_play, max_route_frame)
    cut = _kept_copies(measured.join(hashed(arrivals), ROUTE_KEYS, "left"))
    return cut if weighted else repeat_copies(cut)


def _listed(moving: DataFrame, first: list[str]) -> DataFrame:
    """Per player its frames as one list, equal ones merged with their number of ``times``; ``first`` has one value per player.

    Frames are ordered once, where they lie. So both aggregates run through them without a table of groups, and a list is as
    long as the horizon, whatever the number of copies.
    """
    frame = ["frameId", "week", "x", "y", "event"]
    merged = (
        moving.sortWithinPartitions(*ROUTE_KEYS, *frame)
        .groupBy(*ROUTE_KEYS, *frame)
        .agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in first])
    )
    return merged.sortWithinPartitions(*ROUTE_KEYS).groupBy(*ROUTE_KEYS).agg(
        F.collect_list(F.struct(*frame, "times")).alias("frames"), *[F.first(c).alias(c) for c in first]
    )


def _with_arrivals(routes: DataFrame, player_play: DataFrame) -> DataFrame:
    """Listed routes with the side they went to, the arrivals at targeted receivers, and how often their player ran."""
    ran = route_runners(player_play).groupBy(*ROUTE_KEYS).agg(F.count("*").alias("ran"))
    aimed = targeted(player_play).groupBy(*ROUTE_KEYS).agg(F.count("*").alias("_aimed"))
    start = F.col("frameId_start") + 1
    # Each targeting counts for itself, as in a join.
    arrived = F.transform(
        F.filter("frames", lambda f: f["event"] == "pass_arrived"),
        lambda f: F.struct((f["frameId"] - start).alias("at"), (f["times"] * F.col("_aimed")).alias("times")),
    )
    return (
        routes.join(hashed(ran), ROUTE_KEYS)
        .join(hashed(aimed), ROUTE_KEYS, "left")
        .withColumn("route_left", F.array_max("frames")["y"] > F.col("y_start"))
        .withColumn("y_start", G.flip_when(~F.col("route_left"), F.col("y_start"), FIELD_WIDTH))
        .withColumn("arrivals", F.when(F.col("_aimed").isNotNull(), arrived))
        .withColumn("arrivals", F.when(F.size("arrivals") > 0, F.col("arrivals")))
        .drop("_aimed")
    )


def unlisted(routes: DataFrame, weighted: bool = False) -> DataFrame:
    """Listed routes as the rows that standard_routes gives otherwise, without their charted name."""
    measured = (
        routes.select("*", F.inline("frames"))
        .drop("frames")
        .withColumn("y", G.flip_when(~F.col("route_left"), F.col("y"), FIELD_WIDTH))
        .withColumns(
            {
                "relative_x": F.col("x") - F.col("x_start"),
                "relative_y": F.col("y") - F.col("y_start"),
                "route_frameId": F.col("frameId") - F.col("frameId_start") - 1,
            }
        )
    )
    copies = F.col("copies") * F.col("times") * F.col("ran")
    cut = _kept_copies(measured).withColumn("copies", copies).drop("times", "ran")
    return cut if weighted else repeat_copies(cut)


def standard_routes(
    tracking: DataFrame,
    player_play: DataFrame,
    max_route_frame: int = MAX_ROUTE_FRAME,
    weighted: bool = False,
    listed: bool = False,
) -> DataFrame:
    """The whole chain from raw tracking to relative routes.

    Equal to mirror_left_plays, route_tracking, route_direction, mirror_right_routes and
    relative_route one after another. Here the frames on a route are brought to their
    player (where they aren't filed so), and all that follows runs where they lie.

    With ``weighted`` each frame comes once, with its number of ``copies``. With ``listed`` each route does, with its
    ``frames`` as they lie on the field, its ``arrivals``, and how often its player ``ran``: for those who need all frames, which
    ``unlisted`` measures and cuts. For those who filter frames, rows are made of these alone.
    """
    frames = mirror_left_plays(tracking).filter(F.col("nflId").isNotNull())
    runners = route_runners(player_play).select(*ROUTE_KEYS, "routeRan")
    starts = start_points(frames).join(runners, ROUTE_KEYS)
    carried = ["x_start", "y_start", "frameId_start"] if listed else ["frameId_start"]
    moving = (
        after_snap(frames)
        .select(*ROUTE_KEYS, "week", "frameId", "x", "y", "event")
        .join(hashed(starts.select(*ROUTE_KEYS, *carried)), ROUTE_KEYS)
        .filter(_on_route(max_route_frame))
    )
    if listed:
        return _with_arrivals(_listed(moving, carried), player_play)
    # Equal frames become one row with a count.
    on_route = (
        moving.groupBy(*ROUTE_KEYS, "week", "frameId", "x", "y", "event")
        .agg(F.count("*").alias("times"), F.max("frameId_start").alias("frameId_start"))
        .withColumn("route_frameId", F.col("frameId") - F.col("frameId_start") - 1)
    )
    ends = moving.groupBy(*ROUTE_KEYS).agg(F.max_by("y", "frameId").alias("_y_end"))
    arrivals = _arrivals(frames, starts, player_play, max_route_frame)
    sides = (
        ends.join(starts.drop("frameId_start"), ROUTE_KEYS)
        .withColumn("route_left", F.col("_y_end") > F.col("y_start"))
        .join(arrivals, ROUTE_KEYS, "left")
    )
    right = ~F.col("route_left")
    measured = (
        on_route.join(hashed(sides.drop("_y_end")), ROUTE_KEYS)
        .withColumns(
            {
                "y": G.flip_when(right, F.col("y"), FIELD_WIDTH),
                "y_start": G.flip_when(right, F.col("y_start"), FIELD_WIDTH),
            }
        )
        .withColumns(
            {
                "relative_x": F.col("x") - F.col("x_start"),
                "relative_y": F.col("y") - F.col("y_start"),
            }
        )
    )
    cut = _kept_copies(measured).withColumn("copies", F.col("copies") * F.col("times")).drop("times")
    return cut if weighted else repeat_copies(cut)


def route_ends(relative: DataFrame) -> DataFrame:
    """Where a cut route ends: the last measured frame of each route."""
    return relative.groupBy(*ROUTE_KEYS).agg(
        F.count("*").alias("frames"),
        F.max("route_frameId").alias("last_frame"),
        F.max_by("relative_x", "route_frameId").alias("end_x"),
        F.max_by("relative_y", "route_frameId").alias("end_y"),
    )

