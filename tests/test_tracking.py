from conftest import frames, player_play, rows
from pyspark.sql import functions as F

from routeforge.operators import tracking as T


def path(who, last, x=lambda f: f, y=lambda f: 10.0, **extra):
    return [(who, f, x(f), y(f), extra.get(f"f{f}", {})) for f in range(8, last + 1)]


def test_mirror_left_plays(spark):
    data = frames(spark, [(1, 1, 20, 10, {"playDirection": "left"}), (2, 1, 20, 10)])
    got = rows(T.mirror_left_plays(data), "nflId", "x", "y", "o")
    assert got == [(1, 100.0, 43.3, 190.0), (2, 20.0, 10.0, None)]


def test_direction_tie_is_right_and_unmoved_players_are_unknown(spark):
    data = frames(
        spark,
        path(1, 12, y=lambda f: 10.0) + path(2, 12, y=lambda f: float(f)) + path(3, 9) + path(None, 12),
    )
    got = T.route_direction(data)
    assert set(rows(got, "nflId", "route_left")) == {(1, False), (2, True), (3, None), (None, None)}
    assert got.count() == data.count()


def test_unknown_side_is_not_turned(spark):
    data = frames(spark, path(3, 9)).withColumn("route_left", F.lit(None).cast("boolean"))
    assert rows(T.mirror_right_routes(data), "y") == [(10.0,), (10.0,)]


def test_horizon_keeps_frame_50_and_drops_51(spark):
    data = frames(spark, path(1, 62))
    got = T.relative_route(data, player_play(spark, [(1, 1, "GO", 0)]))
    assert got.agg(F.min("route_frameId"), F.max("route_frameId"), F.count("*")).first() == (1, 50, 50)


def test_two_arrivals_repeat_the_frames_before_both(spark):
    arrived = {"event": "pass_arrived"}
    data = frames(spark, path(1, 40, f12=arrived, f15=arrived))
    runner = player_play(spark, [(1, 1, "GO", 1)])
    counts = {
        r[0]: r[1] for r in T.relative_route(data, runner).groupBy("frameId").count().collect()
    }
    assert counts == {10: 2, 11: 2, 12: 2, 13: 1, 14: 1, 15: 1}
    weighted = T.relative_route(data, runner, weighted=True)
    assert {r[0]: r[1] for r in weighted.select("frameId", "copies").collect()} == counts


def test_arrival_of_an_untargeted_runner_cuts_nothing(spark):
    data = frames(spark, path(1, 20, f12={"event": "pass_arrived"}))
    assert T.relative_route(data, player_play(spark, [(1, 1, "GO", 0)])).count() == 11


def test_one_chain_equals_its_steps(spark, season):
    tracking, people = season.tracking(), season.player_play()
    steps = T.mirror_left_plays(tracking)
    steps = T.route_direction(T.route_tracking(steps, people))
    steps = T.relative_route(T.mirror_right_routes(steps), people)
    chain = T.standard_routes(tracking, people)
    columns = ["gameId", "playId", "nflId", "frameId", "relative_x", "relative_y", "route_left", "routeRan"]
    a, b = steps.select(*columns), chain.select(*columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ball_rows_never_join(spark):
    data = frames(spark, path(None, 20) + path(1, 20))
    got = T.route_tracking(data, player_play(spark, [(1, 1, "GO", 0)]))
    assert got.filter("nflId is null").count() == 0
