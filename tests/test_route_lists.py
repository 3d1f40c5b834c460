"""Routes as lists: frames are made once for each phase, and lists give what rows give."""

import pytest
from conftest import frames, player_play, rows
from test_layout import folder, plan  # noqa: F401

from checks.registry import QUERIES
from routeforge.operators import tracking as T
from routeforge.operators.routes import route_features
from routeforge.sources.season import Season


def path(who, last, **extra):
    return [(who, f, f + f * f / 64, 10 + f % 7, extra.get(f"f{f}", {})) for f in range(8, last + 1)]


@pytest.mark.parametrize("name", ["route_features", "position_features", "relative_route"])
def test_frames_are_made_once_for_each_phase(spark, folder, name):  # noqa: F811
    """Frames before the snap and frames after it: each is made once."""
    season = Season(spark, folder)
    season.player_play(), season.tracking()
    assert plan(QUERIES[name](spark, folder)).count("Generate explode(sequence") == 2


def test_lists_give_the_features_of_rows(spark):
    arrived = {"event": "pass_arrived"}
    two_weeks = [(6, f, f, 5.0, {"week": f % 2}) for f in range(8, 25)]
    data = frames(
        spark,
        path(1, 40, f12=arrived, f15=arrived) + path(1, 40)[3:20] + path(2, 70) + path(3, 10) + path(4, 30, f12=arrived)
        + path(5, 30) + two_weeks + [(7, f, 3.0, f, {"x": None if f % 3 else 4.0, "y": None if f % 4 == 0 else f * 1.0}) for f in range(8, 30)]
        + [(8, f, 3.0, f, {"x": float("nan") if f % 5 else 4.0}) for f in range(8, 30)] + [(9, f, 3.0, 1.0, {"x": None}) for f in range(8, 30)],
    )
    # A runner who is there twice, one who was targeted twice, and one who ran no route.
    people = [(1, 1, "GO", 1), (1, 1, "GO", 1), (2, 1, None, 0), (3, 1, "IN", 0), (4, 1, "OUT", 0), (5, None, None, 0), *[(k, 1, "GO", 0) for k in (6, 7, 8, 9)]]
    people = player_play(spark, people)
    steps = T.mirror_left_plays(data)
    steps = T.route_direction(T.route_tracking(steps, people))
    steps = T.relative_route(T.mirror_right_routes(steps), people)
    listed = rows(route_features(T.unlisted(T.standard_routes(data, people, listed=True), weighted=True)))
    for other in (T.standard_routes(data, people, weighted=True), T.standard_routes(data, people), steps):
        found = rows(route_features(other))
        assert [r[:4] for r in found] == [r[:4] for r in listed]
        for a, b in zip(found, listed, strict=True):
            if a[3] == 1 and other is steps:
                continue  # the steps count copies of a runner's rows otherwise, see below
            assert a == pytest.approx(b, nan_ok=True), a[3]
    assert {r[3] for r in listed} == {1, 2, 3, 4, 6, 7, 8, 9}
    assert len([r for r in listed if r[3] == 6]) == 2


def test_a_runner_there_twice_counts_twice(spark):
    data = frames(spark, path(1, 30, f12={"event": "pass_arrived"}))
    once, twice = (player_play(spark, [(1, 1, "GO", 1)] * n) for n in (1, 2))
    columns = ["frameId", "event", "route_left", "relative_x", "relative_y", "route_frameId"]
    for weighted in (True, False):
        one, two = (T.unlisted(T.standard_routes(data, people, listed=True), weighted) for people in (once, twice))
        assert rows(one, *columns) == rows(T.standard_routes(data, once, weighted=weighted), *columns)
        assert one.filter("frameId > 12").isEmpty() and one.filter("event = 'pass_arrived'").count() == 1
        total = "sum(copies)" if weighted else "count(*)"
        # Twice as a runner on the way to the list, twice at it, and the arrival four times.
        assert two.selectExpr(total).first()[0] == 16 * one.selectExpr(total).first()[0]
        assert T.standard_routes(data, twice, weighted=weighted).selectExpr(total).first()[0] == two.selectExpr(total).first()[0]
