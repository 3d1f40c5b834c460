from conftest import frames, player_play, rows

from routeforge.operators import receivers as R

PLAYS = (
    "gameId bigint, playId bigint, passResult string, qbSpike boolean, timeToSack double, prePenaltyYardsGained int"
)


def plays(spark, spec):
    return spark.createDataFrame([(1, i, *s) for i, s in enumerate(spec)], PLAYS)


def test_labels(spark):
    outcomes = plays(
        spark,
        [("C", False, None, 2), ("C", False, None, 3), ("C", False, None, None), ("I", None, None, 9), ("S", False, 5.0, 0)],
    )
    people = player_play(
        spark,
        [(1, p, w, 1, "GO", int(w == 1)) for p in range(5) for w in (1, 2)] + [(1, 4, 3, None, None, 0)],
    )
    complete = outcomes.select("gameId", "playId")
    got = rows(R.open_labels(complete, outcomes, people), "playId", "nflId", "orpsp_target")
    assert got == [(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 0), (4, 1, 0), (4, 2, 0)]


def test_eligibility(spark):
    outcomes = plays(
        spark,
        [
            ("S", False, 4.0, 0), ("S", False, 4.125, 0), ("S", False, None, 0),
            ("C", None, None, 0), ("C", True, None, 0), (None, False, None, 0),
        ],
    )
    assert rows(R.eligible_plays(outcomes), "playId") == [(1,), (2,), (3,)]


def test_start_is_the_last_frame_before_the_snap_and_needs_a_ball(spark):
    with_ball = [(1, 7, 1, 1), (1, 8, 2, 3), (1, 12, 9, 9), (None, 8, 5, 6)]
    without = [(1, 8, 2, 3, {"playId": 2})]
    got = R.start_features(frames(spark, with_ball + without))
    assert rows(got, "playId", "nflId", "x", "y", "x_ball", "y_ball", "route_left") == [
        (1, 1, 2.0, 3.0, 5.0, 6.0, True),
        (1, None, 5.0, 6.0, 5.0, 6.0, None),
    ]


def test_start_features_agree_with_and_without_known_side(spark, season):
    from routeforge.operators import tracking as T

    mirrored = T.mirror_left_plays(season.tracking())
    columns = ["gameId", "playId", "nflId", "frameId", "playDirection", "x", "y", "o", "route_left", "x_ball", "y_ball"]
    a = R.start_features(mirrored).select(*columns)
    b = R.start_features(T.route_direction(mirrored)).select(*columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_depth_bands(spark):
    zones = [59.9, 60.0, 65.0, 70.0, 80.0, None]
    data = spark.createDataFrame(
        [(1, 1, z, 60.0, "flat" if i else None) for i, z in enumerate(zones)],
        "gameId bigint, playId bigint, x_recep_zone double, absoluteYardlineNumber double, route_mode string",
    )
    got = R.play_route_counts(data).first().asDict()
    assert [got[f"nb_recep_zone_{b}"] for b in ("negative", "5", "10", "20", "inf")] == [1, 1, 1, 1, 1]
    assert (got["nb_flat"], got["nb_routes"], got["nb_screen"]) == (5, 5, 0)


def test_zone_is_flipped_with_play_and_route(spark):
    row = spark.createDataFrame(
        [("left", 30, False, 50.0, 20.0, 4.0, 2.0), ("right", 30, True, 119.0, 53.0, 4.0, 2.0)],
        "playDirection string, absoluteYardlineNumber int, route_left boolean, x double, y double, "
        "relative_x_mean double, relative_y_mean double",
    )
    got = rows(R.absolute_zones(row), "absoluteYardlineNumber", "x_recep_zone", "y_recep_zone")
    assert got == [(30.0, 119.99, 53.29), (90.0, 54.0, 18.0)]
