import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from routeforge import schemas
from routeforge.operators import playbook as P
from routeforge.sources import files

BOARD = {
    "SHOTGUN": {
        "2x2": {
            "position": ["WR", "T", "TE"], "wasRunningRoute": [1, 0, 1],
            "x": [-1.5, -1.0, -0.5], "y": [37.5, 29.0, 20.5],
        }
    },
    "EMPTY": {"3x1": {"position": ["WR"], "wasRunningRoute": [1], "x": [-1.0], "y": [40.0]}},
}


def test_csv_nulls_and_round_trip(spark, tmp_path):
    (tmp_path / "players.csv").write_text("position,nflId,extra,displayName\nNA,1,z,Ann\n,2,z,\nWR,NA,z,Bo\n")
    players = files.read_source(spark, str(tmp_path), "players")
    want = [(1, "Ann", None), (2, None, None), (None, "Bo", "WR")]
    assert sorted(map(tuple, players.collect()), key=repr) == sorted(want, key=repr)
    files.write_csv(players, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "1,Ann,NA" in text and "NA,Bo,WR" in text
    again = files.read_csv(spark, str(tmp_path / "out"), schemas.PLAYERS)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(want, key=repr)


def test_tracking_weeks(spark, tmp_path):
    names = list(schemas.TRACKING)
    for week in (1, 2, 3):
        line = ["1", "2", "NA", "ball", "3", "SNAP", "football", "left", "1.5", "2.5", "NA", "NA", "NA"]
        (tmp_path / f"tracking_week_{week}.csv").write_text(",".join(names) + "\n" + ",".join(line) + "\n")
    got = files.read_tracking(spark, str(tmp_path), 2)
    assert rows(got, "week", "nflId", "x") == [(1, None, 1.5), (2, None, 1.5)]
    files.store_tracking(got, str(tmp_path / "stored"))
    stored = files.load_tracking(spark, str(tmp_path / "stored"))
    assert rows(stored.filter("week = 2"), "week", "y") == [(2, 2.5)]
    assert rows(files.read_tracking(spark, str(tmp_path)), "week") == [(1,), (2,), (3,)]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            files.read_tracking(spark, str(tmp_path), bad)
    with pytest.raises(Exception, match="tracking_week_4"):
        files.read_tracking(spark, str(tmp_path), 10)


def test_templates_round_trip(spark, tmp_path):
    (tmp_path / "board.json").write_text(json.dumps(BOARD))
    template = files.read_templates(spark, str(tmp_path / "board.json"))
    assert rows(template.filter("wasRunningRoute = 1"), "offenseFormation", "slot", "x") == [
        ("EMPTY", 1, -1.0), ("SHOTGUN", 1, -1.5), ("SHOTGUN", 3, -0.5)
    ]
    assert json.loads(files.nest_templates(template).first()[0]) == BOARD
    files.write_templates(template, str(tmp_path / "out"))
    assert files.read_templates(spark, str(tmp_path / "out")).exceptAll(template).count() == 0


@pytest.fixture
def template(spark, tmp_path):
    (tmp_path / "board.json").write_text(json.dumps(BOARD))
    return files.read_templates(spark, str(tmp_path / "board.json"))


def test_default_design(template):
    got = rows(P.default_design(template), "offenseFormation", "receiverId", "zone_x0", "zone_y1", "xi", "yi")
    assert got == [
        ("EMPTY", 1, 7.5, 41.5, 4.0, 40.0), ("SHOTGUN", 1, 7.0, 39.0, 3.5, 37.5), ("SHOTGUN", 2, 8.0, 22.0, 4.5, 20.5)
    ]


def test_shapes_are_pushed_onto_the_board(spark):
    shapes = files.literal_rows(
        spark,
        {
            "kind": ["receiver", "zone", "zone"],
            "x0": [3.0, 30.0, -20.0], "x1": [4.0, 33.0, -17.0], "y0": [-5.0, 60.0, 10.0], "y1": [-4.0, 63.0, 13.0],
        },
    )
    got = [tuple(r) for r in P.validate_shapes(shapes).collect()]
    assert got[0][1:5] == pytest.approx((-0.5, 0.5, 0, 1))
    assert got[1][1:5] == pytest.approx((22, 25, 50.3, 53.3))
    assert got[2][1:5] == pytest.approx((-10, -7, 10, 13))


def test_context_is_held_to_the_field(spark):
    designs = files.literal_rows(
        spark, {"absoluteYardlineNumber": [100, 5, 60], "yardsToGo": [20, 10, 10], "down": [1, 1, 5]}
    )
    assert rows(P.validate_context(designs), "absoluteYardlineNumber", "yardsToGo", "valid") == [
        (100, 10, True), (5, 10, False), (60, 10, False)
    ]


def test_designed_class_has_no_abs_and_goes_in_order(spark):
    cases = [
        ((0.0, 30.0, 0.0, 0.0, 0.5, 10.0, "straight"), "screen"),
        ((0.0, 10.0, 0.0, 0.0, 0.5, 30.0, "straight"), "flat"),
        ((0.0, 10.0, 0.0, 0.0, 9.0, 10.0, "straight"), "shortstraight"),
        ((0.0, 10.0, 11.0, 10.0, 15.0, 14.0, "45angle"), "late45angle"),
        ((0.0, 10.0, 6.0, 10.0, 10.0, 14.0, "45angle"), "early45angle"),
        ((0.0, 10.0, 6.0, 10.0, 12.0, 14.0, "90angle"), "90angle"),
    ]
    for args, want in cases:
        assert spark.range(1).select(P.designed_route_class(*[F.lit(a) for a in args])).first()[0] == want


def test_designed_rows_and_ball(spark, template):
    designs = spark.createDataFrame(
        [(7, "SHOTGUN", "2x2", 60, 10, 1)],
        "design_id bigint, offenseFormation string, receiverAlignment string, absoluteYardlineNumber int, yardsToGo int, down int",
    )
    moves = spark.createDataFrame(
        [(7, 1, -2.0, 37.0, 12.0, 37.0, "straight"), (7, 2, None, None, 8.0, 26.5, "90angle")],
        "design_id bigint, receiverId int, x double, y double, x_zone double, y_zone double, route_type string",
    )
    placed = P.designed_rows(template, designs, moves)
    got = rows(placed, "nflId", "x", "x_recep_zone", "route_mode", "xi", "relative_x_min")
    assert got == [
        (1, 58.0, 72.0, "straight", 5.0, 11.0), (2, 59.0, None, None, None, None), (3, 59.5, 68.0, "90angle", 8.0, 5.5)
    ]
    ball = P.with_ball(placed).filter("nflId is null").first()
    assert (ball["x"], ball["y"], ball["displayName"]) == (60.0, 26.65, None)
    features = P.designed_features(placed)
    assert features.count() == 2
    assert features.filter("nflId = 1").first()["dis_recep_zone"] == pytest.approx(14)
