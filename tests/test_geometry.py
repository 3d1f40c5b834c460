import math

import pytest
from pyspark.sql import functions as F

from routeforge.functions import geometry as G

L = F.lit


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_sideline_distance_keeps_the_jump_at_the_far_line(spark):
    got = one(spark, *[G.sideline_distance(L(v)) for v in (10.0, 26.65, 40.0, 53.3, -10.0)])
    assert got == pytest.approx((10, 26.65, 13.3, 53.3, 10))


def test_sideline_distance_is_at_most_half_a_field(spark):
    ys = spark.range(0, 533).select((F.col("id") / 10).alias("y"))
    assert ys.filter(G.sideline_distance(F.col("y")) > 26.65 + 1e-9).count() == 0


def test_compass_angle(spark):
    zero = L(0.0)
    turns = [(0.0, 1.0), (1.0, 0.0), (0.0, -1.0), (-1.0, 0.0)]
    got = one(spark, *[G.compass_angle(zero, zero, L(x), L(y)) for x, y in turns])
    assert got == pytest.approx((0, 90, 180, 270))


def test_hold_on_field_is_asymmetric(spark):
    got = one(
        spark,
        *[G.hold_on_field(L(v), 120.0) for v in (121.0, -1.0, 120.0)],
        *[G.hold_on_field(L(v), 53.3) for v in (54.0, 53.3)],
    )
    assert got == pytest.approx((119.99, 0, 120, 53.29, 53.3))


def test_mid_route_points(spark):
    cases = [
        ((0.0, 0.0, 10.0, 4.0, "45angle"), (6.0, 0.0)),
        ((0.0, 0.0, 3.0, 10.0, "45angle"), (3.0, 3.0)),
        ((0.0, 0.0, -10.0, 4.0, "45angle"), (-6.0, 0.0)),
        ((0.0, 2.0, 10.0, 4.0, "straight"), (5.0, 3.0)),
        ((0.0, 2.0, 10.0, 4.0, "90angle"), (10.0, 2.0)),
    ]
    for args, want in cases:
        assert one(spark, *G.mid_route_point(*[L(a) for a in args])) == pytest.approx(want)


def test_unknown_route_type_is_an_error(spark):
    with pytest.raises(Exception, match="route type"):
        one(spark, *G.mid_route_point(L(0.0), L(0.0), L(1.0), L(1.0), L("zigzag")))


def test_first_down_line(spark):
    assert one(spark, *[G.first_down_line(L(60), L(10), L(d)) for d in ("right", "left")]) == (70, 50)
    with pytest.raises(Exception, match="playDirection"):
        one(spark, G.first_down_line(L(60), L(10), L("up")))


def test_zone_edges_recentre_off_the_field(spark):
    inside = G.zone_edges(L(50.0), L(-2.0), L(4.0), 120.0)
    beyond = G.zone_edges(L(119.0), L(2.0), L(6.0), 120.0)
    before = G.zone_edges(L(1.0), L(-3.0), L(3.0), 120.0)
    assert one(spark, *inside, *beyond, *before) == (48, 54, 118, 122, -3, 3)


def test_mirror_twice_is_identity(spark):
    there = G.flip_when(L(True), L(17.5), 120.0)
    assert one(spark, G.flip_when(L(True), there, 120.0)) == (17.5,)


def test_half_turn(spark):
    got = one(spark, *[G.half_turn(L(a)) for a in (10.0, 190.0, 180.0)])
    assert got == (190, 10, 0)
    assert all(0 <= a < 360 and not math.isnan(a) for a in got)
