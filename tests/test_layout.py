"""Frames are made where they are read: they are neither written nor moved."""

import itertools
import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from checks.registry import QUERIES
from routeforge.operators import exemplars, nearest, zones
from routeforge.sources import files
from routeforge.sources.season import Season

FRAMELESS = [
    "route_direction", "tracking_features", "arrival_cut", "route_features", "relative_route", "start_features", "zone_box", "route_polyline",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders and line items of a few plays, with a null customer, a null part, and lines that come twice."""
    path = str(tmp_path_factory.mktemp("tables"))
    orders = [(k, None if k == 3 else k * 7) for k in range(1, 30)]
    lines = [(k, None if k == 5 and n == 1 else (k * 3 + n) % 40, n) for k in range(1, 30) for n in range(4)] + [(2, 6, 0)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int").write.parquet(f"{path}/lineitem.parquet")
    parts = spark.range(40).select(F.col("id").alias("p_partkey"), F.concat(F.lit("p"), "id").alias("p_name"))
    parts.write.parquet(f"{path}/part.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", FRAMELESS)
def test_frames_are_not_shuffled(spark, folder, name):
    for table in ("plays", "player_play", "tracking"):
        getattr(Season(spark, folder), table)()
    if name in ("zone_box", "route_polyline"):
        QUERIES[name](spark, folder)  # zones are written on the way
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name](spark, folder))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    frames = text.count("Generate explode(sequence")
    assert frames
    # Between an exchange and the frames below it there is always an aggregate.
    lines = text.splitlines()
    for at, line in enumerate(lines):
        if "Exchange" in line:
            depth = line.index("Exchange")
            under = itertools.takewhile(lambda x: x[:depth].strip(" :+-") == "" and len(x) > depth, lines[at + 1 :])
            reduced = False
            for x in under:
                reduced = reduced or "Aggregate" in x
                assert reduced or "Generate explode(sequence" not in x


def test_written_rows_are_phases_not_frames(spark, folder):
    season = Season(spark, folder)
    frames = season.tracking()
    ways = season._lineups().count() + season._base().count()
    assert season._phases().count() <= 3 * ways
    assert frames.count() > 15 * ways
    assert frames.filter("frameId > 60 or frameId < 1").isEmpty()
    kinds = rows(frames.groupBy("frameType").agg(F.min("frameId"), F.max("frameId")))
    assert kinds == [("AFTER_SNAP", 10, 60), ("BEFORE_SNAP", 1, 8), ("SNAP", 9, 9)]


def test_season_keeps_plays_and_players_without_a_key(spark, folder):
    season = Season(spark, folder)
    assert season.player_play().filter("gameId is null").count() == 4
    assert season.player_play().filter("nflId is null").count() == 1
    assert season.tracking().filter("gameId is null").select("playId").distinct().count() == 1
    assert season.player_play().filter("playId = 2").count() == season.player_play().filter("playId = 2").distinct().count()


def test_few_targets_are_found_as_by_the_index(spark):
    points = spark.createDataFrame(
        [(1, 0.0, 0.0), (2, 5.0, 1.0), (3, math.nan, 0.0), (4, math.inf, 1.0), (5, 2.5, 0.0), (6, 1e9, -3.0)], "id long, a double, b double"
    ).select("id", nearest.shape_struct(["a", "b"]))
    targets = spark.createDataFrame([(4, 0.0, 0.0), (7, 5.0, 0.0), (9, 5.0, 0.0)], "cluster int, a double, b double")
    for held in (targets, targets.limit(0)):
        held = held.select("cluster", nearest.shape_struct(["a", "b"]))
        few = nearest.nearest_of_few(points, held, ["a", "b"])
        assert few.schema["cluster"].dataType == held.schema["cluster"].dataType
        assert rows(few, "id", "cluster", "gap") == rows(nearest.nearest(points, held, ["a", "b"]), "id", "cluster", "gap")


def test_cost_is_the_same_by_both_ways(spark, monkeypatch):
    shape = [f"double(id % 7) + {k} AS {c}" for k, c in enumerate(zones.SHAPE_FEATURES)]
    features = spark.range(60).selectExpr("id AS gameId", "id AS playId", "id AS nflId", *shape)
    known = features.limit(3).selectExpr("int(gameId) AS cluster", *zones.SHAPE_FEATURES)
    few = exemplars.clustering_cost(features, known).first()
    monkeypatch.setattr(exemplars, "FEW", 0)
    many = exemplars.clustering_cost(features, known).first()
    assert (few["exemplars"], few["cost"]) == (many["exemplars"], pytest.approx(many["cost"]))


def test_tracking_files_are_compressed_and_whole(spark, folder, tmp_path):
    frames = Season(spark, folder).tracking().filter("week is not null")
    files.write_tracking(frames, str(tmp_path))
    written = [p for p in tmp_path.rglob("part-*")]
    assert written and all(p.name.endswith(".csv.gz") for p in written)
    back = files.read_tracking(spark, str(tmp_path))
    assert back.count() == frames.count()
    assert back.select(frames.columns).exceptAll(frames).isEmpty()
