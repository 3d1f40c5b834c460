import pytest
from conftest import player_play, rows
from pyspark.sql import functions as F

from routeforge.operators import zones as Z

KEYS = "gameId bigint, playId bigint, nflId bigint"


def test_mode_tie_goes_to_the_smallest_name_and_nulls_do_not_count(spark):
    people = player_play(
        spark,
        [(1, 1, "OUT", 0), (2, 1, "IN", 0), (3, 1, None, 0), (4, 1, None, 0), (5, 1, None, 0), (6, 1, "JET", 0)],
    )
    clusters = spark.createDataFrame(
        [(1, 1, w, 0) for w in range(1, 6)] + [(1, 1, 6, 1)], KEYS + ", cluster int"
    )
    assert rows(Z.cluster_modes(people, clusters)) == [(0, "90angle"), (1, "JET")]


def test_widening_reads_the_old_edges(spark):
    zone = spark.createDataFrame(
        [(5.0, 4.5, 9.0, 0.0, 0.0, 0.0, 20.0)],
        "relative_x_mean double, relative_x_min double, relative_x_max double, relative_y_mean double, "
        "relative_y_min double, relative_y_max double, route_frameId_mean double",
    )
    got = Z.widen_zones(zone).first()
    assert (got["relative_x_min"], got["relative_x_max"]) == (2, 9)
    assert (got["relative_y_min"], got["relative_y_max"]) == (-3, 3)
    assert got["route_time_mean"] == pytest.approx(2.0)


def test_complete_plays_need_every_runner(spark):
    people = player_play(
        spark,
        [(1, 1, 1, 1, "GO", 0), (1, 1, 2, 1, "GO", 0), (1, 2, 3, 1, "GO", 0), (1, 2, 4, None, None, 0), (1, 3, 5, None, None, 0)],
    )
    clusters = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 3, 0)], KEYS + ", cluster int")
    assert rows(Z.complete_plays(people, clusters)) == [(1, 2)]
    assert Z.incomplete_play_count(people, clusters).first()[0] == 1


def test_nearest_exemplar_breaks_ties_low_and_folds_blocks(spark, monkeypatch):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, None), (3, 9.0, 0.0)], "id int, a double, b double")
    exemplars = spark.createDataFrame(
        [(0, 1.0, 0.0), (1, -1.0, 0.0), (2, 5.0, 0.0), (3, 100.0, 0.0), (4, 9.5, 0.0)],
        "cluster int, a double, b double",
    )
    want = [(1, 0), (2, 2), (3, 4)]
    assert rows(Z.nearest_exemplar(points, exemplars, ["a", "b"]), "id", "cluster") == want
    monkeypatch.setattr(Z, "EXEMPLAR_BLOCK", 2)
    assert rows(Z.nearest_exemplar(points, exemplars, ["a", "b"]), "id", "cluster") == want


def test_no_clustered_route_is_lost(spark, season):
    clusters = season.clusters()
    assert Z.cluster_sizes(clusters).agg(F.sum("count")).first()[0] == clusters.count()
    assert Z.with_clusters(season.player_play(), clusters).count() == season.player_play().count()
