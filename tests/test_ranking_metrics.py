import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from routeforge.operators import analysis as A
from routeforge.operators import metrics as M
from routeforge.operators.ranking import position_in_group, running_total


def test_running_total_matches_brute_force_with_one_hot_group(spark):
    rng = np.random.default_rng(1)
    data = [(int(rng.choice([0, 0, 0, 1, 2])), i, float(v), int(w)) for i, (v, w) in enumerate(
        zip(rng.permutation(600) / 7, rng.integers(1, 5, 600)))]
    df = spark.createDataFrame(data, "g int, id int, v double, w int")
    got = running_total(df, ["g"], F.floor("v"), [F.col("v")], ["w"])
    want = sorted(
        (i, sum(w2 for g2, _, v2, w2 in data if g2 == g and v2 < v)) for g, i, v, _ in data
    )
    assert sorted((r["id"], r["w_before"]) for r in got.collect()) == want


def test_position_in_group_descending(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.5), ("a", 3.1), ("b", 2.0)], "g string, v double")
    got = position_in_group(df, ["g"], F.floor(-F.col("v")), [F.desc("v")], "place")
    assert rows(got, "g", "v", "place") == [("a", 1.0, 3), ("a", 3.1, 2), ("a", 3.5, 1), ("b", 2.0, 1)]


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(2)
    score = rng.integers(0, 50, 400) / 50
    label = (rng.uniform(size=400) < 0.2 + 0.6 * score).astype(int)
    data = [(int(l), int(s >= 0.5), float(s)) for l, s in zip(label, score)]
    return spark.createDataFrame(data, "label int, prediction int, score double"), np.array(data)


def test_auc_matches_pair_counting(judged):
    df, data = judged
    pos, neg = data[data[:, 0] == 1, 2], data[data[:, 0] == 0, 2]
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert M.roc_auc(df).first()[0] == pytest.approx(wins)


def test_roc_curve_is_monotone_and_complete(judged):
    df, data = judged
    points = M.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert len(points) == len(np.unique(data[:, 2]))
    assert all(a["fpr"] <= b["fpr"] and a["tpr"] <= b["tpr"] for a, b in zip(points, points[1:]))
    assert (points[-1]["fpr"], points[-1]["tpr"]) == (1, 1)


def test_report_and_balanced_accuracy(judged):
    df, data = judged
    report = {r["name"]: r for r in M.classification_report(df).collect()}
    hit = data[:, 0] == data[:, 1]
    recall1 = hit[data[:, 0] == 1].mean()
    recall0 = hit[data[:, 0] == 0].mean()
    assert report["1"]["recall"] == pytest.approx(recall1)
    assert report["1"]["precision"] == pytest.approx(hit[data[:, 1] == 1].mean())
    assert report["macro avg"]["recall"] == pytest.approx((recall0 + recall1) / 2)
    assert report["weighted avg"]["support"] == 400
    assert M.balanced_accuracy(df).first()[0] == pytest.approx((recall0 + recall1) / 2)


def test_class_never_predicted_has_zero_precision(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    report = {r["name"]: r for r in M.classification_report(df).collect()}
    assert (report["1"]["precision"], report["1"]["f1"]) == (0, 0)


def test_draw_is_no_win(spark):
    games = spark.createDataFrame(
        [(1, "A", "B", 10, 10), (2, "A", "B", 7, 3)],
        "gameId bigint, homeTeamAbbr string, visitorTeamAbbr string, homeFinalScore int, visitorFinalScore int",
    )
    assert rows(A.team_win_rate(games)) == [("A", 0.5), ("B", 0.0)]


def test_backups_go_only_where_the_play_has_another(spark):
    people = spark.createDataFrame(
        [(1, 1, 10), (1, 1, 11), (1, 2, 11), (1, 3, 10), (1, 3, 12)], "gameId bigint, playId bigint, nflId bigint"
    )
    players = spark.createDataFrame(
        [(10, "Ann", "QB"), (11, "Bo", "QB"), (12, "Cy", "QB")], "nflId bigint, displayName string, position string"
    )
    got = rows(A.quarterbacks(people, players, ["Bo"]), "playId", "displayName", "duplicated")
    assert got == [(1, "Ann", False), (2, "Bo", False), (3, "Ann", True), (3, "Cy", True)]


def test_correlation_of_constant_input_is_null(spark):
    stats = spark.createDataFrame([(0.5, 0.1), (0.5, 0.9)], "orpsp double, hadPassReception double")
    assert A.correlation(stats, "x").first()["r"] is None
    assert A.trend(stats, "x").first()["slope"] is None
    line = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "orpsp double, hadPassReception double")
    assert A.correlation(line, "x").first()["r"] == pytest.approx(1)
    assert tuple(A.trend(line, "x").first())[1:] == pytest.approx((2, 1))
