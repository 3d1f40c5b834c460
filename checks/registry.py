"""The registered queries. Each reads the given tables through the derived season."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views_sql import NUDGE, ZONE_SQL
from routeforge.constants import (
    OPEN_CATEGORIES,
    OPEN_FEATURES,
    PLAY_KEYS,
    ROUTE_KEYS,
    ROUTE_TIME_CATEGORIES,
    ROUTE_TIME_FEATURES,
    SHAPE_FEATURES,
)
from routeforge.operators import (
    analysis,
    boosting,
    encoding,
    exemplars as exemplar_clustering,
    metrics,
    outliers as isolation,
    playbook,
    receivers,
    routes,
    tracking,
    views,
    zones,
)
from routeforge.session import scratch_folder, stage_table, tune
from routeforge.sources import files
from routeforge.sources.season import Season

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a Season under its own name, with its SQL twin if any."""

    def add(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Season(tune(spark), folder))

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLE[build.__name__] = sql
        return build

    return add


def rounded(df: DataFrame, places: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round the doubles that depend on summation order; those in ``keep`` are exact."""
    return df.select(
        *[
            F.round(F.col(c) + NUDGE, places).alias(c) if t == "double" and c not in keep else F.col(c)
            for c, t in df.dtypes
        ]
    )


def _whole_routes(s, weighted=True):
    """All frames of all routes, which are listed on the way."""
    return tracking.unlisted(tracking.standard_routes(s.tracking(), s.player_play(), listed=True), weighted)


# ---- tracking ---------------------------------------------------------------------------
# Frame-level operators run over every frame; their output is summed up per player of a
# play, in order-free aggregates, so that every frame still counts in the comparison.


@query(
    """SELECT "gameId", "playId", "nflId", count(*) AS frames, min(x) AS x_low, max(x) AS x_high,
    min(y) AS y_low, max(y) AS y_high, count(o) AS o_known, sum(o) AS o_sum, sum(dir) AS dir_sum
    FROM mirrored GROUP BY "gameId", "playId", "nflId" """
)
def mirror_left(s):
    return (
        tracking.mirror_left_plays(s.tracking())
        .groupBy(*ROUTE_KEYS)
        .agg(
            F.count("*").alias("frames"),
            F.min("x").alias("x_low"),
            F.max("x").alias("x_high"),
            F.min("y").alias("y_low"),
            F.max("y").alias("y_high"),
            F.count("o").alias("o_known"),
            F.sum("o").alias("o_sum"),
            F.sum("dir").alias("dir_sum"),
        )
    )


@query(
    """SELECT "gameId", "playId", "nflId", "routeRan", count(*) AS frames, min(x) AS x_low, max(x) AS x_high
    FROM route_frames GROUP BY "gameId", "playId", "nflId", "routeRan" """
)
def route_tracking(s):
    frames = tracking.mirror_left_plays(s.tracking())
    return (
        tracking.route_tracking(frames, s.player_play())
        .groupBy(*ROUTE_KEYS, "routeRan")
        .agg(F.count("*").alias("frames"), F.min("x").alias("x_low"), F.max("x").alias("x_high"))
    )


@query("""SELECT "gameId", "playId", "nflId", route_left FROM mirrored_direction""")
def route_direction(s):
    return tracking.directions(tracking.mirror_left_plays(s.tracking()))


@query(
    """SELECT "gameId", "playId", "nflId", route_left, count(*) AS frames, min(y) AS y_low, max(y) AS y_high
    FROM turned GROUP BY "gameId", "playId", "nflId", route_left"""
)
def mirror_right(s):
    frames = tracking.route_tracking(tracking.mirror_left_plays(s.tracking()), s.player_play())
    frames = tracking.mirror_right_routes(tracking.route_direction(frames))
    return frames.groupBy(*ROUTE_KEYS, "route_left").agg(
        F.count("*").alias("frames"), F.min("y").alias("y_low"), F.max("y").alias("y_high")
    )


@query(
    """SELECT "gameId", "playId", "nflId", count(*) AS frames, CAST(sum("route_frameId") AS BIGINT) AS frame_sum,
    min(relative_x) AS x_low, max(relative_x) AS x_high, min(relative_y) AS y_low, max(relative_y) AS y_high
    FROM relative GROUP BY "gameId", "playId", "nflId" """
)
def relative_route(s):
    frames = _whole_routes(s, weighted=False)
    return frames.groupBy(*ROUTE_KEYS).agg(
        F.count("*").alias("frames"),
        F.sum("route_frameId").alias("frame_sum"),
        F.min("relative_x").alias("x_low"),
        F.max("relative_x").alias("x_high"),
        F.min("relative_y").alias("y_low"),
        F.max("relative_y").alias("y_high"),
    )


@query(
    """SELECT "gameId", "playId", "nflId", count(*) AS frames, max("route_frameId") AS last_frame,
    arg_max(relative_x, "route_frameId") AS end_x, arg_max(relative_y, "route_frameId") AS end_y
    FROM relative GROUP BY "gameId", "playId", "nflId" """
)
def arrival_cut(s):
    frames = tracking.mirror_left_plays(s.tracking())
    frames = tracking.route_direction(tracking.route_tracking(frames, s.player_play()))
    frames = tracking.mirror_right_routes(frames)
    return tracking.route_ends(tracking.relative_route(frames, s.player_play()))


# ---- route shape ------------------------------------------------------------------------

_SHAPE_SQL = ", ".join(f"near({c}, 4) AS {c}" if c.startswith("coef") else f"near({c}, 6) AS {c}" for c in SHAPE_FEATURES)
_POSITION_SQL = ", ".join(f"near({c}, 6) AS {c}" for c in SHAPE_FEATURES if not c.startswith("coef"))


def _round_shape(df):
    return df.select(
        *[
            F.round(F.col(c) + NUDGE, 4 if c.startswith("coef") else 6).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


@query(f"""SELECT week, "gameId", "playId", "nflId", {_POSITION_SQL} FROM features""")
def position_features(s):
    return _round_shape(routes.position_features(_whole_routes(s)))


@query(
    """SELECT "gameId", "playId", "nflId", near(coef_a, 4) AS coef_a, near(coef_b, 4) AS coef_b,
    near(coef_c, 4) AS coef_c FROM features"""
)
def quadratic_fit(s):
    return _round_shape(routes.quadratic_fit(_whole_routes(s)))


@query(f"""SELECT week, "gameId", "playId", "nflId", {_SHAPE_SQL} FROM features""")
def route_features(s):
    return _round_shape(routes.route_features(_whole_routes(s)))


# ---- clusters and zones -----------------------------------------------------------------

ZONE_NUMBERS = [
    "relative_x_min", "relative_x_max", "relative_x_mean",
    "relative_y_min", "relative_y_max", "relative_y_mean",
    "route_frameId_mean", "route_time_mean",
]
_ZONE_COLS = ", ".join(f'near("{c}", 6) AS "{c}"' for c in ZONE_NUMBERS)


@query(
    f"""SELECT "routeRan", {_ZONE_COLS} FROM ({ZONE_SQL.format(key='"routeRan"', rows="arrived")})"""
)
def route_name_zones(s):
    """Where and when passes arrive on each charted route."""
    frames = zones.arrival_frames(tracking.standard_routes(s.tracking(), s.player_play()), s.player_play())
    return rounded(zones.widen_zones(zones.zone_bounds(frames, ["routeRan"])))


@query("""SELECT "gameId", "playId", "nflId", cluster FROM assigned""")
def cluster_assign(s):
    features = stage_table(routes.route_features(_whole_routes(s)), "route-features")
    exemplars = stage_table(zones.first_exemplars(features, s.player_play()), "exemplars")
    return zones.nearest_exemplar(features, exemplars).select(*ROUTE_KEYS, "cluster")


@query(
    """SELECT (SELECT count(*) FROM exemplars) AS exemplars,
    near((sum(gap * gap) + 50 * (SELECT count(*) FROM exemplars)) / count(*), 4) AS cost_per_route FROM nearest_gaps"""
)
def clustering_cost(s):
    """What a set of exemplars costs over all routes."""
    features = stage_table(routes.route_features(_whole_routes(s)), "route-features")
    exemplars = stage_table(zones.first_exemplars(features, s.player_play()), "exemplars")
    cost = exemplar_clustering.clustering_cost(features, exemplars)
    return rounded(cost.crossJoin(features.agg(F.count("*").alias("n"))).select("exemplars", (F.col("cost") / F.col("n")).alias("cost_per_route")), 4)


@query("""SELECT cluster, route_mode FROM modes""")
def cluster_route_mode(s):
    return zones.cluster_modes(s.player_play(), s.clusters())


def _zones(s):
    frames = zones.with_clusters(tracking.standard_routes(s.tracking(), s.player_play()), s.clusters())
    return stage_table(zones.reception_zones(s.player_play(), frames), "zones")


@query(f"""SELECT cluster, {_ZONE_COLS} FROM zones""")
def reception_zones(s):
    return rounded(_zones(s))


def _complete(s):
    return zones.complete_plays(s.player_play(), s.clusters())


@query("""SELECT "gameId", "playId" FROM complete""")
def complete_plays(s):
    return _complete(s)


@query("""SELECT count(*) AS incomplete_plays FROM coverage WHERE NOT complete""")
def incomplete_play_count(s):
    return zones.incomplete_play_count(s.player_play(), s.clusters())


@query("""SELECT cluster, count(*) AS count FROM clusters GROUP BY cluster ORDER BY count DESC, cluster LIMIT 10""")
def largest_clusters(s):
    return zones.largest_clusters(s.clusters())


# ---- labels and features ----------------------------------------------------------------


def _labels(s):
    return receivers.open_labels(_complete(s), s.plays(), s.player_play())


@query("""SELECT "gameId", "playId", "nflId", orpsp_target FROM open_labels""")
def orpsp_target(s):
    return _labels(s)


@query("""SELECT orpsp_target, count(*) AS count FROM open_labels GROUP BY orpsp_target""")
def label_counts(s):
    return receivers.label_counts(_labels(s))


@query("""SELECT * FROM play_feats""")
def play_features(s):
    return receivers.play_features(_complete(s), s.plays())


def _cluster_features(s):
    modes = stage_table(zones.cluster_modes(s.player_play(), s.clusters()), "modes")
    return receivers.cluster_features(_complete(s), s.clusters(), modes, _zones(s))


@query(
    """SELECT "gameId", "playId", "nflId", cluster, route_mode, near(relative_x_mean, 6) AS relative_x_mean,
    near(relative_y_mean, 6) AS relative_y_mean, near(route_time_mean, 6) AS route_time_mean FROM cluster_feats"""
)
def cluster_features(s):
    return rounded(_cluster_features(s))


@query(
    """SELECT t."gameId", t."playId", t."nflId", d.route_left, count(*) AS frames, min(x) AS x_low, max(y) AS y_high
    FROM mirrored t JOIN complete USING ("gameId", "playId")
    LEFT JOIN mirrored_direction d ON d."gameId" = t."gameId" AND d."playId" = t."playId" AND d."nflId" = t."nflId"
    GROUP BY t."gameId", t."playId", t."nflId", d.route_left"""
)
def tracking_features(s):
    frames = receivers.tracking_features(_complete(s), s.tracking())
    return frames.groupBy(*ROUTE_KEYS, "route_left").agg(
        F.count("*").alias("frames"), F.min("x").alias("x_low"), F.max("y").alias("y_high")
    )


def _starts(s):
    """Start rows of complete plays; the frames are reduced first, then restricted."""
    starts = receivers.start_features(tracking.mirror_left_plays(s.tracking()))
    return zones.on_plays(_complete(s), starts)


@query(
    """SELECT "gameId", "playId", "nflId", "frameId", "playDirection", x, y, o, route_left, x_ball, y_ball FROM starts"""
)
def start_features(s):
    return _starts(s).select(
        *ROUTE_KEYS, "frameId", "playDirection", "x", "y", "o", "route_left", "x_ball", "y_ball"
    )


def _receiver_rows(s):
    rows = receivers.receiver_rows(
        receivers.play_features(_complete(s), s.plays()), _cluster_features(s), _starts(s), s.players()
    )
    return stage_table(rows, "receiver-rows")


@query(
    """SELECT "gameId", "playId", "nflId", near(line, 6) AS "absoluteYardlineNumber",
    near(x_recep_zone, 6) AS x_recep_zone, near(y_recep_zone, 6) AS y_recep_zone FROM receiver_rows"""
)
def absolute_zone(s):
    return rounded(
        _receiver_rows(s).select(*ROUTE_KEYS, "absoluteYardlineNumber", "x_recep_zone", "y_recep_zone")
    )


GEOMETRY = [
    "dis_recep_zone", "dir_recep_zone", "recep_zone_dis_out_of_bounds", "recep_zone_dis_yard_line",
    "dis_ball_to_recep_zone", "dir_ball_to_recep_zone", "dis_out_of_bounds", "dis_back_of_endzone", "dis_yard_line",
]
_GEOMETRY_SQL = ", ".join(f"near({c}, 6) AS {c}" for c in GEOMETRY)


@query(f"""SELECT "gameId", "playId", "nflId", {_GEOMETRY_SQL} FROM geometry""")
def geometry_features(s):
    return rounded(receivers.geometry_features(_receiver_rows(s)).select(*ROUTE_KEYS, *GEOMETRY))


@query("""SELECT * FROM route_counts""")
def play_route_counts(s):
    return receivers.play_route_counts(_receiver_rows(s))


COUNTS = [
    "nb_early45angle", "nb_flat", "nb_90angle", "nb_late45angle", "nb_shortstraight", "nb_wheelangle",
    "nb_screen", "nb_straight", "nb_routes", "nb_recep_zone_negative", "nb_recep_zone_5",
    "nb_recep_zone_10", "nb_recep_zone_20", "nb_recep_zone_inf",
]
CONTEXT = ["down", "yardsToGo", "offenseFormation", "receiverAlignment", "playAction", "position", "route_mode"]
_OPEN_SQL = ", ".join([*[f'"{c}"' for c in CONTEXT + COUNTS], "near(route_time_mean, 6) AS route_time_mean", _GEOMETRY_SQL])


@query(f"""SELECT "gameId", "playId", "nflId", {_OPEN_SQL} FROM open_rows""")
def orpsp_features(s):
    rows = receivers.open_features(_receiver_rows(s))
    return rounded(rows.select(*ROUTE_KEYS, *CONTEXT, *COUNTS, "route_time_mean", *GEOMETRY))


_CODED = ["offenseFormation", "receiverAlignment", "playAction", "passResult"]
_CODE_SQL = ", ".join(
    f"""CAST(dense_rank() OVER (ORDER BY CAST("{c}" AS VARCHAR) NULLS LAST) - 1 AS DOUBLE) AS "{c}" """ for c in _CODED
)


@query(f"""SELECT "gameId", "playId", {_CODE_SQL} FROM plays""")
def ordinal_encode(s):
    plays = s.plays().select(*PLAY_KEYS, *_CODED)
    vocabulary = stage_table(encoding.fit_vocabulary(plays, _CODED), "vocabulary")
    return encoding.encode(plays, vocabulary, _CODED)


@query(
    """SELECT "gameId", "playId", "nflId", ('0x' || substr(md5("gameId" || '|' || "playId" || '|' || "nflId" || '|0'), 1, 8))::BIGINT % 10 < 3
    AS is_test FROM open_labels"""
)
def hash_split(s):
    return encoding.split(_labels(s), ROUTE_KEYS).select(*ROUTE_KEYS, "is_test")


# ---- model quality ----------------------------------------------------------------------


def _judged(s):
    return _labels(s).join(s.scores(), ROUTE_KEYS).select(
        F.col("orpsp_target").alias("label"),
        (F.col("orpsp") >= 0.5).cast("int").alias("prediction"),
        F.col("orpsp").alias("score"),
    )


@query("""SELECT label, prediction, count(*) AS n FROM judged GROUP BY label, prediction""")
def confusion_matrix(s):
    return metrics.confusion_matrix(_judged(s))


@query("""SELECT near(avg(hits / support), 6) AS balanced_accuracy FROM by_class WHERE support > 0""")
def balanced_accuracy(s):
    return rounded(metrics.balanced_accuracy(_judged(s)))


@query(
    """SELECT name, near(precision, 6) AS precision, near(recall, 6) AS recall, near(f1, 6) AS f1,
    CAST(support AS BIGINT) AS support FROM (
    SELECT * FROM report
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM report
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
      sum(f1 * support) / sum(support), sum(support) FROM report)"""
)
def classification_report(s):
    return rounded(metrics.classification_report(_judged(s)))


@query(
    """SELECT near(sum(neg * ((pos_to - pos) + pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM steps"""
)
def roc_auc(s):
    return rounded(metrics.roc_auc(_judged(s)))


@query(
    """SELECT score AS threshold, near(neg_to / (SELECT sum(neg) FROM steps), 6) AS fpr,
    near(pos_to / (SELECT sum(pos) FROM steps), 6) AS tpr FROM steps"""
)
def roc_curve(s):
    return rounded(metrics.roc_curve(_judged(s)))


@query("""SELECT near(sqrt(avg((label - score) * (label - score))), 6) AS rmse FROM judged""")
def rmse(s):
    return rounded(metrics.rmse(_judged(s), "label", "score"))


# ---- season analysis --------------------------------------------------------------------


@query(
    """SELECT "teamAbbr", near(avg(win), 6) AS win FROM (
    SELECT "homeTeamAbbr" AS "teamAbbr", CAST("homeFinalScore" > "visitorFinalScore" AS INT) AS win FROM games
    UNION ALL SELECT "visitorTeamAbbr", CAST("homeFinalScore" < "visitorFinalScore" AS INT) FROM games)
    GROUP BY "teamAbbr" """
)
def team_win_rate(s):
    return rounded(analysis.team_win_rate(s.games()))


def _quarterbacks(s):
    named = s.players().filter(F.col("nflId").isin(10, 50)).select("displayName").collect()
    return analysis.quarterbacks(s.player_play(), s.players(), [r[0] for r in named])


@query("""SELECT "gameId", "playId", "nflId", "displayName", "position", duplicated FROM qbs""")
def qb_per_play(s):
    return _quarterbacks(s).select(*ROUTE_KEYS, "displayName", "position", "duplicated")


def _targets(s):
    return analysis.targeted_scores(s.scores(), s.player_play())


def _teams(s):
    return analysis.team_stats(_targets(s))


def _qbs(s):
    return analysis.quarterback_stats(_targets(s), _quarterbacks(s), 15)


def _receivers(s):
    return analysis.player_stats(_targets(s), s.players(), 5)


_RATES = """near(orpsp, 6) AS orpsp, near("hadPassReception", 6) AS "hadPassReception" """


@query(f"""SELECT "teamAbbr", {_RATES} FROM team_rates""")
def team_stats(s):
    return rounded(_teams(s))


@query(f"""SELECT "displayName", {_RATES}, targets FROM qb_rates""")
def qb_stats(s):
    return rounded(_qbs(s))


@query(f"""SELECT "nflId", {_RATES}, targets, "displayName", "position" FROM player_rates""")
def player_stats(s):
    return rounded(_receivers(s))


_RATE_TABLES = (("teams", "team_rates"), ("quarterbacks", "qb_rates"), ("receivers", "player_rates"))


@query(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS stats, near(corr("hadPassReception", orpsp), 6) AS r, count(*) AS n FROM {t}"""
        for n, t in _RATE_TABLES
    )
)
def stats_corr(s):
    tables = (("teams", _teams(s)), ("quarterbacks", _qbs(s)), ("receivers", _receivers(s)))
    first, second, third = (analysis.correlation(t, n) for n, t in tables)
    return rounded(first.unionByName(second).unionByName(third))


@query(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS stats, near(regr_slope("hadPassReception", orpsp), 6) AS slope,
        near(regr_intercept("hadPassReception", orpsp), 6) AS intercept FROM {t}"""
        for n, t in _RATE_TABLES
    )
)
def stats_trend(s):
    tables = (("teams", _teams(s)), ("quarterbacks", _qbs(s)), ("receivers", _receivers(s)))
    first, second, third = (analysis.trend(t, n) for n, t in tables)
    return rounded(first.unionByName(second).unionByName(third))


@query("""SELECT * FROM scores WHERE orpsp > 0.8e0 ORDER BY "gameId", "playId", "nflId" LIMIT 10""")
def top_scores(s):
    return analysis.top_scores(s.scores())


@query("""SELECT DISTINCT "gameId", "playId" FROM tracking""")
def distinct_plays(s):
    return analysis.distinct_plays(s.tracking())


@query(
    """SELECT "offenseFormation", "receiverAlignment", count(*) AS count FROM plays
    GROUP BY "offenseFormation", "receiverAlignment" """
)
def formation_counts(s):
    return analysis.value_counts(s.plays(), "offenseFormation", "receiverAlignment")


# ---- play views -------------------------------------------------------------------------


def _view(s):
    return views.play_view(s.tracking(), s.plays(), s.clusters(), _zones(s), s.scores())


@query(
    """SELECT "gameId", "playId", "nflId", route_left, cluster, is_defense, orpsp, count(*) AS frames,
    min(x) AS x_low, max(y) AS y_high, near(max(relative_x_min), 6) AS box_x, near(max(relative_y_max), 6) AS box_y,
    near(max(route_time_mean), 6) AS seconds
    FROM play_view GROUP BY "gameId", "playId", "nflId", route_left, cluster, is_defense, orpsp"""
)
def play_view(s):
    return rounded(
        _view(s)
        .groupBy(*ROUTE_KEYS, "route_left", "cluster", "is_defense", "orpsp")
        .agg(
            F.count("*").alias("frames"),
            F.min("x").alias("x_low"),
            F.max("y").alias("y_high"),
            F.max("relative_x_min").alias("box_x"),
            F.max("relative_y_max").alias("box_y"),
            F.max("route_time_mean").alias("seconds"),
        ),
        keep=("x_low", "y_high", "orpsp"),
    )


@query(
    """SELECT DISTINCT "gameId", "playId", "absoluteYardlineNumber", "yardsToGo", "playDirection",
    CASE "playDirection" WHEN 'right' THEN "absoluteYardlineNumber" + "yardsToGo" ELSE "absoluteYardlineNumber" - "yardsToGo" END
    AS first_down FROM play_view"""
)
def first_down_line(s):
    return views.play_lines(views.play_view(s.tracking(), s.plays()))


@query(
    """SELECT "gameId", "playId", "nflId", near(round(route_time_mean, 1), 6) AS seconds,
    near(CASE WHEN x + x0 > 120 THEN 120e0 - (x1 - x0) / 2 WHEN x + x0 < 0 THEN -(x1 - x0) / 2 ELSE x + x0 END, 6) AS x0,
    near(CASE WHEN x + x0 > 120 THEN 120e0 + (x1 - x0) / 2 WHEN x + x0 < 0 THEN (x1 - x0) / 2 ELSE x + x1 END, 6) AS x1,
    near(CASE WHEN y + y0 > 53.3e0 THEN 53.3e0 - (y1 - y0) / 2 WHEN y + y0 < 0 THEN -(y1 - y0) / 2 ELSE y + y0 END, 6) AS y0,
    near(CASE WHEN y + y0 > 53.3e0 THEN 53.3e0 + (y1 - y0) / 2 WHEN y + y0 < 0 THEN (y1 - y0) / 2 ELSE y + y1 END, 6) AS y1
    FROM (SELECT *, relative_x_min AS x0, relative_x_max AS x1, relative_y_min AS y0, relative_y_max AS y1 FROM play_view
      WHERE "frameId" = 8 AND "frameType" = 'BEFORE_SNAP' AND cluster IS NOT NULL)"""
)
def zone_box(s):
    return rounded(views.zone_boxes(_view(s)))


@query(
    """SELECT "gameId", "playId", "nflId", CAST(count(*) AS INT) AS points, arg_min(x, "frameId") AS x_first, arg_min(y, "frameId") AS y_first,
    arg_max(x, "frameId") AS x_last, arg_max(y, "frameId") AS y_last
    FROM (SELECT *, row_number() OVER (PARTITION BY "gameId", "playId", "nflId" ORDER BY "frameId") AS rn FROM play_view
      WHERE "frameType" = 'AFTER_SNAP' AND cluster IS NOT NULL)
    WHERE rn <= "route_frameId_mean" GROUP BY "gameId", "playId", "nflId" """
)
def route_polyline(s):
    path = F.col("path")
    return views.route_paths(_view(s)).select(
        *ROUTE_KEYS,
        F.size(path).alias("points"),
        path[0]["x"].alias("x_first"),
        path[0]["y"].alias("y_first"),
        F.element_at(path, -1)["x"].alias("x_last"),
        F.element_at(path, -1)["y"].alias("y_last"),
    )


@query(
    """SELECT "gameId", "playId", "nflId", "displayName", CAST(round(CAST(orpsp AS DECIMAL(9, 6)), 2) AS DOUBLE) AS orpsp,
    CAST(row_number() OVER (PARTITION BY "gameId", "playId" ORDER BY y, "nflId") AS INT) AS card,
    CAST(count(*) OVER (PARTITION BY "gameId", "playId") AS INT) AS cards
    FROM play_view WHERE "frameId" = 8 AND "frameType" = 'BEFORE_SNAP' AND orpsp IS NOT NULL"""
)
def receiver_cards(s):
    return views.receiver_cards(views.play_view(s.tracking(), s.plays(), scores=s.scores()))


# ---- playbook ---------------------------------------------------------------------------


def _template(s):
    rows = playbook.formation_templates(s.tracking(), s.plays(), s.player_play(), s.players(), _complete(s))
    return stage_table(rows, "template")


@query(
    """SELECT "offenseFormation", "receiverAlignment", slot, "position", "wasRunningRoute", near(x, 6) AS x, near(y, 6) AS y
    FROM template"""
)
def formation_template(s):
    return rounded(_template(s))


@query(
    """SELECT "offenseFormation", "receiverAlignment", "receiverId", near(x - 0.5e0, 6) AS receiver_x0,
    near(x + 0.5e0, 6) AS receiver_x1, near(y - 0.5e0, 6) AS receiver_y0, near(y + 0.5e0, 6) AS receiver_y1,
    near(x + 10 - 1.5e0, 6) AS zone_x0, near(x + 10 + 1.5e0, 6) AS zone_x1, near(y - 1.5e0, 6) AS zone_y0,
    near(y + 1.5e0, 6) AS zone_y1, near(x + 5, 6) AS xi, near(y, 6) AS yi FROM template_receivers"""
)
def default_design(s):
    return rounded(playbook.default_design(_template(s)))


def _designs(s):
    """Every play of the season as a design of its own."""
    return s.plays().select(
        F.col("playId").alias("design_id"), *playbook.FORMATION, "absoluteYardlineNumber", "yardsToGo", "down"
    )


def _moves(s, template):
    slots = playbook.receiver_slots(template)
    p, r = F.col("design_id"), F.col("receiverId")
    kinds = F.array(F.lit("straight"), F.lit("45angle"), F.lit("90angle"))
    return _designs(s).join(slots, playbook.FORMATION).select(
        "design_id",
        "receiverId",
        (F.col("x") - (p + r) % 3 / F.lit(4.0)).alias("x"),
        "y",
        (F.col("x") + (p * 3 + r * 5) % 40 / F.lit(2.0) - 2).alias("x_zone"),
        (F.col("y") + ((p * 7 + r * 11) % 33 - 16) / F.lit(2.0)).alias("y_zone"),
        kinds[((p + r) % 3).cast("int")].alias("route_type"),
    )


@query(
    """SELECT design_id, "receiverId", kind, near(greatest(least(x0, f0), -10e0), 6) AS x0,
    near(greatest(least(x1, f1), -10e0 + size), 6) AS x1, near(least(greatest(y0, 0e0), 53.3e0 - size), 6) AS y0,
    near(least(greatest(y1, size), 53.3e0), 6) AS y1
    FROM (SELECT design_id, "receiverId", 'receiver' AS kind, 1e0 AS size, -0.5e0 AS f0, 0.5e0 AS f1,
            x - 0.5e0 AS x0, x + 0.5e0 AS x1, y - 0.5e0 AS y0, y + 0.5e0 AS y1 FROM moves
          UNION ALL SELECT design_id, "receiverId", 'zone', 3e0, 22e0, 25e0,
            x_zone - 1.5e0, x_zone + 1.5e0, y_zone - 1.5e0, y_zone + 1.5e0 FROM moves)"""
)
def design_validation(s):
    moves = _moves(s, _template(s))

    def boxes(kind, x, y, half):
        x, y = F.col(x), F.col(y)
        return moves.select(
            "design_id",
            "receiverId",
            F.lit(kind).alias("kind"),
            (x - half).alias("x0"),
            (x + half).alias("x1"),
            (y - half).alias("y0"),
            (y + half).alias("y1"),
        )

    shapes = boxes("receiver", "x", "y", 0.5).unionByName(boxes("zone", "x_zone", "y_zone", 1.5))
    held = playbook.validate_shapes(shapes)
    return rounded(held.drop("center_x", "center_y"))


@query(
    """SELECT design_id, line AS "absoluteYardlineNumber", least(to_go, 110 - line) AS "yardsToGo",
    line BETWEEN 11 AND 109 AND down BETWEEN 1 AND 4 AND least(to_go, 110 - line) >= 1 AS valid
    FROM (SELECT "playId" AS design_id, "absoluteYardlineNumber" AS line, "yardsToGo" AS to_go, down FROM plays)"""
)
def design_context(s):
    checked = playbook.validate_context(_designs(s))
    return checked.select("design_id", "absoluteYardlineNumber", "yardsToGo", "valid")


@query("""SELECT design_id, "receiverId", route_type, near(xi, 6) AS xi, near(yi, 6) AS yi FROM bent""")
def mid_route_point(s):
    from routeforge.functions.geometry import mid_route_point as bend

    moves = _moves(s, _template(s))
    xi, yi = bend(*[F.col(c) for c in ("x", "y", "x_zone", "y_zone", "route_type")])
    return rounded(moves.select("design_id", "receiverId", "route_type", xi.alias("xi"), yi.alias("yi")))


def _designed_rows(s):
    template = _template(s)
    return playbook.designed_rows(template, _designs(s), _moves(s, template))


@query("""SELECT "playId", "nflId", route_mode FROM designed_rows""")
def designed_route_class(s):
    rows = _designed_rows(s).filter(F.col("wasRunningRoute") == 1)
    return rows.select("playId", "nflId", "route_mode")


_COUNT_SQL = ", ".join(f'"{c}"' for c in COUNTS)


@query(
    f"""SELECT "gameId", "playId", "nflId", route_mode, {_GEOMETRY_SQL}, {_COUNT_SQL}
    FROM designed_geometry JOIN designed_counts USING ("gameId", "playId")"""
)
def designed_features(s):
    rows = playbook.designed_features(stage_table(_designed_rows(s), "designed-rows"))
    return rounded(rows.select(*ROUTE_KEYS, "route_mode", *GEOMETRY, *COUNTS))


def _unmoved_rows(s):
    template = _template(s)
    moves = _moves(s, template).filter((F.col("design_id") + F.col("receiverId")) % 3 == 0)
    return playbook.designed_rows(template, _designs(s), moves)


@query(
    """SELECT "playId", "nflId", near(x, 6) AS x, near(y, 6) AS y, near(x_recep_zone, 6) AS x_recep_zone,
    near(y_recep_zone, 6) AS y_recep_zone, route_mode, 'NFL' AS club FROM unmoved_rows"""
)
def designed_defaults(s):
    """Designs in which most receivers weren't moved."""
    rows = _unmoved_rows(s).filter(F.col("wasRunningRoute") == 1)
    return rounded(rows.select("playId", "nflId", "x", "y", "x_recep_zone", "y_recep_zone", "route_mode", "club"))


@query(
    """SELECT "playId", CAST(slot AS BIGINT) AS "nflId", 'Player ' || slot AS "displayName", near(x, 6) AS x, near(y, 6) AS y FROM board_rows
    WHERE "wasRunningRoute" = 0 UNION ALL SELECT DISTINCT "playId", NULL, NULL, near(x_ball, 6), near(26.65e0, 6) FROM board_rows"""
)
def designed_ball(s):
    """Players of designed plays who run no route, and the ball, which lacks most columns."""
    rows = playbook.with_ball(_unmoved_rows(s)).filter("wasRunningRoute = 0 or wasRunningRoute is null")
    return rounded(rows.select("playId", "nflId", "displayName", "x", "y"))


# ---- files ------------------------------------------------------------------------------


def _new_folder(s, name):
    return f"{scratch_folder(s.spark)}/routeforge-{s.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query(
    """SELECT week, "gameId", "playId", "nflId", count(*) AS frames, CAST(sum("frameId") AS BIGINT) AS frame_sum, min(x) AS x_low,
    max(x) AS x_high, min(y) AS y_low, max(y) AS y_high, count(o) AS o_known, count(event) AS events, min(club) AS club
    FROM tracking GROUP BY week, "gameId", "playId", "nflId" """
)
def tracking_scan(s):
    """All frames, written as weekly CSV tables and read in one scan."""
    folder = _new_folder(s, "tracking-csv")
    files.write_tracking(s.tracking(), folder)
    frames = files.read_tracking(s.spark, folder)
    return frames.groupBy("week", *ROUTE_KEYS).agg(
        F.count("*").alias("frames"),
        F.sum("frameId").alias("frame_sum"),
        F.min("x").alias("x_low"),
        F.max("x").alias("x_high"),
        F.min("y").alias("y_low"),
        F.max("y").alias("y_high"),
        F.count("o").alias("o_known"),
        F.count("event").alias("events"),
        F.min("club").alias("club"),
    )


@query("""SELECT * FROM plays""")
def csv_plays(s):
    """Plays with their nulls through a CSV file."""
    folder = _new_folder(s, "plays-csv")
    files.write_csv(s.plays(), f"{folder}/plays.csv")
    return files.read_source(s.spark, folder, "plays")


@query("""SELECT * FROM player_play""")
def csv_player_play(s):
    folder = _new_folder(s, "player-play-csv")
    files.write_csv(s.player_play(), f"{folder}/player_play.csv")
    return files.read_source(s.spark, folder, "player_play")


@query(
    """SELECT "offenseFormation", "receiverAlignment", slot, "position", "wasRunningRoute", near(x, 6) AS x, near(y, 6) AS y
    FROM template"""
)
def template_json(s):
    """Formation templates through nested JSON."""
    path = _new_folder(s, "template-json")
    files.write_templates(_template(s), path)
    return rounded(files.read_templates(s.spark, path))


# ---- learned operators ------------------------------------------------------------------
# Boosted scores depend on the learner, so they have no SQL twin. Rounds, rate and depth are the package's own.

_kept: dict[tuple[str, int, str, str], object] = {}


def _once(s, name, build):
    key = (s.spark.sparkContext.applicationId, id(s.spark), s.folder, name)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def _shapes(s):
    return _once(
        s, "shapes", lambda: stage_table(routes.route_features(_whole_routes(s)), "shapes")
    )


@query()
def exemplars(s):
    """Exemplars of the routes of all weeks."""
    return exemplar_clustering.train_exemplars(_shapes(s))


def _forest_shapes(s):
    """Shapes rounded as in route_features, so that both engines grow their forest on equal numbers."""
    return _once(s, "forest-shapes", lambda: stage_table(_round_shape(_shapes(s)), "forest-shapes"))


def _scored(s):
    return isolation.predict_outliers(_forest_shapes(s), isolation.train_outliers(_forest_shapes(s)))


@query("""SELECT "gameId", "playId", "nflId", anomaly FROM forest_anomaly""")
def outliers(s):
    return _scored(s).select(*ROUTE_KEYS, "anomaly")


@query(
    f"""SELECT week, "gameId", "playId", "nflId", {_SHAPE_SQL} FROM features
    JOIN forest_anomaly USING ("gameId", "playId", "nflId") WHERE anomaly = 1"""
)
def outliers_removed(s):
    return isolation.remove_outliers(_scored(s))


@query()
def impute_zones(s):
    known = _zones(s)
    rows = stage_table(boosting.zone_training_rows(_shapes(s), s.clusters(), known), "zone-rows")
    return boosting.impute_zones(rows, known)[0]


def _model_rows(s):
    """Encoded features of all receivers, with label and split where there is a label."""

    def build():
        features = stage_table(receivers.open_features(_receiver_rows(s)), "open-features")
        vocabulary = stage_table(encoding.fit_vocabulary(features, OPEN_CATEGORIES), "encoder")
        encoded = encoding.encode(
            features.select(*ROUTE_KEYS, *OPEN_FEATURES), vocabulary, OPEN_CATEGORIES
        ).join(_labels(s), ROUTE_KEYS, "left")
        return vocabulary, stage_table(encoding.split(encoded, ROUTE_KEYS), "encoded")

    return _once(s, "model-rows", build)


def _open_model(s):
    def build():
        rows = _model_rows(s)[1].filter(F.col("orpsp_target").isNotNull() & ~F.col("is_test"))
        return boosting.train_open_classifier(rows)

    return _once(s, "open-model", build)


@query()
def orpsp_scores(s):
    return boosting.open_scores(_model_rows(s)[1], _open_model(s))


@query()
def orpsp_classes(s):
    return boosting.open_classes(_model_rows(s)[1], _open_model(s))


@query()
def feature_importance(s):
    rows = _model_rows(s)[1].filter("is_test").filter(F.col("orpsp_target").isNotNull())
    return boosting.feature_importance(rows, _open_model(s))


def _time_model(s):
    def build():
        rows = _model_rows(s)[1].filter(~F.col("is_test"))
        return boosting.train_route_time(rows)

    return _once(s, "time-model", build)


@query()
def route_time(s):
    return boosting.route_times(_model_rows(s)[1], _time_model(s))


@query()
def designed_scores(s):
    vocabulary = _model_rows(s)[0]
    rows = stage_table(_designed_rows(s), "designed-rows")
    features = stage_table(playbook.designed_features(rows), "designed-features")
    timed = encoding.encode(
        features.select(*ROUTE_KEYS, *ROUTE_TIME_FEATURES), vocabulary, ROUTE_TIME_CATEGORIES
    )
    times = boosting.route_times(timed, _time_model(s))
    full = features.join(times, ROUTE_KEYS).select(*ROUTE_KEYS, *OPEN_FEATURES)
    scored = boosting.open_scores(encoding.encode(full, vocabulary, OPEN_CATEGORIES), _open_model(s))
    return rows.join(times, ROUTE_KEYS, "left").join(scored, ROUTE_KEYS, "left")
