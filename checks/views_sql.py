"""DuckDB views used by the check queries, as named common table expressions.

``with_views`` puts in front of a query only the views it uses, directly or not.
"""

from __future__ import annotations

import re

ROUTES = "['GO','HITCH','SLANT','CROSS','POST','CORNER','OUT','IN','FLAT','SCREEN','ANGLE','WHEEL']"

VIEWS: dict[str, str] = {}

# ---- the season derived from the order tables -------------------------------------------

VIEWS["base"] = """
SELECT 2022000000 + o_custkey % 90 AS "gameId", o_orderkey AS "playId", o_orderkey AS k, o_custkey % 32 AS team
FROM orders"""

VIEWS["players"] = """
SELECT p_partkey + 1 AS "nflId", p_name || '#' || p_partkey AS "displayName",
  CASE WHEN p_partkey % 10 = 9 THEN 'QB' WHEN p_partkey % 10 <= 4 THEN 'WR' WHEN p_partkey % 10 <= 6 THEN 'TE'
       WHEN p_partkey % 10 = 7 THEN 'RB' ELSE 'CB' END AS "position"
FROM part"""

VIEWS["plays"] = """
SELECT "gameId", "playId", CAST(k % 4 + 1 AS INT) AS down, CAST((k * 3) % 15 + 1 AS INT) AS "yardsToGo",
  CAST((k * 13) % 99 + 11 AS INT) AS "absoluteYardlineNumber",
  (['SHOTGUN','EMPTY','I_FORM','PISTOL'])[k % 4 + 1] AS "offenseFormation",
  (['2x2','3x1','2x1'])[k % 3 + 1] AS "receiverAlignment",
  k % 5 = 0 AS "playAction",
  CASE WHEN k % 8 <= 2 THEN 'C' WHEN k % 8 = 3 THEN 'I' WHEN k % 8 = 4 THEN 'IN' WHEN k % 8 = 5 THEN 'S'
       WHEN k % 8 = 6 THEN 'R' END AS "passResult",
  CASE WHEN k % 11 = 0 THEN NULL ELSE k % 13 = 0 END AS "qbSpike",
  CASE WHEN k % 8 = 5 THEN 2.5e0 + (k % 40) / 8e0 END AS "timeToSack",
  CAST((k * 7) % 31 - 5 AS INT) AS "prePenaltyYardsGained",
  'T' || team AS "possessionTeam", 'T' || ((team + 7) % 32) AS "defensiveTeam"
FROM base"""

VIEWS["lineups"] = """
SELECT b."gameId", b."playId", b.k, b.team, l."nflId", l.line,
  ("nflId" - 1) % 10 <= 7 AS running, ("nflId" - 1) % 10 = 8 AS defender,
  CASE WHEN ("nflId" - 1) % 10 = 8 THEN (team + 7) % 32 ELSE team END AS side_team
FROM base b JOIN (SELECT l_orderkey, l_partkey + 1 AS "nflId", min(l_linenumber) AS line
                  FROM lineitem GROUP BY l_orderkey, l_partkey) l ON l.l_orderkey = b."playId" """

VIEWS["aims"] = """
SELECT "playId", "nflId" AS aim FROM (
  SELECT "playId", "nflId", row_number() OVER (PARTITION BY "playId" ORDER BY line, "nflId") AS rn
  FROM lineups WHERE running AND k % 8 <= 4) WHERE rn = 1"""

VIEWS["player_play"] = f"""
SELECT l."gameId", l."playId", l."nflId", 'T' || side_team AS "teamAbbr",
  CASE WHEN running THEN 1 END AS "wasRunningRoute",
  CASE WHEN running THEN ({ROUTES})[(l."nflId" + k) % 12 + 1] END AS "routeRan",
  CAST(coalesce(running AND a.aim = l."nflId", false) AS INT) AS "wasTargettedReceiver",
  CAST(coalesce(running AND a.aim = l."nflId", false) AND k % 8 <= 2 AS INT) AS "hadPassReception"
FROM lineups l LEFT JOIN aims a ON a."playId" = l."playId" """

VIEWS["entities"] = """
SELECT "gameId", "playId", "nflId", k, 'T' || side_team AS club FROM lineups
UNION ALL SELECT "gameId", "playId", NULL, k, 'football' FROM base"""

VIEWS["tracking"] = """
SELECT "gameId", "playId", "nflId",
  CASE WHEN "nflId" IS NULL THEN 'football' ELSE 'Player ' || "nflId" END AS "displayName",
  CAST(f AS INT) AS "frameId",
  CASE WHEN f < 9 THEN 'BEFORE_SNAP' WHEN f = 9 THEN 'SNAP' ELSE 'AFTER_SNAP' END AS "frameType",
  club, CASE WHEN k % 2 = 0 THEN 'right' ELSE 'left' END AS "playDirection",
  ((k * 13) % 99 + 11) + (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END)
    * ((CASE WHEN "nflId" IS NULL THEN 0 ELSE -(1 + who % 4) END) + (t * (r % 6 + 1) / 16e0 - t * t * (r % 3) / 512e0)) AS x,
  CASE WHEN "nflId" IS NULL THEN 26.5e0 ELSE
    2e0 + who % 50 + (CASE WHEN who % 2 = 0 THEN 1 ELSE -1 END) * greatest(t - 8, 0) * (r % 5 + 1) / 32e0 + (t % 2) / 64e0 END AS y,
  CAST((who * 37 + f) % 360 AS DOUBLE) AS o, CAST((who * 53 + f) % 360 AS DOUBLE) AS dir,
  CASE WHEN f = 9 THEN 'ball_snap' WHEN f = 21 + k % 20 AND k % 8 <= 4 THEN 'pass_arrived' END AS event,
  CAST(("gameId" - 2022000000) % 9 + 1 AS INT) AS week
FROM (SELECT e.*, coalesce("nflId", 0) AS who, coalesce(("nflId" + k) % 12, 0) AS r, f, greatest(f - 9, 0) AS t
      FROM entities e, range(1, 61) g(f)
      WHERE f <= CASE WHEN ("nflId" + k) % 41 = 0 THEN 9 ELSE 60 END)"""

VIEWS["games"] = """
SELECT "gameId", 'T' || (g % 32) AS "homeTeamAbbr", 'T' || ((7 * g + 5) % 32) AS "visitorTeamAbbr",
  CAST((11 * g) % 35 AS INT) AS "homeFinalScore", CAST((17 * g + 3) % 35 AS INT) AS "visitorFinalScore"
FROM (SELECT DISTINCT "gameId", "gameId" - 2022000000 AS g FROM base)"""

VIEWS["scores"] = """
SELECT "gameId", "playId", "nflId", (("nflId" * 31 + k * 17) % 1000) / 1000e0 AS orpsp FROM lineups WHERE running"""

VIEWS["clusters"] = """
SELECT "gameId", "playId", "nflId",
  CAST(CASE WHEN k % 8 >= 5 AND ("nflId" * 3 + k) % 10 = 0 THEN 24
       ELSE ("nflId" + k) % 12 * 2 + "nflId" % 2 END AS INT) AS cluster
FROM lineups WHERE running AND ("nflId" + k) % 41 <> 0"""

# ---- routes -----------------------------------------------------------------------------

VIEWS["mirrored"] = """
SELECT "gameId", "playId", "nflId", "displayName", "frameId", "frameType", club, "playDirection",
  CASE WHEN "playDirection" = 'left' THEN 120e0 - x ELSE x END AS x,
  CASE WHEN "playDirection" = 'left' THEN 53.3e0 - y ELSE y END AS y,
  CASE WHEN "playDirection" = 'left' THEN ((o - 180e0) % 360e0 + 360e0) % 360e0 END AS o,
  CASE WHEN "playDirection" = 'left' THEN ((dir - 180e0) % 360e0 + 360e0) % 360e0 END AS dir,
  event, week
FROM tracking"""

VIEWS["route_frames"] = """
SELECT m.*, p."routeRan" FROM mirrored m
JOIN (SELECT * FROM player_play WHERE "wasRunningRoute" = 1) p USING ("gameId", "playId", "nflId")"""


def _direction(frames: str) -> str:
    return f"""
SELECT "gameId", "playId", "nflId", arg_max(y, "frameId") > any_value(y_start) AS route_left
FROM (SELECT * FROM {frames} WHERE "frameType" = 'AFTER_SNAP')
JOIN (SELECT "gameId", "playId", "nflId", arg_max(y, "frameId") AS y_start, max("frameId") AS f0
      FROM {frames} WHERE "frameType" = 'BEFORE_SNAP' GROUP BY ALL) USING ("gameId", "playId", "nflId")
WHERE "frameId" - f0 - 1 <= 50 GROUP BY "gameId", "playId", "nflId" """


VIEWS["mirrored_direction"] = _direction("mirrored")
VIEWS["raw_direction"] = _direction("tracking")

VIEWS["turned"] = """
SELECT f.* REPLACE (CASE WHEN NOT d.route_left THEN 53.3e0 - y ELSE y END AS y), d.route_left
FROM route_frames f LEFT JOIN mirrored_direction d USING ("gameId", "playId", "nflId")"""

VIEWS["measured"] = """
SELECT t.*, s.frame0, s.x_start, s.y_start, t.x - s.x_start AS relative_x, t.y - s.y_start AS relative_y,
  t."frameId" - s.frame0 - 1 AS "route_frameId"
FROM turned t JOIN (
  SELECT "gameId", "playId", "nflId", arg_max(x, "frameId") AS x_start, arg_max(y, "frameId") AS y_start,
         max("frameId") AS frame0
  FROM turned WHERE "frameType" = 'BEFORE_SNAP' GROUP BY "gameId", "playId", "nflId") s
USING ("gameId", "playId", "nflId")
WHERE t."frameType" = 'AFTER_SNAP' AND t."frameId" - s.frame0 - 1 <= 50"""

VIEWS["relative"] = """
SELECT m.* FROM measured m LEFT JOIN (
  SELECT "gameId", "playId", "nflId", a."route_frameId" AS reception FROM measured a
  JOIN (SELECT "gameId", "playId", "nflId" FROM player_play WHERE "wasTargettedReceiver" = 1) USING ("gameId", "playId", "nflId")
  WHERE a.event = 'pass_arrived') r USING ("gameId", "playId", "nflId")
WHERE r.reception IS NULL OR m."route_frameId" <= r.reception"""

_AT = {5: "pick5", 20: "pick20", 40: "pick40"}
VIEWS["features"] = """
SELECT week, "gameId", "playId", "nflId",
  (xs[(n + 1) // 2] + xs[n // 2 + 1]) / 2e0 AS x_median, x_std,
  greatest(xv[least(5, n - 1) + 1], 0e0) AS x_5, greatest(xv[least(20, n - 1) + 1], 0e0) AS x_20,
  greatest(xv[least(40, n - 1) + 1], 0e0) AS x_40,
  (ys[(n + 1) // 2] + ys[n // 2 + 1]) / 2e0 AS y_median, y_std,
  yv[least(5, n - 1) + 1] AS y_5, yv[least(20, n - 1) + 1] AS y_20, yv[least(40, n - 1) + 1] AS y_40,
  a AS coef_a, b - 2 * a * m AS coef_b, c - b * m + a * m * m AS coef_c
FROM (SELECT *, (t0 - a * s2) / n AS c FROM (SELECT *, (t1 - a * s3) / s2 AS b FROM (
  SELECT *, (t2 * s2 * n - s3 * t1 * n - s2 * s2 * t0) / (s4 * s2 * n - s3 * s3 * n - s2 * s2 * s2) AS a FROM (
    SELECT week, "gameId", "playId", "nflId", count(*) AS n, any_value(m) AS m,
      list_sort(list(relative_x)) AS xs, list_sort(list(relative_y)) AS ys,
      list(relative_x ORDER BY "route_frameId") AS xv, list(relative_y ORDER BY "route_frameId") AS yv,
      stddev_samp(relative_x) AS x_std, stddev_samp(relative_y) AS y_std,
      sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4,
      sum(relative_y) AS t0, sum(u * relative_y) AS t1, sum(u * u * relative_y) AS t2
    FROM (SELECT r.*, m, relative_x - m AS u FROM relative r
          JOIN (SELECT "gameId", "playId", "nflId", avg(relative_x) AS m FROM relative GROUP BY ALL) USING ("gameId", "playId", "nflId"))
    GROUP BY week, "gameId", "playId", "nflId"))))"""


# ---- clusters ---------------------------------------------------------------------------

_SHAPE = [
    "x_median", "x_std", "x_5", "x_20", "x_40", "y_median", "y_std", "y_5", "y_20", "y_40",
    "coef_a", "coef_b", "coef_c",
]

VIEWS["named_features"] = """
SELECT f.*, p."routeRan" FROM features f JOIN (SELECT * FROM player_play WHERE "wasRunningRoute" = 1) p
USING ("gameId", "playId", "nflId")"""

VIEWS["exemplars"] = """
SELECT CAST(dense_rank() OVER (ORDER BY "routeRan") - 1 AS INT) AS cluster, * FROM (
  SELECT *, row_number() OVER (PARTITION BY "routeRan" ORDER BY "gameId", "playId", "nflId") AS rn FROM named_features)
WHERE rn = 1"""

_GAP = " + ".join(f"(coalesce(f.{c}, 0e0) - e.{c}) * (coalesce(f.{c}, 0e0) - e.{c})" for c in _SHAPE)
VIEWS["assigned"] = f"""
SELECT f."gameId", f."playId", f."nflId", arg_min(e.cluster, sqrt({_GAP})) AS cluster
FROM features f, (SELECT * FROM exemplars ORDER BY cluster) e GROUP BY f."gameId", f."playId", f."nflId" """

VIEWS["nearest_gaps"] = f"""
SELECT f."gameId", f."playId", f."nflId", min(sqrt({_GAP})) AS gap
FROM features f, exemplars e GROUP BY f."gameId", f."playId", f."nflId" """

VIEWS["modes"] = """
SELECT cluster, CASE "routeRan" WHEN 'GO' THEN 'straight' WHEN 'HITCH' THEN 'shortstraight'
  WHEN 'SLANT' THEN 'early45angle' WHEN 'CROSS' THEN 'early45angle' WHEN 'POST' THEN 'late45angle'
  WHEN 'CORNER' THEN 'late45angle' WHEN 'OUT' THEN '90angle' WHEN 'IN' THEN '90angle' WHEN 'FLAT' THEN 'flat'
  WHEN 'SCREEN' THEN 'screen' WHEN 'ANGLE' THEN 'wheelangle' WHEN 'WHEEL' THEN 'wheelangle' ELSE "routeRan" END AS route_mode
FROM (SELECT cluster, "routeRan", row_number() OVER (PARTITION BY cluster ORDER BY n DESC, "routeRan") AS rn
      FROM (SELECT cluster, "routeRan", count(*) AS n FROM player_play JOIN clusters USING ("gameId", "playId", "nflId")
            WHERE "routeRan" IS NOT NULL GROUP BY cluster, "routeRan"))
WHERE rn = 1"""

VIEWS["arrived"] = """
SELECT r.*, c.cluster FROM relative r
JOIN (SELECT "gameId", "playId", "nflId" FROM player_play WHERE "wasTargettedReceiver" = 1) USING ("gameId", "playId", "nflId")
LEFT JOIN clusters c USING ("gameId", "playId", "nflId") WHERE r.event = 'pass_arrived'"""

ZONE_SQL = """
SELECT {key},
  CASE WHEN abs(relative_x_mean - x0) < 1 THEN relative_x_mean - 3 ELSE x0 END AS relative_x_min,
  CASE WHEN abs(x1 - relative_x_mean) < 1 THEN relative_x_mean + 3 ELSE x1 END AS relative_x_max, relative_x_mean,
  CASE WHEN abs(relative_y_mean - y0) < 1 THEN relative_y_mean - 3 ELSE y0 END AS relative_y_min,
  CASE WHEN abs(y1 - relative_y_mean) < 1 THEN relative_y_mean + 3 ELSE y1 END AS relative_y_max, relative_y_mean,
  "route_frameId_mean", "route_frameId_mean" * 0.1e0 AS route_time_mean
FROM (SELECT {key}, min(relative_x) AS x0, max(relative_x) AS x1, avg(relative_x) AS relative_x_mean,
        min(relative_y) AS y0, max(relative_y) AS y1, avg(relative_y) AS relative_y_mean,
        avg("route_frameId") AS "route_frameId_mean" FROM {rows} GROUP BY {key})"""

VIEWS["zones"] = ZONE_SQL.format(key="cluster", rows="(SELECT * FROM arrived WHERE cluster IS NOT NULL)")

VIEWS["coverage"] = """
SELECT p."gameId", p."playId", bool_and(c.cluster IS NOT NULL) AS complete
FROM player_play p LEFT JOIN clusters c USING ("gameId", "playId", "nflId")
WHERE p."wasRunningRoute" = 1 GROUP BY p."gameId", p."playId" """

VIEWS["complete"] = """SELECT "gameId", "playId" FROM coverage WHERE complete"""

# ---- receivers --------------------------------------------------------------------------

VIEWS["open_labels"] = """
SELECT "gameId", "playId", p."nflId",
  CAST(CASE WHEN "passResult" = 'C' AND "prePenaltyYardsGained" > 2 THEN 1 ELSE 0 END AS INT) AS orpsp_target
FROM plays JOIN complete USING ("gameId", "playId") JOIN player_play p USING ("gameId", "playId")
WHERE "passResult" IS NOT NULL AND (NOT "qbSpike" OR "qbSpike" IS NULL) AND ("timeToSack" > 4 OR "timeToSack" IS NULL)
  AND p."wasRunningRoute" = 1
  AND (("passResult" IN ('C', 'I', 'IN') AND "wasTargettedReceiver" = 1) OR "passResult" IN ('S', 'R'))"""

VIEWS["play_feats"] = """
SELECT "gameId", "playId", down, "yardsToGo", "absoluteYardlineNumber", "offenseFormation", "receiverAlignment", "playAction"
FROM plays JOIN complete USING ("gameId", "playId")"""

VIEWS["cluster_feats"] = """
SELECT "gameId", "playId", "nflId", cluster, route_mode, relative_x_mean, relative_y_mean, route_time_mean
FROM clusters JOIN complete USING ("gameId", "playId") JOIN modes USING (cluster) JOIN zones USING (cluster)"""

VIEWS["last_frames"] = """
SELECT "gameId", "playId", "nflId", max("frameId") AS "frameId", arg_max(x, "frameId") AS x, arg_max(y, "frameId") AS y,
  arg_max_null(o, "frameId") AS o, arg_max("playDirection", "frameId") AS "playDirection"
FROM mirrored WHERE "frameType" = 'BEFORE_SNAP' GROUP BY "gameId", "playId", "nflId" """

VIEWS["starts"] = """
SELECT s.*, d.route_left, b.x AS x_ball, b.y AS y_ball
FROM last_frames s JOIN complete USING ("gameId", "playId")
LEFT JOIN mirrored_direction d ON d."gameId" = s."gameId" AND d."playId" = s."playId" AND d."nflId" = s."nflId"
JOIN (SELECT * FROM last_frames WHERE "nflId" IS NULL) b ON b."gameId" = s."gameId" AND b."playId" = s."playId" """

VIEWS["receiver_rows"] = """
SELECT * REPLACE (CASE WHEN x_recep_zone > 120e0 THEN 119.99e0 WHEN x_recep_zone < 0 THEN 0e0 ELSE x_recep_zone END AS x_recep_zone,
    CASE WHEN y_recep_zone > 53.3e0 THEN 53.3e0 - 0.01e0 WHEN y_recep_zone < 0 THEN 0e0 ELSE y_recep_zone END AS y_recep_zone)
FROM (SELECT *, x + relative_x_mean AS x_recep_zone, y + relative_y_mean AS y_recep_zone FROM (
  SELECT c."gameId", c."playId", c."nflId", c.cluster, c.route_mode, c.route_time_mean, c.relative_x_mean,
    CASE WHEN NOT s.route_left THEN -c.relative_y_mean ELSE c.relative_y_mean END AS relative_y_mean,
    CASE WHEN s."playDirection" = 'left' THEN 120e0 - p."absoluteYardlineNumber" ELSE p."absoluteYardlineNumber" END AS line,
    p.down, p."yardsToGo", p."offenseFormation", p."receiverAlignment", p."playAction",
    q."position", s.x, s.y, s.x_ball, s.y_ball, s.route_left
  FROM cluster_feats c JOIN play_feats p USING ("gameId", "playId") JOIN starts s USING ("gameId", "playId", "nflId")
  JOIN players q USING ("nflId")))"""


def geometry_sql(rows: str) -> str:
    def angle(dx: str, dy: str) -> str:
        return f"(degrees(atan2({dx}, {dy})) + 360e0) % 360e0"

    def side(v: str) -> str:
        return f"abs(26.65e0 * floor(abs({v}) / 26.65e0) - abs({v}) % 26.65e0)"

    return f"""
SELECT *, sqrt((x_recep_zone - x) * (x_recep_zone - x) + (y_recep_zone - y) * (y_recep_zone - y)) AS dis_recep_zone,
  {angle("x_recep_zone - x", "y_recep_zone - y")} AS dir_recep_zone,
  {side("y_recep_zone")} AS recep_zone_dis_out_of_bounds, abs(x_recep_zone - line) AS recep_zone_dis_yard_line,
  sqrt((x_recep_zone - x_ball) * (x_recep_zone - x_ball) + (y_recep_zone - y_ball) * (y_recep_zone - y_ball)) AS dis_ball_to_recep_zone,
  {angle("x_recep_zone - x_ball", "y_recep_zone - y_ball")} AS dir_ball_to_recep_zone,
  {side("y")} AS dis_out_of_bounds, abs(x - 120e0) AS dis_back_of_endzone, abs(x - line) AS dis_yard_line
FROM {rows}"""


def counts_sql(rows: str) -> str:
    classes = ["early45angle", "flat", "90angle", "late45angle", "shortstraight", "wheelangle", "screen", "straight"]
    parts = [f"count(*) FILTER (route_mode = '{c}') AS \"nb_{c}\"" for c in classes]
    bands = [("negative", "d < 0"), ("5", "d >= 0 AND d < 5"), ("10", "d >= 5 AND d < 10"), ("20", "d >= 10 AND d < 20"), ("inf", "d >= 20")]
    parts += [f"count(*) FILTER ({cond}) AS nb_recep_zone_{name}" for name, cond in bands]
    return f"""
SELECT "gameId", "playId", {", ".join(parts)}, count(route_mode) AS nb_routes
FROM (SELECT *, x_recep_zone - line AS d FROM {rows}) GROUP BY "gameId", "playId" """


VIEWS["geometry"] = geometry_sql("receiver_rows")
VIEWS["route_counts"] = counts_sql("receiver_rows")
VIEWS["open_rows"] = """SELECT * FROM geometry JOIN route_counts USING ("gameId", "playId")"""

# ---- quality and analysis ---------------------------------------------------------------

VIEWS["judged"] = """
SELECT orpsp_target AS label, CAST(orpsp >= 0.5e0 AS INT) AS prediction, orpsp AS score
FROM open_labels JOIN scores USING ("gameId", "playId", "nflId")"""

VIEWS["by_class"] = """
SELECT c.name, count(*) FILTER (label = c.name) AS support, count(*) FILTER (prediction = c.name) AS called,
  count(*) FILTER (label = c.name AND prediction = c.name) AS hits
FROM judged, (SELECT unnest([0, 1]) AS name) c GROUP BY c.name"""

VIEWS["report"] = """
SELECT CAST(name AS VARCHAR) AS name, precision, recall,
  CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support
FROM (SELECT name, support, coalesce(hits / nullif(called, 0), 0e0) AS precision, coalesce(hits / nullif(support, 0), 0e0) AS recall
      FROM by_class)"""

VIEWS["steps"] = """
SELECT score, pos, neg, sum(pos) OVER w AS pos_to, sum(neg) OVER w AS neg_to
FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM judged GROUP BY score)
WINDOW w AS (ORDER BY score DESC)"""

VIEWS["passers"] = """
SELECT "gameId", "playId", "nflId", "displayName", "position" FROM player_play JOIN players USING ("nflId") WHERE "position" = 'QB'"""

VIEWS["qbs"] = """
SELECT * EXCLUDE (n), count(*) OVER (PARTITION BY "gameId", "playId") > 1 AS duplicated
FROM (SELECT *, count(*) OVER (PARTITION BY "gameId", "playId") AS n FROM passers)
WHERE NOT (n > 1 AND "displayName" IN (SELECT "displayName" FROM players WHERE "nflId" IN (10, 50)))"""

VIEWS["targets"] = """
SELECT s.*, p."teamAbbr", p."wasTargettedReceiver", p."hadPassReception"
FROM scores s JOIN player_play p USING ("gameId", "playId", "nflId") WHERE p."wasTargettedReceiver" = 1"""

VIEWS["team_rates"] = """
SELECT "teamAbbr", avg(orpsp) AS orpsp, avg("hadPassReception") AS "hadPassReception" FROM targets GROUP BY "teamAbbr" """

VIEWS["qb_rates"] = """
SELECT "displayName", avg(orpsp) AS orpsp, avg("hadPassReception") AS "hadPassReception", count(*) AS targets
FROM targets JOIN (SELECT "gameId", "playId", "displayName" FROM qbs) USING ("gameId", "playId")
GROUP BY "displayName" HAVING count(*) >= 15"""

VIEWS["player_rates"] = """
SELECT r.*, "displayName", "position" FROM (
  SELECT "nflId", avg(orpsp) AS orpsp, avg("hadPassReception") AS "hadPassReception", count(*) AS targets
  FROM targets GROUP BY "nflId" HAVING count(*) >= 5) r JOIN players USING ("nflId")"""

# ---- views ------------------------------------------------------------------------------

VIEWS["play_view"] = """
SELECT t."gameId", t."playId", t."nflId", t."displayName", t."frameId", t."frameType", t.club, t.x, t.y, t."playDirection",
  d.route_left, p."defensiveTeam", p."absoluteYardlineNumber", p."yardsToGo", t.club = p."defensiveTeam" AS is_defense,
  c.cluster, z."route_frameId_mean", z.route_time_mean, s.orpsp,
  CASE WHEN t."playDirection" = 'left' THEN -z.relative_x_min ELSE z.relative_x_min END AS relative_x_min,
  CASE WHEN t."playDirection" = 'left' THEN -z.relative_x_max ELSE z.relative_x_max END AS relative_x_max,
  CASE WHEN NOT d.route_left THEN -z.relative_y_min ELSE z.relative_y_min END AS relative_y_min,
  CASE WHEN NOT d.route_left THEN -z.relative_y_max ELSE z.relative_y_max END AS relative_y_max
FROM tracking t LEFT JOIN raw_direction d USING ("gameId", "playId", "nflId") LEFT JOIN plays p USING ("gameId", "playId")
LEFT JOIN clusters c USING ("gameId", "playId", "nflId") LEFT JOIN zones z USING (cluster)
LEFT JOIN scores s USING ("gameId", "playId", "nflId")"""

# ---- playbook ---------------------------------------------------------------------------

VIEWS["chosen"] = """
SELECT "offenseFormation", "receiverAlignment", "gameId", "playId", "possessionTeam" FROM (
  SELECT *, row_number() OVER (PARTITION BY "offenseFormation", "receiverAlignment" ORDER BY "gameId", "playId") AS rn
  FROM plays JOIN complete USING ("gameId", "playId")) WHERE rn = 1"""

VIEWS["template"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY "offenseFormation", "receiverAlignment" ORDER BY y DESC, "nflId") AS INT) AS slot FROM (
  SELECT "offenseFormation", "receiverAlignment", s."nflId", q."position", coalesce(pp."wasRunningRoute", 0) AS "wasRunningRoute",
    s.x - s.x_ball AS x, s.y - s.y_ball + 26.65e0 AS y
  FROM chosen JOIN starts s USING ("gameId", "playId") JOIN player_play pp USING ("gameId", "playId", "nflId")
  JOIN players q USING ("nflId") WHERE pp."teamAbbr" = chosen."possessionTeam")"""

VIEWS["template_receivers"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY "offenseFormation", "receiverAlignment" ORDER BY slot) AS INT) AS "receiverId"
FROM template WHERE "wasRunningRoute" = 1"""

VIEWS["moves"] = """
SELECT p."playId" AS design_id, r."receiverId", r.x - ((p."playId" + r."receiverId") % 3) / 4e0 AS x, r.y AS y,
  r.x + ((p."playId" * 3 + r."receiverId" * 5) % 40) / 2e0 - 2 AS x_zone,
  r.y + ((p."playId" * 7 + r."receiverId" * 11) % 33 - 16) / 2e0 AS y_zone,
  (['straight','45angle','90angle'])[(p."playId" + r."receiverId") % 3 + 1] AS route_type
FROM plays p JOIN template_receivers r USING ("offenseFormation", "receiverAlignment")"""

MID_X = """CASE route_type WHEN 'straight' THEN (x + x_zone) / 2e0 WHEN '90angle' THEN x_zone ELSE
  CASE WHEN x <= x_zone THEN CASE WHEN x_zone - abs(y - y_zone) < x THEN x_zone ELSE x_zone - abs(y - y_zone) END
       ELSE CASE WHEN x_zone + abs(y - y_zone) > x THEN x_zone ELSE x_zone + abs(y - y_zone) END END END"""
MID_Y = """CASE route_type WHEN 'straight' THEN (y + y_zone) / 2e0 WHEN '90angle' THEN y ELSE
  CASE WHEN x <= x_zone THEN CASE WHEN x_zone - abs(y - y_zone) < x THEN y_zone - (x_zone - abs(y - y_zone)) * sign(y - y_zone) ELSE y END
       ELSE CASE WHEN x_zone + abs(y - y_zone) > x THEN y_zone + (x_zone + abs(y - y_zone)) * sign(y - y_zone) ELSE y END END END"""

VIEWS["bent"] = f"""SELECT *, {MID_X} AS xi, {MID_Y} AS yi FROM moves"""

VIEWS["designed_class"] = """
SELECT *, CASE WHEN x_zone < 1 AND y_zone - y < 5 THEN 'screen' WHEN x_zone < 3 THEN 'flat'
  WHEN route_type = 'straight' AND x_zone < 10 THEN 'shortstraight'
  WHEN route_type = '45angle' AND xi - x > 10 AND yi = y THEN 'late45angle'
  WHEN route_type = '45angle' THEN 'early45angle' ELSE route_type END AS route_mode FROM bent"""

VIEWS["designed_rows"] = """
SELECT 0 AS "gameId", design_id AS "playId", CAST(slot AS BIGINT) AS "nflId", d.x + line AS x, d.y, d.x_zone + line AS x_recep_zone,
  d.y_zone AS y_recep_zone, CAST(line AS DOUBLE) AS line, CAST(line AS DOUBLE) AS x_ball, 26.65e0 AS y_ball, d.route_mode
FROM designed_class d JOIN (SELECT *, "absoluteYardlineNumber" AS line FROM plays) p ON p."playId" = d.design_id
JOIN template_receivers r USING ("offenseFormation", "receiverAlignment", "receiverId")"""

VIEWS["designed_geometry"] = geometry_sql("designed_rows")
VIEWS["designed_counts"] = counts_sql("designed_rows")

# Two thirds of the receivers unmoved: they run straight to a zone ten yards ahead.
_UNMOVED = '(p."playId" + r."receiverId") % 3 > 0'
VIEWS["unmoved_moves"] = f"""
SELECT m.design_id, m."receiverId", CASE WHEN {_UNMOVED} THEN r.x ELSE m.x END AS x, r.y AS y,
  CASE WHEN {_UNMOVED} THEN r.x + 10 ELSE m.x_zone END AS x_zone, CASE WHEN {_UNMOVED} THEN r.y ELSE m.y_zone END AS y_zone,
  CASE WHEN {_UNMOVED} THEN 'straight' ELSE m.route_type END AS route_type
FROM moves m JOIN plays p ON p."playId" = m.design_id
JOIN template_receivers r USING ("offenseFormation", "receiverAlignment", "receiverId")"""
VIEWS["unmoved_bent"] = VIEWS["bent"].replace("FROM moves", "FROM unmoved_moves")
VIEWS["unmoved_class"] = VIEWS["designed_class"].replace("FROM bent", "FROM unmoved_bent")
VIEWS["unmoved_rows"] = VIEWS["designed_rows"].replace("FROM designed_class", "FROM unmoved_class")
VIEWS["board_rows"] = """
SELECT p."playId", t.slot, t."wasRunningRoute", CASE WHEN t."wasRunningRoute" = 1 THEN NULL ELSE t.x + p."absoluteYardlineNumber" END AS x, t.y, CAST(p."absoluteYardlineNumber" AS DOUBLE) AS x_ball
FROM plays p JOIN template t USING ("offenseFormation", "receiverAlignment")"""


# ---- isolation forest, grown and walked level by level ------------------------------------

_KEYS_TEXT = "CAST(\"gameId\" AS VARCHAR) || '|' || CAST(\"playId\" AS VARCHAR) || '|' || CAST(\"nflId\" AS VARCHAR)"


def _chance(text: str, first: int = 1) -> str:
    return f"CAST('0x' || substr(md5({text}), {first}, 13) AS BIGINT)"


_LEVELS = 8
_VALUES = ", ".join(f"coalesce(near({c}, {4 if c.startswith('coef') else 6}), 0e0)" for c in _SHAPE)
VIEWS["forest_routes"] = f"""
SELECT "gameId", "playId", "nflId", {_chance(_KEYS_TEXT)} AS h1, {_chance(_KEYS_TEXT, 14)} AS h2, [{_VALUES}] AS v FROM features"""

VIEWS["forest_0"] = """
SELECT tree, 1 AS node, v FROM (
  SELECT t.tree, r.v, row_number() OVER (PARTITION BY t.tree ORDER BY (r.h1 + t.tree * r.h2) % 4503599627370496,
    r."gameId", r."playId", r."nflId") AS rn FROM forest_routes r, (SELECT unnest(range(100)) AS tree) t) WHERE rn <= 256"""

VIEWS["forest_limits"] = """
SELECT tree, count(*) AS sample, greatest(1, CAST(ceil(log2(greatest(count(*), 2))) AS INT)) AS deepest FROM forest_0 GROUP BY tree"""

_SPANS = ", ".join(f"{{'f': {k + 1}, 'lo': min(v[{k + 1}]), 'hi': max(v[{k + 1}])}}" for k in range(len(_SHAPE)))
for _k in range(_LEVELS + 1):
    VIEWS[f"forest_spans_{_k}"] = f"""
SELECT tree, node, count(*) AS n, list_filter([{_SPANS}], lambda x: x.hi > x.lo) AS usable FROM forest_{_k} GROUP BY tree, node"""
    _node = "CAST(tree AS VARCHAR) || '|' || CAST(node AS VARCHAR) || '|"
    VIEWS[f"forest_splits_{_k}"] = f"""
SELECT tree, node, s.f AS f, CASE WHEN s.lo + u * (s.hi - s.lo) >= s.hi THEN s.lo ELSE s.lo + u * (s.hi - s.lo) END AS threshold
FROM (SELECT tree, node, {_chance(_node + "t'")} / 4503599627370496e0 AS u,
        usable[1 + CAST(floor({_chance(_node + "f'")} / 4503599627370496e0 * len(usable)) AS INT)] AS s
      FROM forest_spans_{_k} JOIN forest_limits USING (tree) WHERE {_k} < deepest AND len(usable) > 0)"""
    if _k < _LEVELS:
        VIEWS[f"forest_{_k + 1}"] = f"""
SELECT tree, node * 2 + CASE WHEN v[f] > threshold THEN 1 ELSE 0 END AS node, v FROM forest_{_k} JOIN forest_splits_{_k} USING (tree, node)"""

_ALL_SPANS = " UNION ALL ".join(f"SELECT tree, node, n FROM forest_spans_{k}" for k in range(_LEVELS + 1))
_ALL_SPLITS = " UNION ALL ".join(f"SELECT tree, node, f, threshold FROM forest_splits_{k}" for k in range(_LEVELS + 1))


def _average_path(n: str) -> str:
    return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329e0) - 2e0 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1e0 ELSE 0e0 END"


VIEWS["forest_leaves"] = f"""
SELECT tree, node, floor(log2(node)) + {_average_path("n")} AS path FROM ({_ALL_SPANS})
ANTI JOIN ({_ALL_SPLITS}) USING (tree, node)"""

VIEWS["forest_walk_0"] = """
SELECT "gameId", "playId", "nflId", v, tree, 1 AS node FROM forest_routes, (SELECT DISTINCT tree FROM forest_limits)"""
for _k in range(_LEVELS):
    VIEWS[f"forest_walk_{_k + 1}"] = f"""
SELECT "gameId", "playId", "nflId", v, w.tree, CASE WHEN f IS NULL THEN w.node WHEN v[f] > threshold THEN w.node * 2 + 1 ELSE w.node * 2 END AS node
FROM forest_walk_{_k} w LEFT JOIN forest_splits_{_k} s ON s.tree = w.tree AND s.node = w.node"""

VIEWS["forest_anomaly"] = f"""
SELECT "gameId", "playId", "nflId", CASE WHEN pow(2e0, -avg(path) / (SELECT {_average_path("max(sample)")} FROM forest_limits)) > 0.5e0
  THEN -1 ELSE 1 END AS anomaly
FROM forest_walk_{_LEVELS} JOIN forest_leaves USING (tree, node) GROUP BY "gameId", "playId", "nflId" """


# Sums come in another order in each engine. A value is compared after rounding, and moved
# off the rounding grid first: exact fractions would sit on its ties otherwise.
NUDGE = 1.234567e-7


def spell_out(sql: str) -> str:
    """Turn each ``near(value, places)`` into the nudged rounding."""
    while (at := sql.find("near(")) >= 0:
        depth, comma, end = 0, -1, at + 4
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            if depth == 0:
                break
            end += 1
        value, places = sql[at + 5 : comma], sql[comma + 1 : end].strip()
        sql = f"{sql[:at]}round(({value}) + {NUDGE}, {places}){sql[end + 1:]}"
    return sql


def used_views(sql: str) -> list[str]:
    """Views a text needs, in definition order."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf'(?<!["\w.]){name}(?!["\w])', text):
                needed.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in needed]


def with_views(sql: str) -> str:
    names = used_views(sql)
    if not names:
        return spell_out(sql)
    # The levels of the forest are read more than once each.
    kept = {name for name in names if name.startswith("forest_") and "walk" not in name}
    ctes = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in kept else ''}({VIEWS[name]})" for name in names)
    return spell_out(f"WITH {ctes}\n{sql.strip()}")
