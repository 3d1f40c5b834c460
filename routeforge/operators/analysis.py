"""Season summaries: wins, quarterbacks, teams and receivers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeforge.constants import PLAY_KEYS, ROUTE_KEYS


def team_win_rate(games: DataFrame) -> DataFrame:
    """Share of games won; a draw is no win for either side."""
    home, away = F.col("homeFinalScore"), F.col("visitorFinalScore")
    sides = games.select(F.col("homeTeamAbbr").alias("teamAbbr"), (home > away).alias("win")).unionByName(
        games.select(F.col("visitorTeamAbbr").alias("teamAbbr"), (home < away).alias("win"))
    )
    return sides.groupBy("teamAbbr").agg(F.avg(F.col("win").cast("int")).alias("win")).orderBy("win", "teamAbbr")


def _flag_repeats(rows: DataFrame) -> DataFrame:
    per_play = rows.groupBy(*PLAY_KEYS).agg((F.count("*") > 1).alias("duplicated"))
    return rows.join(per_play, PLAY_KEYS)


def quarterbacks(player_play: DataFrame, players: DataFrame, backups: list[str]) -> DataFrame:
    """Quarterbacks of each play. Where a play has several, those named as backups go;
    the flag then tells which plays still have several."""
    passers = (
        player_play.select(*ROUTE_KEYS)
        .join(players.select("nflId", "displayName", "position"), "nflId")
        .filter(F.col("position") == "QB")
    )
    kept = _flag_repeats(passers).filter(~(F.col("duplicated") & F.col("displayName").isin(backups)))
    return _flag_repeats(kept.drop("duplicated"))


def targeted_scores(scores: DataFrame, player_play: DataFrame) -> DataFrame:
    return scores.join(
        player_play.select(*ROUTE_KEYS, "teamAbbr", "wasTargettedReceiver", "hadPassReception"),
        ROUTE_KEYS,
        "left",
    ).filter(F.col("wasTargettedReceiver") == 1)


def _rates(targets: DataFrame, key: str) -> DataFrame:
    return targets.groupBy(key).agg(
        F.avg("orpsp").alias("orpsp"),
        F.avg("hadPassReception").alias("hadPassReception"),
        F.count("wasTargettedReceiver").alias("targets"),
    )


def team_stats(targets: DataFrame) -> DataFrame:
    return _rates(targets, "teamAbbr").drop("targets")


def quarterback_stats(targets: DataFrame, passers: DataFrame, least: int = 50) -> DataFrame:
    thrown = targets.join(passers.select(*PLAY_KEYS, "displayName"), PLAY_KEYS)
    return _rates(thrown, "displayName").filter(F.col("targets") >= least)


def player_stats(targets: DataFrame, players: DataFrame, least: int = 10) -> DataFrame:
    """Receivers with enough targets. Few groups are left when the names are joined."""
    return _rates(targets, "nflId").filter(F.col("targets") >= least).join(players, "nflId")


def correlation(stats: DataFrame, name: str) -> DataFrame:
    """Pearson r of rate on mean score; null for constant input instead of an error."""
    x, y = "orpsp", "hadPassReception"
    varies = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    r = F.when(varies, F.try_divide(F.covar_pop(x, y), spread))
    return stats.agg(F.lit(name).alias("stats"), r.alias("r"), F.count("*").alias("n"))


def trend(stats: DataFrame, name: str) -> DataFrame:
    """Least-squares line of rate on mean score."""
    x, y = "orpsp", "hadPassReception"
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return stats.agg(
        F.lit(name).alias("stats"),
        slope.alias("slope"),
        (F.avg(y) - slope * F.avg(x)).alias("intercept"),
    )


def top_scores(scores: DataFrame, above: float = 0.8, how_many: int = 10) -> DataFrame:
    return scores.filter(F.col("orpsp") > above).orderBy(*ROUTE_KEYS).limit(how_many)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).count().orderBy(F.desc("count"), *columns)


def distinct_plays(df: DataFrame) -> DataFrame:
    return df.select(*PLAY_KEYS).distinct()
