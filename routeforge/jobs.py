"""Command line of the jobs, from source files to written tables.

    python -m routeforge.jobs clusters SOURCE STORE [--weeks N] [--rounds N]
    python -m routeforge.jobs open-receivers SOURCE STORE [--rounds N]
    python -m routeforge.jobs route-times SOURCE STORE [--rounds N]
    python -m routeforge.jobs analysis SOURCE STORE
    python -m routeforge.jobs views SOURCE STORE

SOURCE holds tracking_week_<n>.csv, plays.csv, player_play.csv, players.csv and, for the analysis, games.csv; STORE is a folder that all executors
share. Each job reads what earlier ones left in STORE. Run it with spark-submit on a cluster, or as it is.
"""

from __future__ import annotations

import argparse
import sys
import tempfile
import zipfile
from pathlib import Path

if __package__ in (None, ""):  # started by its path, from any folder
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession

from routeforge.operators import boosting
from routeforge.plans.clusters import build_clusters
from routeforge.plans.open_receivers import build_features, train_open_model, train_time_model
from routeforge.plans.summaries import season_summary, season_views
from routeforge.plans.tables import Store
from routeforge.session import build_session, remove_stage_tables
from routeforge.sources import files


def ship_package(spark: SparkSession, folder: str) -> None:
    """Send this package to the executors, so that their Python workers find it wherever the job was started. The driver serves the archive
    from ``folder`` as long as the session lasts."""
    root = Path(__file__).resolve().parent
    archive = Path(folder) / "routeforge.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def _clusters(spark: SparkSession, source: str, store: Store, weeks: int | None, rounds: int) -> None:
    frames = files.read_tracking(spark, source, weeks)
    files.store_tracking(frames, store.path("tracking"))
    frames = files.load_tracking(spark, store.path("tracking"))
    build_clusters(spark, store, frames, files.read_source(spark, source, "player_play"), rounds=rounds)


def _open_receivers(spark: SparkSession, source: str, store: Store, weeks: int | None, rounds: int) -> None:
    frames = files.load_tracking(spark, store.path("tracking"))
    tables = {name: files.read_source(spark, source, name) for name in ("plays", "player_play", "players")}
    build_features(spark, store, frames, tables["plays"], tables["player_play"], tables["players"])
    train_open_model(spark, store, rounds)


def _route_times(spark: SparkSession, source: str, store: Store, weeks: int | None, rounds: int) -> None:
    train_time_model(spark, store, rounds)


def _analysis(spark: SparkSession, source: str, store: Store, weeks: int | None, rounds: int) -> None:
    tables = {name: files.read_source(spark, source, name) for name in ("games", "player_play", "players")}
    season_summary(store, tables["games"], tables["player_play"], tables["players"])


def _views(spark: SparkSession, source: str, store: Store, weeks: int | None, rounds: int) -> None:
    season_views(store, files.load_tracking(spark, store.path("tracking")), files.read_source(spark, source, "plays"))


JOBS = {
    "clusters": _clusters,
    "open-receivers": _open_receivers,
    "route-times": _route_times,
    "analysis": _analysis,
    "views": _views,
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="routeforge", description="Route and pass-play analytics on Spark.")
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("source")
    parser.add_argument("store")
    parser.add_argument("--weeks", type=int, help="the first so many weekly files, in place of all")
    parser.add_argument("--rounds", type=int, default=boosting.ROUNDS)
    parser.add_argument("--master", help="where no cluster manager decides it, such as local[8]")
    given = parser.parse_args(argv)
    spark = build_session(f"routeforge-{given.job}", given.master)
    with tempfile.TemporaryDirectory(prefix="routeforge-") as folder:
        try:
            ship_package(spark, folder)
            JOBS[given.job](spark, given.source, Store(spark, given.store), given.weeks, given.rounds)
        finally:
            remove_stage_tables(spark)
            spark.stop()


if __name__ == "__main__":
    main()
