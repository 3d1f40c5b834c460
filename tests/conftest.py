import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from routeforge.session import build_session, remove_stage_tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_stage_tables(session)
    session.stop()


@pytest.fixture(scope="session")
def season(spark):
    from routeforge.sources.season import Season

    return Season(spark, SMALL)


def rows(df, *columns):
    """Rows of a frame as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


FRAME = (
    "gameId bigint, playId bigint, nflId bigint, displayName string, frameId int, frameType string, "
    "club string, playDirection string, x double, y double, o double, dir double, event string, week int"
)


def frames(spark, spec):
    """Tracking rows from (nflId, frameId, x, y) plus keyword overrides per row."""
    made = []
    for item in spec:
        (who, frame, x, y), extra = item[:4], (item[4] if len(item) > 4 else {})
        row = {
            "gameId": 1, "playId": 1, "nflId": who, "displayName": f"P{who}", "frameId": frame,
            "frameType": "BEFORE_SNAP" if frame < 9 else "SNAP" if frame == 9 else "AFTER_SNAP",
            "club": "A", "playDirection": "right", "x": float(x), "y": float(y), "o": 10.0, "dir": 20.0,
            "event": None, "week": 1, **extra,
        }
        made.append(tuple(row.values()))
    return spark.createDataFrame(made, FRAME)


def player_play(spark, spec):
    """(nflId, runs, route, targeted) on play (1, 1), or with explicit game and play in front."""
    made = [(1, 1, *s) if len(s) == 4 else s for s in spec]
    made = [(g, p, who, "A", runs, route, aim, 0) for g, p, who, runs, route, aim in made]
    return spark.createDataFrame(
        made,
        "gameId bigint, playId bigint, nflId bigint, teamAbbr string, wasRunningRoute int, routeRan string, "
        "wasTargettedReceiver int, hadPassReception int",
    )
