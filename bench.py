"""Time the headline queries; prints one JSON line.

The season tables are derived from the order tables and written first (timed apart, as
``season``); every query then reads those tables in full and writes its whole result to a
sink that discards it.
"""

from __future__ import annotations

import json
import os
import time

from checks.registry import QUERIES
from routeforge.session import build_session, remove_stage_tables
from routeforge.sources.season import Season

HEADLINE = [
    "route_direction",
    "relative_route",
    "route_features",
    "route_name_zones",
    "orpsp_features",
    "play_view",
    "roc_auc",
    "qb_stats",
    "designed_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "20g"),
            "spark.sql.shuffle.partitions": str(int(cpus) * 4),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    season = Season(spark, folder)
    started = time.time()
    for table in ("players", "plays", "player_play", "tracking", "scores", "clusters"):
        getattr(season, table)()
    times = {"season": round(time.time() - started, 2)}
    for name in names:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 2)
    remove_stage_tables(spark)
    spark.stop()
    total = round(sum(v for k, v in times.items() if k != "season"), 2)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
