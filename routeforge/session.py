"""Session settings and stage tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators count on. Their joins meet keys that can be
# badly skewed, so a skewed join partition must be split even where this costs the
# following aggregation one more exchange.
_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Tracking files shrink about tenfold on disk. Without this factor the planner takes
    # a frame table for a small one and broadcasts it.
    "spark.sql.sources.fileCompressionFactor": "10.0",
    # Tables filed by play stay so in joins and aggregates by player of a play, and each of their
    # buckets is a task: frames that follow from a row are never moved.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    # Groups that come sorted are added up one after another, without a second sort or a map of them all.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # The JVM never compiles longer methods: such a stage runs as single operators, which are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Drops the shuffle files of a write when it has ended, in place of when the driver next collects garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes of rows that go to a Python worker at a time. Spark's own bound, 64 MB, is held several times over by each
# task: in the JVM's buffers and in the worker's arrays.
_BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

_local_scratch: str | None = None
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("stage_scopes", default=())


def tune(spark: SparkSession) -> SparkSession:
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the call site of every column expression slows down planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a single local machine may go without: it gets a temporary one."""
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="routeforge-")
    return _local_scratch


def _stage_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/routeforge-{spark.sparkContext.applicationId}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session has ``values`` inside, and its own again at the end."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stage_table(df: DataFrame, name: str, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts lineage in storage that outlives an executor, lets several consumers prune
    their own columns from one copy, and gives the planner true sizes, so that it
    broadcasts a small side on evidence and shuffles a large one. The shuffles behind it are
    freed with the write. Inside a ``stage_scope`` the table goes at its end; ``keep`` hands it to the scope around.
    """
    spark = df.sparkSession
    path = f"{_stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    with settings(spark, {_FREE_SHUFFLES: "true", **_BATCH_BYTES}):
        df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_buckets(parts: list[DataFrame], name: str, keys: list[str], buckets: int) -> DataFrame:
    """Write the rows of all ``parts`` into one table filed by the hash of ``keys``, and read it back: joins and aggregates
    by these keys (and more) need no shuffle of it."""
    spark = parts[0].sparkSession
    unique = f"{name}-{uuid.uuid4().hex}"
    table = f"routeforge_{unique}".replace("-", "_")
    with settings(spark, {_FREE_SHUFFLES: "true"}):
        for part in parts:
            placed = part.repartition(buckets, *keys)
            writer = placed.write.format("parquet").mode("append").option("path", f"{_stage_folder(spark)}/{unique}")
            writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end. What is needed after it is staged with ``keep``."""
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in mine:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove_stage_tables(spark: SparkSession) -> None:
    """Drop what this application staged. For the end of an application: frames read from
    a stage table are of no use afterwards."""
    _remove(spark, _stage_folder(spark))
