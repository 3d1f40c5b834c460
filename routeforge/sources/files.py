"""Reading and writing season files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeforge import schemas
from routeforge.operators.playbook import FORMATION
from routeforge.session import settings

NULL_TOKEN = "NA"
_CSV = {"header": True, "nullValue": NULL_TOKEN, "emptyValue": ""}
#: So many weekly files a task may write at a time; with more weeks it sorts its rows by week.
WEEKS = 32
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def _ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in schema.items())


def _scan(spark: SparkSession, paths: list[str], schema: dict[str, str]) -> DataFrame:
    """Columns are found by name in the header; other columns of a file are not parsed."""
    header = spark.read.option("header", True).csv(paths[0]).columns
    found = {name: schema.get(name, "string") for name in header}
    return spark.read.schema(_ddl(found)).option("header", True).option("nullValue", NULL_TOKEN).csv(paths)


def read_csv(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    """CSV with header; NA and empty fields are null."""
    return _scan(spark, [path], schema).select(*schema)


def read_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of plays, player_play, players, games."""
    return read_csv(spark, f"{folder}/{name}.csv", schemas.SOURCES[name])


def _require(spark: SparkSession, paths: list[str]) -> None:
    """The first of the paths that is not there, in their order, is an error."""
    for path in paths:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
            raise FileNotFoundError(f"no file {path}")


def read_tracking(spark: SparkSession, folder: str, weeks: int | None = None) -> DataFrame:
    """Weekly tracking files (or folders of parts, as write_tracking leaves them) in one scan, with the week from the name: weeks
    1..weeks, each of which has to be there, or all that the folder holds."""
    if weeks is not None and weeks < 1:
        raise ValueError("weeks should be 1 or more")
    if weeks is None:
        paths = [f"{folder}/tracking_week_*.csv"]
    else:
        paths = [f"{folder}/tracking_week_{i}.csv" for i in range(1, weeks + 1)]
        _require(spark, paths)
    # Plain cuts: a pattern would be matched anew for every frame.
    named = F.substring_index(F.col("_metadata.file_path"), "tracking_week_", -1)
    week = F.substring_index(named, ".csv", 1).cast("int")
    frames = _scan(spark, paths, schemas.TRACKING)
    return frames.select(*schemas.TRACKING, week.alias("week"))


def write_tracking(tracking: DataFrame, folder: str) -> None:
    """Frames as one CSV table per week, compressed, named as read_tracking finds them.

    All weeks are written in one pass: a task has a file open for each week it meets, so frames are neither made again for
    every week nor sorted by it. Rows without a week have no table.
    """
    spark = tracking.sparkSession
    placed = tracking.filter(F.col("week").isNotNull()).select(*schemas.TRACKING, "week")
    parts = f"{folder}/_weeks"
    with settings(spark, {_OPEN_FILES: str(WEEKS)}):
        writer = placed.write.mode("overwrite").partitionBy("week").options(**_CSV)
        writer.csv(parts, compression="gzip")
    path = spark._jvm.org.apache.hadoop.fs.Path
    source = path(parts)
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(source):
        name = status.getPath().getName()
        if name.startswith("week="):
            table = path(f"{folder}/tracking_week_{name.removeprefix('week=')}.csv")
            system.delete(table, True)
            if not system.rename(status.getPath(), table):
                raise OSError(f"cannot write {table}")
    system.delete(source, True)


def store_tracking(tracking: DataFrame, path: str) -> None:
    """Columnar copy of the frames, one folder per week, so that a week is a folder scan.
    The jobs should read this, not the CSV files."""
    tracking.write.mode("overwrite").partitionBy("week").parquet(path)


def load_tracking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ddl({**schemas.TRACKING, "week": "int"})).parquet(path)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path, compression=compression)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Formation templates from nested JSON: one row per player, numbered from 1."""
    text = spark.read.text(path, wholetext=True)
    formation = text.select(F.explode(F.from_json("value", schemas.TEMPLATES)).alias(FORMATION[0], "_a"))
    alignment = formation.select(FORMATION[0], F.explode("_a").alias(FORMATION[1], "_t"))
    columns = ["position", "wasRunningRoute", "x", "y"]
    zipped = F.arrays_zip(*[F.col(f"_t.{c}").alias(c) for c in columns])
    players = alignment.select(*FORMATION, F.posexplode(zipped).alias("_i", "_p"))
    return players.select(*FORMATION, (F.col("_i") + 1).alias("slot"), *[F.col(f"_p.{c}").alias(c) for c in columns])


def nest_templates(template: DataFrame) -> DataFrame:
    """The reverse of read_templates: one row with the nested JSON text in ``value``. A
    template is one play, so its lists are as long as a line-up."""
    columns = ["position", "wasRunningRoute", "x", "y"]
    players = F.array_sort(F.collect_list(F.struct("slot", *columns)))
    per_alignment = template.groupBy(*FORMATION).agg(players.alias("_p")).select(
        *FORMATION,
        F.struct(*[F.col("_p").getField(c).alias(c) for c in columns]).alias("_t"),
    )
    per_formation = per_alignment.groupBy(FORMATION[0]).agg(
        F.map_from_entries(F.collect_list(F.struct(FORMATION[1], "_t"))).alias("_m")
    )
    whole = F.map_from_entries(F.collect_list(F.struct(FORMATION[0], "_m")))
    return per_formation.agg(F.to_json(whole).alias("value"))


def write_templates(template: DataFrame, path: str) -> None:
    nest_templates(template).write.mode("overwrite").text(path)


def literal_rows(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A small table from lists of equal length, such as a hand-made design."""
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values())), names)
