"""The written tables that jobs hand to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Parquet tables under one shared folder. Reading a table back cuts lineage and shows
    the planner its real size."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def put(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(self.path(name))
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))
