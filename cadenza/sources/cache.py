"""A cache of results in a table: bodies by content key, appended by whole runs, looked up by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.folders import store


class ResultCache:
    """Keys and bodies under `folder`. What a run adds becomes visible at once, when its files are committed; of bodies that
    several runs added for one key the largest is the one, whatever the order."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def set(self, rows: DataFrame) -> None:
        """Adds rows (key, body)."""
        rows.select(F.col("key").cast("string").alias("key"), F.col("body").cast("binary").alias("body")).write.mode("append").parquet(self.folder)

    def _rows(self) -> DataFrame:
        files, base = store(self.folder)
        if files.get_file_info(base).type.name != "Directory":
            return self.spark.createDataFrame([], "c_key string, c_body binary")
        return self.spark.read.schema("key string, body binary").parquet(self.folder).groupBy(F.col("key").alias("c_key")).agg(F.max("body").alias("c_body"))

    def get(self, keys: DataFrame) -> DataFrame:
        """`keys` (key, ...) with the body, NULL where there is none."""
        return keys.join(self._rows(), F.col("key") == F.col("c_key"), "left").drop("c_key").withColumnRenamed("c_body", "body")

    def has(self, keys: DataFrame) -> DataFrame:
        """`keys` with `hit`."""
        found = self._rows().select("c_key", F.lit(True).alias("found"))
        return keys.join(found, F.col("key") == F.col("c_key"), "left").drop("c_key").withColumn("hit", F.coalesce("found", F.lit(False))).drop("found")

    def missing(self, keys: DataFrame) -> DataFrame:
        """Those of `keys` that have no body yet: what there is to compute."""
        return keys.join(self._rows(), F.col("key") == F.col("c_key"), "left_anti")

    def clear(self) -> None:
        files, base = store(self.folder)
        if files.get_file_info(base).type.name == "Directory":
            files.delete_dir(base)
