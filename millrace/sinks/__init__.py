"""Logs that only grow, and exports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import scratch


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return scratch(spark, name)


class Log:
    """A table that batches are appended to: each under its own name, so that a batch that is tried again replaces itself.

    Rows are written to a fresh folder first; a small table with the batch's name, the folder and the time then publishes
    them. A retry that fails on its way leaves what had been there, and readers see whole batches only. by: a column whose
    values get folders of their own. at: the log's folder, by default a new one in the shared folder.
    """

    _COMMIT = "batch string, folder string, at timestamp"

    def __init__(self, spark: SparkSession, name: str, by: str | None = None, at: str | None = None):
        self.spark, self.by, self.at = spark, by, at or folder(spark, name)

    def append(self, batch: str, rows: DataFrame) -> None:
        fresh = uuid.uuid4().hex
        (rows.write.partitionBy(self.by) if self.by else rows.write).parquet(f"{self.at}/rows/{fresh}")
        told = self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(fresh).alias("folder"), F.current_timestamp().alias("at"))
        told.coalesce(1).write.mode("append").parquet(f"{self.at}/commits")

    def read(self, schema: T.StructType) -> DataFrame:
        """The rows of all batches, each in its last published form."""
        commits = self.spark.read.schema(self._COMMIT).parquet(f"{self.at}/commits")
        last = commits.groupBy("batch").agg(F.max_by("folder", F.struct("at", "folder")).alias("folder")).collect()  # a row for each batch
        parts = [self.spark.read.schema(schema).parquet(f"{self.at}/rows/{r['folder']}").select(schema.names) for r in last]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)


def exported(df: DataFrame, kind: str, at: str | None = None) -> DataFrame:
    """df as it is read back from a snapshot of the given format, which replaces an earlier one."""
    at = at or folder(df.sparkSession, "export")
    df.write.mode("overwrite").format(kind).save(at)
    return df.sparkSession.read.schema(df.schema).format(kind).load(at)
