"""Readers of the project's Parquet tables: a file or a directory of files for each table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; Parquet keeps the schema, so nothing is inferred from rows."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def published(df: DataFrame, path: str) -> DataFrame:
    """Write a table as a new version beside the old ones and make it the one to be read; gives it back.

    A version becomes readable by one small file that names it, written only when all its rows are, so a reader sees the
    old table or the new one, never a part; a job that fails leaves the old one.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return current(spark, path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table of `published` that was written last."""
    version = spark.read.schema("version string").json(f"{path}/current").first().version
    return spark.read.parquet(f"{path}/versions/{version}")
