"""Intermediate tables in the folder that all executors share.

Lineage is cut only by files every executor can read again, so that a lost executor costs a re-read and never a
result.  The folder is the session's ``spark.checkpoint.dir``; a folder of our own is made only where that setting
is absent (tests, one machine).  The files go away with the application.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or for a session without one a folder made for it."""
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tallyfold-")
    return _own[app]


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its owner clears the folder
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, computed once and read back with its columns prunable."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyfold/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._table_path = path  # the handle that `discard` takes
    return back


def discard(df: DataFrame) -> None:
    """Remove a table of `written` that nothing reads any more, before the application ends."""
    path = df.__dict__.pop("_table_path", None)
    if path:
        remove(df.sparkSession, path)
