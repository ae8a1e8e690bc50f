"""The usage ledger as a stream: each attempt once, calendar windows, late rows."""

from __future__ import annotations

import atexit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.storage import remove


def attempts(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Ledger files as they arrive; the schema is that of the table, never inferred from new files."""
    path = f"{folder}/ai_usage_logs.parquet"
    schema = spark.read.parquet(path).schema
    source = path if path.endswith("/") else f"{folder}/ai_usage_logs.parque[t]"  # a glob: the table may be a file or a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)


def once(stream: DataFrame, late: str | None = None) -> DataFrame:
    """Each usage_id once, in whatever order the files are read; the state holds all ids, which suits a bounded replay.

    With `late` the state is bounded: ids are kept for that long, and rows further than that behind the newest row of
    the files already read are dropped without a count.
    """
    timed = stream.withColumn("event_time", F.col("created_at").cast("timestamp"))
    if late is None:
        return timed.dropDuplicates(["usage_id"])
    return timed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["usage_id"])


def _sums() -> list[Column]:
    return [F.sum("estimated_cost_usd").cast("decimal(38,6)").alias("cost"), F.count("*").alias("attempts"), F.count_if(F.col("status") == "failed").alias("failed")]


def daily(stream: DataFrame) -> DataFrame:
    """Cost, attempts and failures per provider and day; with a watermark a day is final once it has passed."""
    return stream.groupBy(F.window("event_time", "1 day").alias("w"), "provider").agg(*_sums()).select(F.to_date("w.start").alias("day"), "provider", "cost", "attempts", "failed")


def by_day(rows: DataFrame) -> DataFrame:
    """The same of a table's rows, those without a time too."""
    return rows.groupBy(F.to_date("created_at").alias("day"), "provider").agg(*_sums())


def _written(stream: DataFrame, folder: str, name: str, mode: str) -> DataFrame | None:
    """Run a stream over all that is there now and give what its micro-batches wrote, with the number of the batch; None if there was none.

    A micro-batch writes its rows to a table of its own in the shared folder, and again if it is repeated, so nothing is
    collected and a lost executor costs a re-read.  The tables go with the application.
    """
    spark = stream.sparkSession
    out, checkpoint = f"{folder}/{name}/batches", f"{folder}/{name}/checkpoint"
    numbers = set()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        numbers.add(number)

    atexit.register(remove, spark, f"{folder}/{name}")
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not numbers:
        return None
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)


def arrived(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """All rows of a stream that are there now, each with the number of its micro-batch as `batch`.

    The stream keeps no state, so a micro-batch costs what its own rows cost, however many came before; what a fold over
    all rows needs (each id once, sums by day) is done once, over the table.
    """
    rows = _written(stream, folder, name, "append")
    return stream.sparkSession.createDataFrame([], T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])) if rows is None else rows


def drained(result: DataFrame, folder: str, name: str, keys: tuple[str, ...] = ("day", "provider")) -> DataFrame:
    """Run a stream with state over all that is there now and give what it has written: for each key its newest row.

    State is read and written anew for each micro-batch: to replay many files at once, see `arrived`.
    """
    rows = _written(result, folder, name, "update")
    if rows is None:
        return result.sparkSession.createDataFrame([], result.schema)
    rest = [c for c in result.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
