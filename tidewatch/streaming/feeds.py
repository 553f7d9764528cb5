"""Streams: sessions with late data, and a change feed that is put into a state exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """Parquet files as they come, at most ``files`` in a batch."""
    r = spark.readStream.schema(schema)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    return r.parquet(path)


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key: rows up to ``gap`` apart, first and last time and number; rows later than ``late`` are dropped.

    Works on streams and tables alike. Times without a zone become instants, as watermarks need them.
    """
    t = F.col(time).cast("timestamp")
    e = events.withColumn("_t", t).withWatermark("_t", late)
    w = F.session_window("_t", gap)
    return e.groupBy(*keys, w).agg(F.min("_t").alias("first_ts"), F.max("_t").alias("last_ts"), F.count("*").alias("n")).drop("session_window")


def daily(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Counts by day, with the calendar month that each day is in.

    Windows of fixed length cannot say a month, so a reader sums the days of one; a day leaves the state
    once its watermark has passed.
    """
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    days = e.groupBy(*keys, F.window("_t", "1 day").alias("_d")).agg(F.count("*").alias("n"))
    return days.select(*keys, F.date_format("_d.start", "yyyyMM").alias("month"), F.to_date("_d.start").alias("day"), "n")


def merge_batches(feed: DataFrame, state_path: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]):
    """Start a query that puts each batch into a state of snapshots, ``state_path/v=<batch>``.

    A batch that is repeated after a failure writes its own snapshot again from the one before it, so
    nothing counts twice; older snapshots are deleted. All that is there is read, then the query ends.
    """
    spark = feed.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{state_path}/v={number - 1}") if number else None
        merge(old, batch).write.mode("overwrite").parquet(f"{state_path}/v={number}")
        past = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state_path}/v={number - 2}")
        past.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(past, True)

    return feed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
