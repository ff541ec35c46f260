"""Event-time windows and duplicates over streams (inventory rows 373, 374, 381).

The functions take batch frames as well.  ``ts`` must be a TIMESTAMP for a watermark, so plain times are cast in UTC.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.cluster import shared_folder


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, *by: str, delay: str = "1 hour") -> DataFrame:
    """Row 373: counts and sums of windows side by side."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("total"))


def sliding(events: DataFrame, width: str, step: str, *by: str, delay: str = "1 hour") -> DataFrame:
    """Row 373: the same of windows that overlap."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width, step).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("total"))


def sessions(events: DataFrame, gap: str, by: str, delay: str = "1 hour") -> DataFrame:
    """Row 374: runs of events with no pause of ``gap`` or more."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))


def distinct_within(events: DataFrame, *keys: str, delay: str = "1 hour") -> DataFrame:
    """Row 381: the first of each key, forgotten once the watermark has passed it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is now and gives its result as a table.

    Each micro-batch is written by the executors; in complete mode the last one is the result.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/tokenloom-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/rows")

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
