"""Streams of executables: the same tables over files as they arrive, each image once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from golode.operators import tables

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def image_stream(spark: SparkSession, path: str, late: str = "1 hour", per_trigger: int = 100) -> DataFrame:
    """Files below a path as a stream; one that is dropped again within ``late`` counts once."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", per_trigger).load(path)
    known = files.withColumn("image_id", F.sha2("content", 256)).withWatermark("modificationTime", late)
    return known.dropDuplicatesWithinWatermark(["image_id"])


def write_functions(images: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Functions of every new image, appended as Parquet."""
    found = tables.functions(images)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type, of a batch or a stream with a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
