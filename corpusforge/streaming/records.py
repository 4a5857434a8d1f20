"""Incremental forms: shard folders and log folders as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def record_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100, format: str = "json") -> DataFrame:
    """Records of a folder's files as they arrive; the query's checkpoint is the resumable cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format).load(path)


def first_seen(stream: DataFrame, key: Column, time: str | None = None, within: str = "1 day") -> DataFrame:
    """Rows whose key has not been seen; with a time column, within a watermark, so that the state stays bounded."""
    keyed = stream.withColumn("_key", key)
    if time is None:
        return keyed.dropDuplicates(["_key"]).drop("_key")
    return keyed.withWatermark(time, within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(stream: DataFrame, time: str, width: str, by: list[str], value: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Rows and sum of ``value`` per event-time window and group; rows later than ``late`` are dropped from a stream."""
    if stream.isStreaming:  # watermarks take no local times
        stream = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counts = stream.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def append_log(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a folder of JSON lines, keys in sorted order."""
    writer = stream.select(*sorted(stream.columns)).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
