"""Incremental ingest: file streams into de-duplicated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_stream(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """New JSON-lines files of a folder as a stream; a file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def distinct_texts(stream: DataFrame, file: str, text: str, event_time: str, delay: str = "1 day") -> DataFrame:
    """First row of each (file, text) hash within the watermark, whose delay
    bounds the state."""
    keyed = stream.withWatermark(event_time, delay).withColumn("text_key", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    return keyed.dropDuplicatesWithinWatermark([file, "text_key"])


def arrivals(stream: DataFrame, event_time: str, window: str = "10 minutes", delay: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Counts by window and key, final once the watermark has passed."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window), key).agg(F.count(F.lit(1)).alias("n"))


def append_to(stream: DataFrame, folder: str, checkpoint: str, partition_by: tuple[str, ...] = ()):
    """Append exactly once to Parquet; all files at hand, then stop."""
    w = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (w.partitionBy(*partition_by) if partition_by else w).start()
