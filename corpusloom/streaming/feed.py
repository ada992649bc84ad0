"""Streams of shards and events, with the cursor kept in Spark's own offset log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shard_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Shards of a folder as a stream, some files a micro-batch; resumes after the last committed batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, delay: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; rows later than the watermark are dropped by a stream."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
