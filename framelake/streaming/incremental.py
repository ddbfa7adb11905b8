"""The library as a stream: files arrive, redeliveries drop out, counts move with event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream; its checkpoint makes a stopped run resume where it was."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def without_redeliveries(stream: DataFrame, key: str = "file_id", time: str = "seen_at", delay: str = "7 days") -> DataFrame:
    """The first delivery of each key; a key is forgotten when the watermark has passed it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, key: str, time: str = "seen_at", window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """``window_start, key, n, bytes`` by event time; rows later than ``delay`` are dropped."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, window), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n", "bytes")


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there now, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
