"""Incremental forms: file ingest in micro-batches, duplicate suppression by content, hop windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest_available(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], *, fmt: str = "parquet", files_per_batch: int = 64) -> StreamingQuery:
    """Processes the files that are there and not yet processed, then ends.

    The checkpoint remembers processed files.  A batch writes to a folder of its own number and replaces it when
    repeated, so a restart neither loses nor repeats rows.
    """
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_by_content(stream: DataFrame, hash_col: str, time_col: str, delay: str) -> DataFrame:
    """Rows whose content has not been seen within the watermark.

    The first to arrive stays, which is not the least by stable key that the batch operator keeps.
    """
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([hash_col])


def hop_window_scores(events: DataFrame, time_col: str, value_col: str, by: list[str], *, length: str = "4 seconds", hop: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Mean and maximum of a value over hop windows; the same on a batch and, with late data bounded, on a stream."""
    rows = events.withWatermark(time_col, delay) if events.isStreaming else events
    grouped = rows.groupBy(F.window(time_col, length, hop), *by)
    out = grouped.agg(F.avg(value_col).alias("mean_value"), F.max(value_col).alias("max_value"), F.count("*").alias("rows"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "mean_value", "max_value", "rows")
