"""Structured Streaming ingestion: late and repeated rows of an append-only block feed.

Beyond the surveyed system, which is batch only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def deduplicated(stream: DataFrame, keys: list[str], time_col: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within `delay` of event time; state older than the watermark is dropped."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def arrivals(stream: DataFrame, time_col: str, delay: str, width: str) -> DataFrame:
    """(window, extraction_method, n_blocks, n_chars) over tumbling windows; rows behind the watermark are left out."""
    return (
        stream.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, width), "extraction_method")
        .agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    )


def upsert_sink(stream: DataFrame, path: str, partition: str, checkpoint: str) -> DataStreamWriter:
    """A writer that replaces the partitions each micro-batch touches; replaying a batch gives the same files."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
