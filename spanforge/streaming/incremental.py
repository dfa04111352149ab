"""Structured Streaming forms of what is additive or row-wise: QC and score histograms, coverage by window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_histogram(stream: DataFrame, column: str) -> DataFrame:
    """(value, count) so far; use output mode complete or update."""
    return stream.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and ``by``; rows later than ``late`` behind the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("count")).select(F.col("w.start").alias("window_start"), by, "count")


def additive(stream: DataFrame, summarise, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's partial aggregate (``summarise``: batch -> DataFrame) to ``path``, tagged with its number; readers sum."""

    def put(batch: DataFrame, number: int) -> None:
        summarise(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
