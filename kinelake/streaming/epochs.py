"""Epoching of live streams: tumbling windows with a watermark; late rows beyond it are dropped by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_epochs(stream: DataFrame, time: str, subject: str, value: str, epoch: str = "30 seconds", lateness: str = "10 minutes") -> DataFrame:
    """subject, epoch_start, n, mean of a streaming (or batch) DataFrame."""
    rows = stream.withColumn("time_", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        rows = rows.withWatermark("time_", lateness)
    return rows.groupBy(F.col(subject).alias("subject_id"), F.window("time_", epoch).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select("subject_id", F.col("w.start").alias("epoch_start"), "n", "mean")
