"""Sinks: series, daily tables, summaries, windows, fold results."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_series(df: DataFrame, path: str, classes: list[str]) -> None:
    """Epoch series as gzip CSV, a folder for each subject; labels become one 0/1 column for each class."""
    wide = df.withColumns({c: (F.col("label") == c).cast("double") for c in classes}).withColumn("time", F.timestamp_micros("us").cast("timestamp_ntz"))
    wide.select("subject_id", "time", "acc", *classes).repartition("subject_id").sortWithinPartitions("subject_id", "time").write.partitionBy("subject_id").option("header", True).option("compression", "gzip").csv(path)


def write_daily(df: DataFrame, path: str) -> None:
    """Daily table as gzip CSV with the file name first."""
    df.select(F.col("subject_id").alias("Filename"), *(c for c in df.columns if c != "subject_id")).write.option("header", True).option("compression", "gzip").csv(path)


def write_summaries(documents: DataFrame, path: str) -> int:
    """subject_id, summary (JSON): <path>/<subject>/<subject>-outputSummary.json for each subject, written by the executors; how many. readers.read_summaries reads them. A task that runs again writes the same files."""

    def run(batches):
        for batch in batches:
            for subject, text in zip(batch.column("subject_id").to_pylist(), batch.column("summary").to_pylist(), strict=True):
                store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                store.create_dir(f"{inner}/{subject}", recursive=True)
                with store.open_output_stream(f"{inner}/{subject}/{subject}-outputSummary.json") as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = documents.select(F.col("subject_id").cast("string").alias("subject_id"), "summary")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def collate(summaries: DataFrame, path: str) -> None:
    """One CSV table over all subjects; what a subject lacks is blank, and nested values are JSON."""
    flat = summaries.select(*(F.to_json(f"`{f.name}`").alias(f.name) if f.dataType.typeName() == "struct" else F.col(f"`{f.name}`") for f in summaries.schema))
    flat.write.option("header", True).csv(path)


def write_windows(df: DataFrame, path: str, info: dict | None = None) -> None:
    """Windows as Parquet; the parameters beside them as one JSON row."""
    df.write.parquet(path)
    if info:
        df.sparkSession.range(1).select(*(F.lit(str(v)).alias(k) for k, v in info.items())).coalesce(1).write.json(f"{path.rstrip('/')}-info")


def write_folds(df: DataFrame, path: str) -> None:
    """Fold results: one row for each epoch, by model and fold."""
    df.write.partitionBy("model", "fold").parquet(path)
