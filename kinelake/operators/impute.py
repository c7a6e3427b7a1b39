"""Hierarchical imputation of epoch series by calendar cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.scalar import hour, minute, weekday


def hierarchical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values take the mean of (weekday, hour, minute), then of (weekend, hour, minute), then of (hour, minute); each mean sees what was filled before. Cells without any value stay null. One exchange serves all three."""
    keyed = df.withColumns({"wd_": weekday(), "h_": hour(), "m_": minute()}).withColumn("we_", F.col("wd_") >= 5).repartition("subject_id", "h_", "m_")
    for extra in (["wd_"], ["we_"], []):
        cell = Window.partitionBy("subject_id", "h_", "m_", *extra)
        keyed = keyed.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(cell)) for c in columns})
    return keyed.drop("wd_", "h_", "m_", "we_")
