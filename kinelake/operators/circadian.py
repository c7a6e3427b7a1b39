"""Rhythm metrics of regular epoch series (subject_id, us, value columns)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.scalar import DAY, div

def by_subject() -> Window:
    return Window.partitionBy("subject_id")


def sleep_signal(classes: list[str], sleep: str = "sleep") -> Column:
    """1 where sleep is the strongest class, ties to the first in sorted order, else -1; a row without values is -1."""
    names = sorted(classes)
    best = F.greatest(*(F.col(c) for c in names))
    winner = F.lit(None).cast("string")
    for c in reversed(names):
        winner = F.when(F.col(c) == best, F.lit(c)).otherwise(winner)
    return F.when(winner == sleep, 1.0).otherwise(-1.0)


def psd(df: DataFrame, value: Column, epoch_s: float) -> DataFrame:
    """subject_id, psd: power at one cycle a day."""
    ordered = df.select("subject_id", (F.row_number().over(by_subject().orderBy("us")) - 1).alias("t"), value.cast("double").alias("v"))
    w = 2 * math.pi * epoch_s / 86400
    return ordered.groupBy("subject_id").agg((F.pow(F.sum(F.col("v") * F.cos(F.col("t") * w)) / F.count("*"), 2) + F.pow(F.sum(F.col("v") * F.sin(F.col("t") * w)) / F.count("*"), 2)).alias("psd"))


def m10_l5(df: DataFrame, value: str, epoch_s: float, include_last: bool = False) -> DataFrame:
    """subject_id, m10, l5, relative_amplitude, status. Days count from each subject's first epoch; as many as whole days lie between first and last epoch; the last window start of a day is skipped unless include_last. Sliding sums are differences of prefix sums."""
    ten, five = int(10 * 3600 / epoch_s), int(5 * 3600 / epoch_s)
    ends = df.groupBy("subject_id").agg(F.min("us").alias("first"), div(F.max("us") - F.min("us"), DAY).alias("days"))
    days = df.select("subject_id", "us", F.col(value).alias("v")).join(ends, "subject_id").withColumn("day", div(F.col("us") - F.col("first"), DAY))
    by = Window.partitionBy("subject_id", "day")
    order = by.orderBy("us")
    inside = days.where("day < days").withColumns({"n": F.count("*").over(by), "rn": F.row_number().over(order), "upto": F.sum(F.coalesce("v", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0)), "miss": F.count_if(F.col("v").isNull()).over(order.rowsBetween(Window.unboundedPreceding, 0))})

    def window(size: int) -> Column:
        before = lambda c, own: F.col(c) - own
        total = F.lead("upto", size - 1).over(order) - before("upto", F.coalesce("v", F.lit(0.0)))
        gaps = F.lead("miss", size - 1).over(order) - before("miss", F.col("v").isNull().cast("long"))
        return F.when(F.col("rn") <= F.col("n") - size + (1 if include_last else 0), F.when(gaps == 0, total / size).otherwise(float("nan")))

    slid = inside.withColumns({"w10": window(ten), "w5": window(five)})
    spoilt = lambda c: F.max(F.isnan(c))
    daily = slid.groupBy("subject_id", "day").agg(F.when(~F.coalesce(spoilt("w10"), F.lit(False)), F.max("w10")).alias("m10"), F.when(~F.coalesce(spoilt("w5"), F.lit(False)), F.min("w5")).alias("l5"))
    known = daily.groupBy("subject_id").agg(F.when(F.count("m10") == F.count("*"), F.avg("m10")).alias("m10"), F.when(F.count("l5") == F.count("*"), F.avg("l5")).alias("l5"))
    every = df.select("subject_id").distinct().join(known.withColumn("some", F.lit(True)), "subject_id", "left")
    return every.select("subject_id", "m10", "l5", ((F.col("m10") - F.col("l5")) / (F.col("m10") + F.col("l5"))).alias("relative_amplitude"), F.when(F.col("some"), "ok").otherwise("NA_too_few_days").alias("status"))


def _refine(y: np.ndarray, k: float) -> float:
    """The place between bins k - 1 and k + 1 where the transform is largest, by golden section; a search that starts from these two bins without staying between them can end on a side lobe."""
    t = np.arange(len(y))
    f = lambda x: abs(np.sum(y * np.exp(-2j * np.pi * x * t / len(y))))
    gold, lo, hi = (1 + 5**0.5) / 2, k - 1.0, k + 1.0
    for _ in range(60):
        x1, x2 = hi - (hi - lo) / gold, lo + (hi - lo) / gold
        lo, hi = (lo, x2) if f(x1) > f(x2) else (x1, hi)
    return (lo + hi) / 2


def dominant_frequency(df: DataFrame, value: str, epoch_s: float) -> DataFrame:
    """subject_id, frequency: cycles a day where the spectrum without its mean is largest; null for fewer than three values or missing ones."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        y = part.sort_values("us")[value].to_numpy(float)
        out = None
        if len(y) > 2 and np.isfinite(y).all():
            k = 1 + int(np.abs(np.fft.rfft(y))[1:].argmax())  # the upper half mirrors the lower one, and the first of equals counts
            out = _refine(y, k) / (len(y) * epoch_s / 86400)
        return pd.DataFrame({"subject_id": [part["subject_id"].iloc[0]], "frequency": [out]})

    return df.select("subject_id", "us", value).groupBy("subject_id").applyInPandas(kernel, f"subject_id {dict(df.dtypes)['subject_id']}, frequency double")


def rolling_minute(df: DataFrame, value: str, top: float = 2000.0) -> DataFrame:
    """df with `smooth`: the mean of the last minute, clipped to [0, top]."""
    frame = by_subject().orderBy("us").rangeBetween(-59_999_999, 0)
    return df.withColumn("smooth", F.greatest(F.least(F.avg(value).over(frame), F.lit(top)), F.lit(0.0)))


def first_days(df: DataFrame, n: int) -> DataFrame:
    """Rows of each subject's first n days. The first times come from an aggregate that is joined back."""
    firsts = df.groupBy("subject_id").agg(F.min("us").alias("first_"))
    return df.join(firsts, "subject_id").where(F.col("us") < F.col("first_") + n * DAY).select(df.columns)
