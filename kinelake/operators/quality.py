"""Recording quality: duplicates, step, wear, exclusions, non-wear bouts, calibration. Series are (subject_id, us, value columns); missing is null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.scalar import DAY, HOUR, day_text, div

def by_subject() -> Window:
    return Window.partitionBy("subject_id")


def dedupe_first(df: DataFrame, order: str, by: tuple[str, ...] = ("subject_id", "us")) -> DataFrame:
    """The first row in `order` of each time."""
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("nth_ = 1").drop("nth_")


def with_next(df: DataFrame, columns: list[str], chunk_us: int = HOUR) -> DataFrame:
    """df with next_: us and columns of the subject's next row (null after its last). Rows are ordered within chunks of time; a chunk's last row takes the head of the next chunk from a table of a row a chunk, so no subject is gathered."""
    row = F.struct("us", *columns)
    cut = df.withColumn("chunk_", div("us", chunk_us))
    heads = cut.groupBy("subject_id", "chunk_").agg(F.min(row).alias("head_"))
    after = heads.select("subject_id", "chunk_", F.lead("head_").over(by_subject().orderBy("chunk_")).alias("after_"))
    own = cut.withColumn("next_", F.lead(row).over(Window.partitionBy("subject_id", "chunk_").orderBy("us")))
    return own.join(after, ["subject_id", "chunk_"]).withColumn("next_", F.coalesce("next_", "after_")).drop("chunk_", "after_")


def infer_step(df: DataFrame) -> DataFrame:
    """subject_id, step_s: the mean of the time differences within their quartiles, inclusive. Differences are counted once; quartiles and mean come from the counts."""
    gaps = with_next(df.select("subject_id", "us"), []).select("subject_id", (F.col("next_.us") - F.col("us")).alias("gap")).where("gap is not null")
    counts = gaps.groupBy("subject_id", "gap").agg(F.count("*").alias("n"))
    bounds = counts.groupBy("subject_id").agg(F.percentile("gap", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q"))
    near = counts.join(bounds, "subject_id").where((F.col("gap") >= F.col("q")[0]) & (F.col("gap") <= F.col("q")[1]))
    return near.groupBy("subject_id").agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n") / 1e6).alias("step_s"))


def sample_rate(df: DataFrame) -> DataFrame:
    """subject_id, rate: samples a second, rounded."""
    return infer_step(df).select("subject_id", F.round(1 / F.col("step_s")).cast("int").alias("rate"))


def _step(dt: float | str) -> Column:
    """Seconds of a row in an aggregate: a number, or a column of which each subject has one value."""
    return F.max(dt) if isinstance(dt, str) else F.lit(float(dt))


def wear_stats(df: DataFrame, columns: list[str], dt: float | str) -> DataFrame:
    """Start, end, first and last valid time, wear and non-wear days, and whether every clock hour is worn at least one percent. dt: seconds of a row, or the column that has them."""
    worn = _all_present(columns)
    hours = df.groupBy("subject_id", div(F.pmod("us", F.lit(DAY)), HOUR).alias("h")).agg(
        F.count("*").alias("n"), F.count_if(worn).alias("ok"), F.min("us").alias("lo"), F.max("us").alias("hi"),
        F.min(F.when(_any_present(columns), F.col("us"))).alias("first"), F.max(F.when(_any_present(columns), F.col("us"))).alias("last"), _step(dt).alias("dt"),
    )
    return hours.groupBy("subject_id").agg(
        F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.min("first").alias("wear_start_us"), F.max("last").alias("wear_end_us"),
        (F.sum("n") * F.max("dt") / 86400 - F.sum(F.col("n") - F.col("ok")) * F.max("dt") / 86400).alias("wear_days"), (F.sum(F.col("n") - F.col("ok")) * F.max("dt") / 86400).alias("nonwear_days"),
        ((F.count("*") == 24) & (F.min(F.col("ok") / F.col("n")) >= 0.01)).cast("int").alias("covers_24h"),
    )


def _all_present(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(c).isNotNull()
    return out


def _any_present(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out |= F.col(c).isNotNull()
    return out


def daily_wear(df: DataFrame, columns: list[str], dt: float) -> DataFrame:
    """subject_id, date, wear_hours of the dates that have rows."""
    return df.groupBy("subject_id", day_text("us").alias("date")).agg(F.round(F.count_if(_all_present(columns)) * dt / 3600, 2).alias("wear_hours"))


def drop_edge_days(df: DataFrame, which: str) -> DataFrame:
    """Rows without the first, the last or both calendar days of their subject. The ends come from an aggregate, so no subject's rows are gathered."""
    if which not in ("first", "last", "both"):
        raise ValueError(f"which day: {which!r}")
    day = div("us", DAY)
    ends = df.groupBy("subject_id").agg(F.min(day).alias("lo_"), F.max(day).alias("hi_"))
    keep = {"first": day > F.col("lo_"), "last": day < F.col("hi_"), "both": (day > F.col("lo_")) & (day < F.col("hi_"))}[which]
    return df.join(ends, "subject_id").where(keep).select(df.columns)


def blank_low_wear_days(df: DataFrame, columns: list[str], dt: float | str, least_s: float) -> DataFrame:
    """Values of days with less wear than least_s become null; rows stay. dt: seconds of a row, or the column that has them."""
    days = df.groupBy("subject_id", div("us", DAY).alias("d_")).agg((F.count_if(_all_present(columns)) * _step(dt) >= least_s).alias("ok_"))
    return df.withColumn("d_", div("us", DAY)).join(days, ["subject_id", "d_"]).withColumns({c: F.when(F.col("ok_"), F.col(c)) for c in columns}).select(df.columns)


def window_stats(df: DataFrame, columns: list[str], window_s: float = 10) -> DataFrame:
    """subject_id, us (of the window), and mean m<c> and standard deviation s<c> of each column: what calibration and non-wear are told by, in one pass."""
    size = int(window_s * 1e6)
    return df.groupBy("subject_id", (div("us", size) * size).alias("us")).agg(*(f(c).alias(f"{n}{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))


def nonwear_bouts(df: DataFrame, columns: list[str], window_s: float = 10, sd: float = 0.015, least_s: float = 5400) -> DataFrame:
    """subject_id, start_us, end_us: runs of still windows (standard deviation below sd on every column) of more than least_s."""
    return still_bouts(window_stats(df, columns, window_s), columns, window_s, sd, least_s)


def still_bouts(stats: DataFrame, columns: list[str], window_s: float = 10, sd: float = 0.015, least_s: float = 5400) -> DataFrame:
    """nonwear_bouts from window_stats."""
    size, still = int(window_s * 1e6), F.lit(True)
    for c in columns:
        still &= F.coalesce(F.col(f"s{c}"), F.lit(0.0)) < sd
    quiet = stats.where(still).select("subject_id", "us")
    order = by_subject().orderBy("us")
    new = F.coalesce((F.col("us") - F.lag("us").over(order) != size).cast("int"), F.lit(1))
    runs = quiet.withColumn("new_", new).withColumn("run", F.sum("new_").over(order))
    bouts = runs.groupBy("subject_id", "run").agg(F.min("us").alias("start_us"), (F.max("us") + size).alias("end_us"))
    return bouts.where(F.col("end_us") - F.col("start_us") > int(least_s * 1e6)).select("subject_id", "start_us", "end_us")


def blank_bouts(df: DataFrame, bouts: DataFrame, columns: list[str], window_s: float = 10) -> DataFrame:
    """df with null values inside bouts (subject_id, start_us, end_us, whole windows of window_s); an equi-join on windows, no range join."""
    size = int(window_s * 1e6)
    marks = bouts.select("subject_id", F.explode(F.sequence(F.col("start_us"), F.col("end_us") - size, F.lit(size))).alias("w_"), F.lit(True).alias("off_"))
    made = df.withColumn("w_", div("us", size) * size).join(marks, ["subject_id", "w_"], "left")
    return made.withColumns({c: F.when(F.col("off_").isNull(), F.col(c)) for c in columns}).select(df.columns)


def head(df: DataFrame, n: int) -> DataFrame:
    """Each subject's first n rows by time, for probing."""
    return df.withColumn("nth_", F.row_number().over(by_subject().orderBy("us"))).where(F.col("nth_") <= n).drop("nth_")


#: Still windows that a calibration needs, and the error (g) that it must come below.
CALIBRATION_LEAST, CALIBRATION_ERROR = 10, 0.01


def calibration(stats: DataFrame, sd: float = 0.015, rounds: int = 1000, least: float = 0.0) -> DataFrame:
    """A row for each subject that has windows: gain g<c> and offset o<c> of each axis that bring still means to the unit sphere, still (windows used), error_before and error_after (mean distance from the sphere, g), ok.

    ok is 0, and the gain 1 and the offset 0, where there are too few still windows or the fit leaves no smaller error below CALIBRATION_ERROR. stats: window_stats of x, y, z.
    """
    quiet = " and ".join(f"s{c} < {sd} and s{c} >= {least}" for c in "xyz")
    still = stats.where(quiet).select("subject_id", "mx", "my", "mz")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        points = part[["mx", "my", "mz"]].to_numpy()
        points = points[np.linalg.norm(points, axis=1) > 1e-8]
        gain, offset = np.ones(3), np.zeros(3)
        error = lambda: float(np.abs(np.linalg.norm(points * gain + offset, axis=1) - 1).mean()) if len(points) else None
        before = error()
        for _ in range(rounds if len(points) >= CALIBRATION_LEAST else 0):
            now = points * gain + offset
            target = now / np.linalg.norm(now, axis=1, keepdims=True)
            step_gain, step_offset = np.ones(3), np.zeros(3)
            for k in range(3):
                if now[:, k].std() > 1e-9:
                    step_gain[k], step_offset[k] = np.polyfit(now[:, k], target[:, k], 1)
            gain, offset = gain * step_gain, offset * step_gain + step_offset
            if np.abs(step_gain - 1).max() < 1e-6 and np.abs(step_offset).max() < 1e-6:
                break
        after = error()
        ok = len(points) >= CALIBRATION_LEAST and after < CALIBRATION_ERROR and after <= before
        if not ok:
            gain, offset, after = np.ones(3), np.zeros(3), before
        return pd.DataFrame([[part["subject_id"].iloc[0], *gain, *offset, len(points), before, after, int(ok)]], columns=names)

    kind, names = dict(stats.dtypes)["subject_id"], ["subject_id", "gx", "gy", "gz", "ox", "oy", "oz", "still", "error_before", "error_after", "ok"]
    found = still.groupBy("subject_id").applyInPandas(fit, f"subject_id {kind}, gx double, gy double, gz double, ox double, oy double, oz double, still long, error_before double, error_after double, ok int")
    every = stats.select("subject_id").distinct().join(found, "subject_id", "left")
    return every.fillna(1.0, ["gx", "gy", "gz"]).fillna(0.0, ["ox", "oy", "oz"]).fillna(0, ["still", "ok"])


def calibrated(df: DataFrame, found: DataFrame) -> DataFrame:
    """df with the gains and offsets of calibration() applied to x, y, z; subjects without any stay as they are."""
    both = df.join(found.select("subject_id", *(f"{k}{c}" for c in "xyz" for k in "go")), "subject_id", "left")  # a row a subject
    return both.withColumns({c: F.col(c) * F.coalesce(f"g{c}", F.lit(1.0)) + F.coalesce(f"o{c}", F.lit(0.0)) for c in "xyz"}).select(df.columns)


def calibrate(df: DataFrame, sd: float = 0.015, window_s: float = 10, rounds: int = 1000, least: float = 0.0) -> DataFrame:
    """x, y, z calibrated by their subject's own still windows."""
    return calibrated(df, calibration(window_stats(df, ["x", "y", "z"], window_s), sd, rounds, least))
