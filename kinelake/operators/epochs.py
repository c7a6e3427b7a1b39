"""Epochs, windows and alignment: tumbling epochs from each subject's own start, window fitting, resizing, nearest grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.scalar import DAY, div

def by_subject() -> Window:
    return Window.partitionBy("subject_id")


def anchored(df: DataFrame, epoch_s: float) -> DataFrame:
    """df with idx and epoch_us of its tumbling epoch, counted from its subject's first time. The first times come from an aggregate, so no subject's rows are gathered or sorted."""
    size = int(epoch_s * 1e6)
    firsts = df.groupBy("subject_id").agg(F.min("us").alias("first_"))
    return df.join(firsts, "subject_id").withColumn("idx", div(F.col("us") - F.col("first_"), size)).withColumn("epoch_us", F.col("first_") + F.col("idx") * size).drop("first_").select(*df.columns, "idx", "epoch_us")


def anchored_grid(df: DataFrame, epoch_s: float, value: str) -> DataFrame:
    """subject_id, idx, epoch_us, n, mean: every epoch from first to last, the empty ones too."""
    size = int(epoch_s * 1e6)
    full = anchored(df, epoch_s).groupBy("subject_id", "idx").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    ends = df.groupBy("subject_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    grid = ends.select("subject_id", "lo", F.explode(F.sequence(F.lit(0), div(F.col("hi") - F.col("lo"), size))).alias("idx"))
    out = grid.join(full, ["subject_id", "idx"], "left")
    return out.select("subject_id", "idx", (F.col("lo") + F.col("idx") * size).alias("epoch_us"), F.coalesce("n", F.lit(0)).alias("n"), "mean")


def day_grid(df: DataFrame, step_s: float) -> DataFrame:
    """subject_id, us: the grid of step_s over each subject's whole days."""
    size = int(step_s * 1e6)
    ends = df.groupBy("subject_id").agg((div(F.min("us"), DAY) * DAY).alias("lo"), (div(F.max("us") + DAY - 1, DAY) * DAY).alias("hi"))
    return ends.select("subject_id", F.explode(F.sequence("lo", F.col("hi") - size, F.lit(size))).alias("us"))


def nearest(grid: DataFrame, df: DataFrame, value: str, tolerance_s: float) -> DataFrame:
    """grid with the value (a number, or a struct of columns) of the nearest row of its subject within the tolerance, ties to the later; null without one. One sorted pass over both sides, no range join."""
    kind = df.schema[value].dataType
    both = grid.select("subject_id", "us", F.lit(1).alias("side"), F.lit(None).cast("long").alias("own"), F.lit(None).cast(kind).alias("v")).unionByName(
        df.select("subject_id", "us", F.lit(0).alias("side"), F.col("us").alias("own"), F.col(value).alias("v"))
    )
    # both frames grow by a row at a time; a frame towards the end of the partition would be summed anew for each row
    back, ahead = (by_subject().orderBy(us, "side").rowsBetween(Window.unboundedPreceding, 0) for us in (F.col("us"), F.col("us").desc()))
    pair = F.when(F.col("own").isNotNull(), F.struct("own", "v"))
    seen = both.withColumns({"b": F.last(pair, True).over(back), "a": F.last(pair, True).over(ahead)}).where("side = 1")
    limit = int(tolerance_s * 1e6)
    db, da = F.col("us") - F.col("b.own"), F.col("a.own") - F.col("us")
    db, da = F.when(db <= limit, db), F.when(da <= limit, da)
    return seen.select("subject_id", "us", F.when(da.isNotNull() & (db.isNull() | (da <= db)), F.col("a.v")).when(db.isNotNull(), F.col("b.v")).alias(value))


def good_windows(df: DataFrame, columns: list[str], length: int, annotation: str | None = None) -> DataFrame:
    """subject_id, idx of windows with exactly `length` rows, no missing value and, if asked, some annotation. df has idx."""
    checks = F.count("*") == length
    for c in columns:
        checks &= F.count(c) == length
    if annotation:
        checks &= F.count(annotation) > 0
    return df.groupBy("subject_id", "idx").agg(checks.alias("good")).where("good").drop("good")


def every_window_label(df: DataFrame, columns: list[str], length: int, dictionary: DataFrame | None, annotation: str, label: str) -> DataFrame:
    """subject_id, idx, label of every window with rows: as window_label for windows that are good and annotated, null for the others."""
    good = good_windows(df, columns, length, annotation)
    voted = window_label(df.join(good, ["subject_id", "idx"], "left_semi"), dictionary, annotation, label)
    return df.select("subject_id", "idx").distinct().join(voted, ["subject_id", "idx"], "left")


def with_truth(predicted: DataFrame, truth: DataFrame, epoch_s: float, annotation: str = "annotation", out: str = "true") -> DataFrame:
    """predicted (subject_id, us: epoch starts) with `out`: the commonest annotation of truth's rows in the epoch, ties to the smallest; null without one."""
    size = int(epoch_s * 1e6)
    firsts = predicted.groupBy("subject_id").agg(F.min("us").alias("first_"))
    placed = truth.join(firsts, "subject_id").where(F.col("us") >= F.col("first_")).withColumn("idx", div(F.col("us") - F.col("first_"), size))
    votes = window_label(placed, None, annotation, annotation).join(firsts, "subject_id").select("subject_id", (F.col("first_") + F.col("idx") * size).alias("us"), F.col(annotation).alias(out))
    return predicted.join(votes, ["subject_id", "us"], "left")


def window_label(df: DataFrame, dictionary: DataFrame | None, annotation: str, label: str) -> DataFrame:
    """subject_id, idx, label: the commonest label of a window's annotated rows; a label that the dictionary leaves missing votes too; ties to the smallest, missing last."""
    rows = df.where(F.col(annotation).isNotNull())
    if dictionary is not None:
        rows = rows.join(dictionary, annotation, "left")  # broadcast by Spark while it is small
    votes = rows.groupBy("subject_id", "idx", label).count()
    first = Window.partitionBy("subject_id", "idx").orderBy(F.col("count").desc(), F.col(label).asc_nulls_last())
    return votes.withColumn("nth_", F.row_number().over(first)).where("nth_ = 1").select("subject_id", "idx", label)


def relabel(df: DataFrame, column: str, mapping: dict[str, str], out: str, strict: bool = False) -> DataFrame:
    """df with `out` by a fixed mapping; unmapped is null, or an error if strict."""
    found = F.element_at(F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)), F.col(column))
    if strict:
        found = F.when(F.col(column).isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown annotation: "), F.col(column))))
    return df.withColumn(out, found)


def fit(values: Column, length: int | Column) -> Column:
    """An array of exactly `length`: cut at the end, or continued from its own start if it holds more than half; else null."""
    n = F.size(values)
    return F.when(n >= length, F.slice(values, 1, length)).when(2 * n > length, F.transform(F.sequence(F.lit(0), F.lit(length) - 1), lambda i: F.element_at(values, (i % n + 1).cast("int"))))


def resize(values: Column, length: int) -> Column:
    """An array of `length` by linear interpolation over both ends."""
    n = F.size(values)

    def at(i: Column) -> Column:
        place = i * (n - 1) / F.lit(float(max(1, length - 1)))
        low = F.floor(place).cast("int")
        high = F.least(low + 1, n - 1)
        a, b = F.element_at(values, low + 1).cast("double"), F.element_at(values, high + 1).cast("double")
        return a + (b - a) * (place - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at))


def flat_recording(windows: DataFrame, start_us: int, step_s: float) -> DataFrame:
    """Rows of window arrays x, y, z at constant steps from a fixed start; other columns repeat. windows has subject_id and idx."""
    length = F.size("x")
    row = windows.select("subject_id", "idx", length.alias("n_"), F.posexplode(F.arrays_zip("x", "y", "z")).alias("at_", "p"), *(c for c in windows.columns if c not in ("subject_id", "idx", "x", "y", "z")))
    return row.select("subject_id", (F.lit(start_us) + ((F.col("idx") * F.col("n_") + F.col("at_")) * int(step_s * 1e6))).alias("us"), "p.x", "p.y", "p.z", *(c for c in windows.columns if c not in ("subject_id", "idx", "x", "y", "z")))


def window_features(df: DataFrame, value: str) -> DataFrame:
    """Moments and quantiles of each window (subject_id, idx)."""
    return df.groupBy("subject_id", "idx").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.stddev_samp(value) / F.avg(value)).alias("cv"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.percentile(value, F.lit(0.25)).alias("p25"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.75)).alias("p75"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"),
    )
