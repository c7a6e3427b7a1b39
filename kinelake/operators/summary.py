"""Calendar summaries of epoch series. Weekly and hourly averages are means over calendar cells, not over epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.scalar import DAY, day_text, div, hour, minute, weekday

#: Intensity levels in mg, from their rule.
LEVELS = [*range(1, 21), *range(25, 101, 5), *range(125, 501, 25), *range(600, 2001, 100)]

BY = ("subject_id",)


def recorded_hours(df: DataFrame, classes: list[str], dt: float) -> DataFrame:
    """subject_id, day (ordinal of present dates), label, hours, first_weekday: hours of each class, 0 on days without values."""
    daily = df.groupBy("subject_id", div("us", DAY).alias("d")).agg(F.min("us").alias("us"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in classes))
    by = Window.partitionBy("subject_id")
    daily = daily.withColumns({"day": F.dense_rank().over(by.orderBy("d")) - 1, "first_": F.min("us").over(by)}).withColumn("first_weekday", weekday("first_"))
    return daily.select("subject_id", "day", "first_weekday", F.explode(F.map_from_arrays(F.array(*map(F.lit, classes)), F.array(*(F.col(c) * dt / 3600 for c in classes)))).alias("label", "hours"))


def overall(df: DataFrame, column: str, ends: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """by, avg, sd (sample) between the original first and last time. ends: subject_id, lo, hi."""
    return df.join(ends, "subject_id").where("us between lo and hi").groupBy(*by).agg(F.avg(column).alias("avg"), F.stddev_samp(column).alias("sd"))


def cells(df: DataFrame, column: str, by: tuple[str, ...] = BY) -> DataFrame:
    """by, weekday, hour, mean."""
    return df.groupBy(*by, weekday().alias("weekday"), hour().alias("hour")).agg(F.avg(column).alias("mean"))


def week_average(cell: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return cell.groupBy(*by).agg(F.avg("mean").alias("avg"))


def day_of_week_average(cell: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return cell.groupBy(*by, "weekday").agg(F.avg("mean").alias("avg"))


def hour_of_day_average(cell: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return cell.groupBy(*by, "hour").agg(F.avg("mean").alias("avg"))


def weekend_hours(cell: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """by, is_weekend, hour, avg."""
    return cell.groupBy(*by, (F.col("weekday") >= 5).cast("int").alias("is_weekend"), "hour").agg(F.avg("mean").alias("avg"))


def weekend_average(cell: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """by, is_weekend, avg: the mean of the hours' means."""
    return weekend_hours(cell, by).groupBy(*by, "is_weekend").agg(F.avg("avg").alias("avg"))


def ecdf(df: DataFrame, column: str, levels: list[int] = LEVELS, missing_as_below: bool = True) -> DataFrame:
    """subject_id, level, share: the share of values at or below each level, averaged over (hour, minute) cells. Missing values count as below unless told otherwise."""
    return ecdf_both(df, column, levels).select("subject_id", "level", F.col("share_missing_below" if missing_as_below else "share").alias("share"))


def ecdf_both(df: DataFrame, column: str, levels: list[int] = LEVELS) -> DataFrame:
    """subject_id, level, share, share_missing_below: each value counts once, at the first level that holds it; running sums over the levels of a cell make the shares."""
    bounds = F.array(*(F.lit(float(x)) for x in levels))
    place = F.when(F.col(column).isNull(), -1).when(F.isnan(column), len(levels)).otherwise(F.size(F.filter(bounds, lambda b: b < F.col(column))))  # how many levels are below it
    counts = df.groupBy("subject_id", hour().alias("h"), minute().alias("m"), place.alias("place")).agg(F.count("*").alias("n"))
    cell = counts.groupBy("subject_id", "h", "m").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("at"))  # len(levels) + 2 entries at most
    upto = F.transform(F.sequence(F.lit(0), F.lit(len(levels) - 1)), lambda i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0).cast("long"), lambda s, j: s + F.coalesce(F.try_element_at("at", j), F.lit(0).cast("long"))))
    none = F.coalesce(F.try_element_at("at", F.lit(-1)), F.lit(0).cast("long"))
    each = cell.select("subject_id", "n", none.alias("none"), F.posexplode(upto).alias("i", "below"))
    means = each.groupBy("subject_id", "i").agg(F.avg(F.col("below") / F.col("n")).alias("share"), F.avg((F.col("below") + F.col("none")) / F.col("n")).alias("share_missing_below"))
    return means.select("subject_id", F.element_at(F.array(*map(F.lit, levels)), F.col("i") + 1).alias("level"), "share", "share_missing_below")


def _days(df: DataFrame) -> DataFrame:
    ends = df.groupBy("subject_id").agg(div(F.min("us"), DAY).alias("a"), div(F.max("us"), DAY).alias("b"))
    return ends.select("subject_id", F.explode(F.sequence("a", "b")).alias("d"))


def daily_mean(df: DataFrame, columns: dict[str, str], dt: float, least_minutes: float) -> DataFrame:
    """subject_id, date and the mean of each column (new names), null unless its valid time exceeds least_minutes; empty days in between are there."""
    made = df.groupBy("subject_id", div("us", DAY).alias("d")).agg(*(F.when(F.count(c) * dt / 60 > least_minutes, F.avg(c)).alias(n) for c, n in columns.items()))
    return _days(df).join(made, ["subject_id", "d"], "left").select("subject_id", day_text(F.col("d") * DAY).alias("date"), *columns.values())


def daily_hours(df: DataFrame, columns: dict[str, str], dt: float, least_minutes: float) -> DataFrame:
    """subject_id, date and the hours of each class column (new names), with the same guard."""
    made = df.groupBy("subject_id", div("us", DAY).alias("d")).agg(*(F.when(F.count(c) * dt / 60 > least_minutes, F.sum(c) * dt / 3600).alias(n) for c, n in columns.items()))
    return _days(df).join(made, ["subject_id", "d"], "left").select("subject_id", day_text(F.col("d") * DAY).alias("date"), *columns.values())


def day_panels(df: DataFrame, columns: list[str]) -> DataFrame:
    """subject_id, date, weekday, us and columns as arrays in time's order: what a figure of one row a day draws. A row is one subject's day."""
    row = F.array_sort(F.collect_list(F.struct("us", *columns)))
    days = df.groupBy("subject_id", div("us", DAY).alias("d")).agg(row.alias("r"))
    return days.select("subject_id", day_text(F.col("d") * DAY).alias("date"), F.pmod(F.col("d") + 3, F.lit(7)).cast("int").alias("weekday"), F.col("r.us").alias("us"), *(F.col(f"r.{c}").alias(c) for c in columns))


def document(metrics: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """subject_id, summary (JSON) of tall metrics (subject_id, metric, value), with the columns of info (a row a subject) before them; where both have a key, info's counts."""
    entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    if info is None:
        return metrics.groupBy("subject_id").agg(F.to_json(entry).alias("summary"))
    keys = [c for c in info.columns if c != "subject_id"]
    body = metrics.where(~F.col("metric").isin(keys)).groupBy("subject_id").agg(F.to_json(entry).alias("body"))
    both = info.join(body, "subject_id", "left").withColumn("head", F.to_json(F.struct(*(f"`{k}`" for k in keys)), {"ignoreNullFields": "false"}))
    return both.select("subject_id", F.when(F.col("body").isNull() | (F.col("body") == "{}"), F.col("head")).otherwise(F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(","), F.expr("substring(body, 2)"))).alias("summary"))
