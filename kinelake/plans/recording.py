"""From recordings to summaries: exclusions, wear, labels, imputation, calendar and rhythm metrics, for all subjects in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake import session
from kinelake.functions.scalar import seconds
from kinelake.operators import circadian, epochs, impute, quality, score, sequence, signal, summary

NAMES = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def exclude(samples: DataFrame, dt: float | str, first_last: str | None = None, wear_below: str | float | None = None) -> DataFrame:
    """Samples without edge days and with low-wear days blanked, as asked."""
    if first_last:
        samples = quality.drop_edge_days(samples, first_last)
    if wear_below is not None:
        samples = quality.blank_low_wear_days(samples, ["x", "y", "z"], dt, seconds(wear_below))
    return samples


def one_hot(labelled: DataFrame, classes: list[str]) -> DataFrame:
    return labelled.withColumns({c: F.when(F.col("label").isNotNull(), (F.col("label") == c).cast("double")) for c in classes})


def metrics(series: DataFrame, filled: DataFrame, classes: list[str], epoch_s: float) -> DataFrame:
    """subject_id, metric, value: every number of the summary document. series: raw epochs with acc and class columns; filled: the same imputed over whole days."""
    ends = series.groupBy("subject_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    tall = lambda df, name, value: df.select("subject_id", name.alias("metric"), F.col(value).cast("double").alias("value"))
    parts = [tall(summary.ecdf(filled, "acc"), F.format_string("acc-ecdf-%dmg", "level"), "share")]
    recorded = summary.recorded_hours(series, classes, epoch_s)
    parts.append(tall(recorded, F.format_string("day%d-recorded-%s(hrs)", F.col("day").cast("int"), "label"), "hours"))
    parts.append(tall(recorded.groupBy("subject_id").agg(F.min("first_weekday").alias("v")), F.lit("FirstDay(0=mon,6=sun)"), "v"))
    # all columns in one pass over the epochs; everything below it works on the small cell table
    names, by = ["acc", *classes], ("subject_id", "c")
    long = filled.select("subject_id", "us", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("c", "v"))
    over, cell = summary.overall(long, "v", ends, by), summary.cells(long, "v", by)
    key = lambda *rest: F.concat(F.col("c"), *(F.lit(x) if isinstance(x, str) else x for x in rest))
    which = F.when(F.col("is_weekend") == 1, "end").otherwise("day")
    parts += [tall(over, key("-overall-avg"), "avg"), tall(over, key("-overall-sd"), "sd"), tall(summary.week_average(cell, by), key("-week-avg"), "avg")]
    parts.append(tall(summary.day_of_week_average(cell, by), key("-", F.element_at(F.array(*map(F.lit, NAMES)), F.col("weekday") + 1), "-avg"), "avg"))
    parts.append(tall(summary.hour_of_day_average(cell, by), key("-hourOfDay-", F.col("hour").cast("string"), "-avg"), "avg"))
    parts.append(tall(summary.weekend_average(cell, by), key("-week", which, "-avg"), "avg"))
    parts.append(tall(summary.weekend_hours(cell, by), key("-hourOfWeek", which, "-", F.col("hour").cast("string"), "-avg"), "avg"))
    for name, value in (("acc", F.col("acc")), *((("sleep", circadian.sleep_signal(classes)),) if "sleep" in classes else ())):
        parts.append(tall(circadian.psd(filled, value, epoch_s), F.lit(f"PSD_{name}"), "psd"))
        parts.append(tall(circadian.dominant_frequency(filled.withColumn("signal_", value), "signal_", epoch_s), F.lit(f"fourier-frequency_{name}"), "frequency"))
    parts.append(tall(circadian.m10_l5(filled, "acc", epoch_s), F.lit("M10L5"), "relative_amplitude"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def daily(series: DataFrame, filled: DataFrame, classes: list[str], epoch_s: float, least_minutes: float = 0.0) -> DataFrame:
    """subject_id, date, wear hours, mean intensity and hours of each class, crude and adjusted, in one aggregation."""
    both = filled.select("subject_id", "us", *(F.col(c).alias(f"adj_{c}") for c in ["acc", *classes])).join(series.select("subject_id", "us", "acc", *classes), ["subject_id", "us"], "left")
    means = summary.daily_mean(both, {"acc": "ENMO(mg)", "adj_acc": "ENMO Adjusted(mg)"}, epoch_s, least_minutes)
    title = lambda c: c[:1].upper() + c[1:].lower()
    hours = summary.daily_hours(both, {**{c: f"{title(c)}(hours)" for c in classes}, **{f"adj_{c}": f"{title(c)} Adjusted(hours)" for c in classes}}, epoch_s, least_minutes)
    wear = quality.daily_wear(series, ["acc"], epoch_s).withColumnRenamed("wear_hours", "WearTime(hours)")
    return wear.join(means, ["subject_id", "date"], "full").join(hours, ["subject_id", "date"], "full")


def prepare(samples: DataFrame, rate: int | None = None, calibrate: bool = True, still_sd_least: float = 0.0, nonwear: bool = True, tolerance_s: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Stored samples (subject_id, us, x, y, z, rate, dt_) and a row for each subject of how they were made (rate, calibration).

    Samples are calibrated, null inside non-wear bouts, and stand on a uniform grid at each subject's own rate unless one is given; where none is within tolerance_s of a grid point, its values are missing.
    One pass over the samples makes the 10-second windows that calibration and non-wear share, one the rates, one the result.
    """
    axes = ["x", "y", "z"]
    stats = session.kept(quality.window_stats(samples, axes), "windows")
    found = session.kept(quality.calibration(stats, least=still_sd_least), "calibration") if calibrate else None
    if found is not None:
        samples = quality.calibrated(samples, found)
        stats = stats.join(found.select("subject_id", "gx", "gy", "gz"), "subject_id", "left").withColumns({f"s{c}": F.col(f"s{c}") * F.abs(F.coalesce(f"g{c}", F.lit(1.0))) for c in axes})
    if nonwear:
        samples = quality.blank_bouts(samples, quality.still_bouts(stats, axes), axes)
    if rate is None:
        rates = session.kept(samples.select("subject_id").distinct().join(quality.sample_rate(samples), "subject_id", "left").select("subject_id", F.greatest(F.coalesce("rate", F.lit(1)), F.lit(1)).alias("rate")), "rates")
        samples = samples.join(rates, "subject_id")
    else:
        samples = samples.withColumn("rate", F.lit(rate))
    made = session.kept(signal.uniform(samples, axes, "rate", int(tolerance_s * 1e6)).withColumn("dt_", 1.0 / F.col("rate")), "samples")
    how = made.groupBy("subject_id").agg(F.max("rate").alias("rate"))
    if found is None:
        return made, how.withColumns({"still": F.lit(0).cast("long"), "error_before": F.lit(None).cast("double"), "error_after": F.lit(None).cast("double"), "ok": F.lit(0)})
    return made, how.join(found.select("subject_id", "still", "error_before", "error_after", "ok"), "subject_id", "left")


def process(samples: DataFrame, scorer: Callable[[DataFrame], DataFrame], classes: list[str], rate: int | None = None, epoch_s: float = 30.0, smoother: sequence.HiddenMarkov | None = None, first_last: str | None = None, wear_below: str | float | None = None, least_sleep: str | float | None = None, single_block: bool = False, calibrate: bool = True, still_sd_least: float = 0.0, nonwear: bool = True, device: str = "csv", tolerance_s: float = 1.0, sizes: DataFrame | None = None, options: dict | None = None) -> dict[str, DataFrame]:
    """series, summary (JSON document for each subject) and daily of recordings (subject_id, us, x, y, z; of rows with one time any one counts). Subjects without any worn sample have a document with zero wear and PredictOK 0.
    sizes: subject_id, mb of the files; options: what the document says of how it was made."""
    raw, how = prepare(samples, rate, calibrate, still_sd_least, nonwear, tolerance_s)
    kept = exclude(raw, "dt_", first_last, wear_below)
    wear = quality.wear_stats(kept, ["x", "y", "z"], "dt_")
    labelled = score.predict_recording(kept, scorer, epoch_s, None, smoother=smoother, least_sleep_s=seconds(least_sleep) if least_sleep else None, single_block=single_block, labels=classes)
    series = session.kept(one_hot(labelled, classes), "series")  # read by every metric
    grid, names = epochs.day_grid(series, epoch_s), ["acc", *classes]
    placed = epochs.nearest(grid, series.withColumn("row_", F.struct(*names)), "row_", min(epoch_s, 60)).select("subject_id", "us", "row_.*")
    filled = session.kept(impute.hierarchical(placed, names), "filled")
    minutes = seconds(wear_below) / 60 if wear_below is not None else 0.0
    tall = metrics(series, filled, classes, epoch_s)
    stats = wear.select("subject_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, ["WearTime(days)", "NonwearTime(days)", "Covers24hOK", "PredictOK"])), F.array("wear_days", "nonwear_days", F.col("covers_24h").cast("double"), F.col("wear_start_us").isNotNull().cast("double")))).alias("metric", "value"))
    clock = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")
    size = F.lit(None).cast("double")
    if sizes is not None:
        how, size = how.join(sizes.select("subject_id", "mb"), "subject_id", "left"), F.col("mb")
    said = [F.lit(str(v)).alias(k) for k, v in (options or {}).items()]
    info = how.join(wear, "subject_id", "left").select(
        "subject_id", *([F.struct(*said).alias("Args")] if said else []), F.col("subject_id").alias("Filename"), F.lit(device).alias("Device"), size.alias("Filesize(MB)"), F.col("rate").alias("SampleRate"), F.lit(1).alias("ReadOK"), F.col("rate").alias("ResampleRate"),
        F.coalesce("ok", F.lit(0)).alias("CalibOK"), F.coalesce("still", F.lit(0)).alias("CalibNumSamples"), (F.col("error_before") * 1000).alias("CalibErrorBefore(mg)"), (F.col("error_after") * 1000).alias("CalibErrorAfter(mg)"),
        clock("start_us").alias("StartTime"), clock("end_us").alias("EndTime"), clock("wear_start_us").alias("WearStartTime"), clock("wear_end_us").alias("WearEndTime"),
    )
    return {"series": series.select("subject_id", "us", "acc", "label"), "summary": summary.document(tall.where("value is not null").unionByName(stats), info), "daily": daily(series, filled, classes, epoch_s, minutes)}
