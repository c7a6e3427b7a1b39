"""Readers: recordings, annotated recordings, dictionaries, feature tables, summaries, window tensors. All are lazy and read through Spark, so globs of many subjects are one job."""

from __future__ import annotations

import lzma
import zipfile
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions.scalar import java_pattern, missing, usable, zoned_local
from kinelake.operators.quality import dedupe_first
from kinelake.sources import devices

#: Suffixes of compressed files that are looked through.
COMPRESSED = (".gz", ".bz2", ".xz", ".lzma", ".zip")


def stem(path: F.Column) -> F.Column:
    """File name without folders and everything from its first dot on. No pattern: those that look for the end of a path try it from each of its letters, in every row."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def kind_of(path: str) -> str:
    """csv, parquet, cwa, bin or gt3x by the extension below compression; others are an error."""
    name = path.rstrip("/").lower()
    for end in COMPRESSED:
        name = name.removesuffix(end)
    for kind in ("csv", "parquet", *devices.FORMATS):
        if name.endswith(f".{kind}"):
            return kind
    if name.endswith((".pkl", ".pickle")):
        raise ValueError("pickles are not read: convert to Parquet")
    raise ValueError(f"unknown file format: {path}")


def column_indices(text: str, header: list[str]) -> list[str]:
    """Names of the four columns that a list of 0-based indices names."""
    try:
        places = [int(x) for x in text.split(",")]
    except ValueError as e:
        raise ValueError(f"indices must be whole numbers: {text!r}") from e
    if len(places) != 4:
        raise ValueError(f"four indices are needed, got {len(places)}")
    if min(places) < 0:
        raise ValueError("indices must not be negative")
    if max(places) >= len(header):
        raise ValueError(f"index {max(places)} is beyond the last column")
    return [header[i] for i in places]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, n (from 0), value: lines of text files; xz, lzma and zip are opened by a mapInArrow."""
    if path.lower().endswith((".xz", ".lzma", ".zip")):

        def run(batches):
            for part in batches:
                for name, raw in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True):
                    if name.lower().endswith(".zip"):
                        with zipfile.ZipFile(BytesIO(raw)) as z:
                            raw = z.read(z.namelist()[0])
                    else:
                        raw = lzma.decompress(raw)
                    rows = raw.decode().splitlines()
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(rows)], ["path", "n", "value"])

        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, n long, value string")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), "value")
    # a file's block lies together in one task, so ids run through it; a row a block says where it starts in the file
    blocks = lines.groupBy("path", "b").agg(F.min("m").alias("first_"), F.count("*").alias("count_"))
    before = F.coalesce(F.sum("count_").over(Window.partitionBy("path").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(blocks.select("path", "b", "first_", before.alias("before_")), ["path", "b"]).select("path", (F.col("before_") + F.col("m") - F.col("first_")).alias("n"), "value")


def read_csv(spark: SparkSession, path: str, columns: str = "time,x,y,z", indices: str | None = None, start_row: int = 1, date_format: str = "%Y-%m-%d %H:%M:%S.%f", extra: tuple[str, ...] = ()) -> DataFrame:
    """subject_id (file stem), us, x, y, z (float) and extra string columns. Columns by name or by 0-based index; start_row is the header's line, from 1. NaN and unparsable numbers are null; of rows with one time the first stays.
    The files of a glob must name the columns that are read at the same places: another header is an error, when the rows are read or, with start rows, at once."""
    kind_of(path)
    plain = start_row == 1 and not path.lower().endswith((".xz", ".lzma", ".zip"))
    if plain:
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(path).withColumns({"path": F.col("_metadata.file_path"), "n": F.monotonically_increasing_id()})
        header = [c for c in raw.columns if c not in ("path", "n")]
    else:
        lines = _lines(spark, path)
        heads = lines.where(F.col("n") == start_row - 1).select("value").distinct().limit(2).collect()
        if len(heads) > 1:
            raise ValueError(f"files of different headers: {heads[0][0]!r}, {heads[1][0]!r}")
        header = [c.strip() for c in (heads[0][0] if heads else "").split(",")]
        body = lines.where(F.col("n") >= start_row)
        raw = body.select("path", "n", F.from_csv("value", ", ".join(f"`{c}` string" for c in header)).alias("r")).select("path", "n", "r.*")
    names = column_indices(indices, header) if indices else columns.split(",")
    if lost := [c for c in (*names, *extra) if c not in header]:
        raise ValueError(f"no such column: {', '.join(lost)}")
    time, *axes = names
    us = F.unix_micros(F.try_to_timestamp(F.col(f"`{time}`"), F.lit(java_pattern(date_format))))
    rows = raw.select(stem(F.col("path")).alias("subject_id"), "n", us.alias("us"), *(missing(F.col(f"`{c}`").try_cast("float")).alias(n) for c, n in zip(axes, "xyz", strict=True)), *(F.col(f"`{c}`") for c in extra))
    first = Window.partitionBy("subject_id", "us").orderBy("n")
    return rows.where("us is not null").withColumn("nth_", F.row_number().over(first)).where("nth_ = 1").drop("nth_", "n")


def read_parquet(spark: SparkSession, path: str, repeats: bool = False, axes: str = "float") -> DataFrame:
    """subject_id (that column, or the file stem), us, x, y, z of Parquet files with time, x, y, z; NaN is null. Of rows with one time the first stays, as they lie in the file, or with repeats all do. axes: the type of x, y and z."""
    raw = spark.read.parquet(path)
    subject = F.col("subject_id") if "subject_id" in raw.columns else stem(F.col("_metadata.file_path"))
    own = [subject.alias("subject_id"), F.unix_micros(F.col("time").cast("timestamp")).alias("us"), *(missing(F.col(c).cast(axes)).alias(c) for c in "xyz")]
    if repeats:
        return raw.select(*own).where("us is not null")
    rows = raw.select(*own, F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("place_"))
    return dedupe_first(rows.where("us is not null"), "place_").drop("place_")


def read_recording(spark: SparkSession, path: str, **options) -> DataFrame:
    """subject_id, us, x, y, z of a recording, by its extension: CSV with read_csv's options, Parquet with read_parquet's, or a device file. Of rows with one time the first stays, unless an option says otherwise."""
    kind = kind_of(path)
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "parquet":
        return read_parquet(spark, path, **options)
    return dedupe_first(devices.read_device(spark, path, kind), "block").select("subject_id", "us", "x", "y", "z")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """subject_id, mb: what each subject's files take (1024 * 1024 bytes, one decimal); file contents are not read."""
    listed = spark.read.format("binaryFile").load(path).select(stem(F.col("path")).alias("subject_id"), "length")
    return listed.groupBy("subject_id").agg(F.round(F.sum("length") / (1 << 20), 1).alias("mb"))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """subject_id, us, x, y, z, annotation of annotated CSV or Parquet files; Parquet rows with any null go."""
    if kind_of(path) == "csv":
        return read_csv(spark, path, extra=("annotation",))
    raw = spark.read.parquet(path).withColumn("subject_id", stem(F.col("_metadata.file_path"))).dropna("any")
    return raw.select("subject_id", F.unix_micros(F.col("time").cast("timestamp")).alias("us"), *(F.col(c).cast("float").alias(c) for c in "xyz"), "annotation")


def read_dictionary(spark: SparkSession, path: str, scheme: str) -> DataFrame:
    """annotation, label of an annotation dictionary's scheme; blank labels and the text nan are null."""
    return spark.read.option("header", True).csv(path).select("annotation", usable(F.col(f"`label:{scheme}`")).alias("label"))


def read_features(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """subject_id, us and the named feature columns only."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(stem(F.col("_metadata.file_path")).alias("subject_id"), F.unix_micros(F.try_to_timestamp("time")).alias("us"), *(F.col(f"`{c}`").cast("double").alias(c) for c in columns))


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """All summaries below a folder as one table, *-outputSummary.json files and what writers.write_summaries wrote; keys that one lacks are null."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{*-outputSummary.json,part-*.txt}").option("multiLine", True).json(folder)


def read_series(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """subject_id, us, acc and class columns of what writers.write_series wrote, or of CSV files of that form. Times may be zoned ('2014-05-07 13:29:50.439+0100 [Europe/London]'): their local clock counts."""
    raw = spark.read.option("header", True).csv(path)
    subject = F.col("subject_id").cast("string") if "subject_id" in raw.columns else stem(F.col("_metadata.file_path"))
    local = F.coalesce(zoned_local(F.col("time")), F.col("time").try_cast("timestamp_ntz"))
    return raw.select(subject.alias("subject_id"), F.unix_micros(local.cast("timestamp")).alias("us"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in ("acc", *classes)))


def read_metadata(spark: SparkSession, path: str, subject: str = "pid") -> DataFrame:
    """subject_id and the other columns (text) of a table of subjects."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col(subject).alias("subject_id"), *(F.col(f"`{c}`") for c in raw.columns if c != subject))


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Window tensors: subject_id, idx, x, y, z arrays and whatever else was written."""
    return spark.read.parquet(path)
