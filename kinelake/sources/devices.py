"""Device recordings as Spark data sources: AX3/AX6 block files (.cwa), GENEActiv pages (.bin), ActiGraph archives (.gt3x), each also gzipped.

`cwa` and `geneactiv` files are cut into splits: blocks have a fixed size, pages start with a marker line, as lines do in text. A split reads one block or page beyond its border, for
the clock of its last samples only. Gzipped files and zip archives can't be read from the middle and are one split a file. Samples are decoded by NumPy, a batch of blocks at once.

Rows: subject_id (file name up to its first dot), path, block (number in the file), us (since 1970), x, y, z in g. Files are opened through pyarrow.fs, so any store it knows will do; reading needs every executor
to reach them. A block that fails its checksum, or is cut short, has no rows; an empty file has none; a file of another kind is an error.
"""

from __future__ import annotations

import gzip
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from fnmatch import fnmatch
from io import BytesIO
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "subject_id string, path string, block long, us long, x float, y float, z float"
#: Bytes of a split.
SPLIT = 32 << 20
#: Blocks or pages that are decoded at once.
BATCH = 2048
#: Fixed values of the block format: sizes, marks and the layout of a data block.
HEADER, BLOCK, HEADER_MARK, BLOCK_MARK = 1024, 512, b"MD", b"AX"
LAYOUT = np.dtype([("mark", "S2"), ("length", "<u2"), ("fraction", "<u2"), ("session", "<u4"), ("sequence", "<u4"), ("clock", "<u4"), ("light", "<u2"), ("temperature", "<u2"), ("events", "u1"), ("battery", "u1"), ("rate", "u1"), ("form", "u1"), ("offset", "<i2"), ("count", "<u2"), ("data", "u1", 480), ("checksum", "<u2")])
#: Fixed values of the page format: the marker of a page, samples of a page, hexadecimal digits of a sample.
PAGE_MARK, PAGE_SAMPLES, PAGE_DIGITS = b"Recorded Data", 300, 12
#: Fixed values of the archive's records: separator, and the types with 12-bit and 16-bit samples.
SEPARATOR, PACKED, WIDE = 0x1E, 0, 26
#: Blocks whose clocks differ by less than this share from their samples' nominal time follow each other without a gap.
DRIFT = 0.1


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]


def files(path: str) -> list[tuple[str, int]]:
    """URIs and sizes of a file, of those that a pattern in the last part of a path names, or of a folder's."""
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    store, inner = fs.FileSystem.from_uri(path) if prefix and not re.search(r"[*?\[]", path) else _store(path)
    info = None if re.search(r"[*?\[]", inner) else store.get_file_info(inner)
    if info is not None and info.type == fs.FileType.File:
        found = [info]
    else:
        folder, pattern = (inner, "*") if info is not None else inner.rsplit("/", 1)
        found = [f for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch(f.base_name, pattern)]
    root = prefix + path[len(prefix) :].split("/", 1)[0] if prefix and not prefix.startswith("file") and not inner.startswith(path[len(prefix) :].split("/", 1)[0]) else ("file://" if prefix.startswith("file") else prefix)
    return sorted((root + f.path, f.size) for f in found)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        return fs.LocalFileSystem(), path
    folder, name = path.rsplit("/", 1)
    store, inner = fs.FileSystem.from_uri(folder)
    return store, f"{inner}/{name}"


def opened(path: str) -> pa.NativeFile:
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def rows(path: str, block: np.ndarray, us: np.ndarray, xyz: np.ndarray) -> pa.RecordBatch:
    n = len(us)
    same = lambda text: pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([text])).cast(pa.string())
    return pa.RecordBatch.from_arrays([same(stem(path)), same(path), pa.array(block), pa.array(us), *(pa.array(np.ascontiguousarray(xyz[:, k], np.float32)) for k in range(3))], ["subject_id", "path", "block", "us", "x", "y", "z"])


# Blocks


def clocks(blocks: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Microseconds of each block's first sample, from its packed clock, its fraction of a second and the sample that the clock belongs to."""
    c = blocks["clock"].astype(np.int64)
    year, month = 2000 + (c >> 26 & 0x3F), c >> 22 & 0xF
    days = (np.datetime64("1970-01", "M") + ((year - 1970) * 12 + month - 1)).astype("datetime64[D]").astype(np.int64) + (c >> 17 & 0x1F) - 1
    whole = ((days * 24 + (c >> 12 & 0x1F)) * 60 + (c >> 6 & 0x3F)) * 60 + (c & 0x3F)
    fraction = np.where(blocks["fraction"] & 0x8000, blocks["fraction"].astype(np.int64) & 0x7FFF, 0) / 32768
    shift = blocks["offset"] + np.floor(fraction * rate)  # the offset was shifted back by the samples that the fraction stands for
    return np.rint((whole + fraction - shift / rate) * 1e6).astype(np.int64)


def values(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, samples, 3) in g, and samples of each block. Forms: three 10-bit numbers with a common exponent, or 16-bit numbers of three or six axes (the last three are acceleration)."""
    n = len(blocks)
    out, count = np.zeros((n, 120, 3), np.float32), np.zeros(n, np.int64)
    packed, axes = (blocks["form"] & 0xF) == 0, blocks["form"] >> 4
    if packed.any():
        v = np.ascontiguousarray(blocks["data"][packed]).view("<u4")
        parts = np.stack([(v << np.uint32(22 - 10 * k)).view(np.int32) >> 22 for k in range(3)], 2) << (v >> 30)[..., None].astype(np.int32)
        out[packed], count[packed] = parts / 256, np.minimum(blocks["count"][packed], 120)
    for wide in (3, 6):
        some = ~packed & (axes == wide)
        if some.any():
            most = 240 // wide
            v = np.ascontiguousarray(blocks["data"][some]).view("<i2").reshape(-1, most, wide)[..., -3:]
            out[some, :most] = v / (1 << (8 + (blocks["light"][some] >> 13).astype(np.int64)))[:, None, None]
            count[some] = np.minimum(blocks["count"][some], most)
    return out, count


def sound(blocks: np.ndarray) -> np.ndarray:
    """Which blocks have the mark, and words that add up to nothing (a checksum of nothing is not checked)."""
    words = np.ascontiguousarray(blocks).view("<u2").reshape(len(blocks), -1)
    return (blocks["mark"] == BLOCK_MARK) & ((blocks["checksum"] == 0) | (words.sum(1, dtype=np.uint32) & 0xFFFF == 0)) & (blocks["rate"] != 0)


def spread(path: str, blocks: np.ndarray, number: np.ndarray, keep: int) -> pa.RecordBatch:
    """Samples of the first `keep` blocks. A block's samples fill the time to the next block's clock where that is about their nominal time, else follow at the nominal rate."""
    rate = 3200.0 / (1 << (15 - (blocks["rate"] & 0xF).astype(np.int64)))
    xyz, count = values(blocks)
    first = clocks(blocks, rate)
    nominal = count * 1e6 / rate
    to_next = np.r_[np.diff(first), -1].astype(np.float64)
    length = np.where(np.abs(to_next - nominal) <= DRIFT * nominal, to_next, nominal)
    at = np.arange(120)
    us = np.rint(first[:, None] + at * (length / np.maximum(count, 1))[:, None]).astype(np.int64)
    held = (at < count[:, None]) & (np.arange(len(blocks)) < keep)[:, None]
    return rows(path, np.repeat(number, held.sum(1)), us[held], xyz[held])


def read_blocks(path: str, start: int, end: int, pull) -> Iterator[pa.RecordBatch]:
    """Blocks start to end (numbers); pull(n) gives the next n of them as bytes, or fewer at the file's end."""
    at, held, numbers = start, np.zeros(0, LAYOUT), np.zeros(0, np.int64)
    while at <= end:  # one block more, for its clock
        raw = pull(min(BATCH, end + 1 - at))
        got = np.frombuffer(raw[: len(raw) // BLOCK * BLOCK], LAYOUT)
        number = at + np.arange(len(got))
        good = sound(got) if len(got) else np.zeros(0, bool)
        held, numbers = np.r_[held, got[good]], np.r_[numbers, number[good]]
        at += len(got)
        done = not len(got) or at > end
        keep = int((numbers < end).sum()) if done else len(held) - 1
        if keep > 0:
            yield spread(path, held, numbers, keep)
            held, numbers = held[keep:], numbers[keep:]
        if done:
            return


# Pages


def read_pages(path: str, raw: bytes, offset: int, start: int, end: int, head: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """Pages whose marker starts in [start, end) of the file; raw holds its bytes from offset on, one page beyond the end included."""
    marks = [m.start() + offset for m in re.finditer(re.escape(PAGE_MARK), raw)]
    pages = []
    for at, after in zip(marks, [*marks[1:], offset + len(raw)], strict=True):
        lines = raw[at - offset : after - offset].decode("latin-1").splitlines()
        fields = dict(x.split(":", 1) for x in lines[1:-1] if ":" in x)
        data = lines[-1].strip() if lines else ""
        if at < start or "Page Time" not in fields or len(data) < PAGE_DIGITS:
            continue
        pages.append((at, int(fields["Sequence Number"]), datetime.strptime(fields["Page Time"].strip(), "%Y-%m-%d %H:%M:%S:%f").replace(tzinfo=timezone.utc), float(fields["Measurement Frequency"]), data))
        if at >= end:
            break
    for lo in range(0, len(pages), BATCH // 8):
        part = pages[lo : lo + BATCH // 8 + 1]
        own = [p for p in part[: BATCH // 8] if p[0] < end]
        if not own:
            continue
        us, block, xyz = [], [], []
        for k, (_, number, time, rate, data) in enumerate(own):
            digits = np.frombuffer(bytes.fromhex(data[: len(data) // PAGE_DIGITS * PAGE_DIGITS]), np.uint8).reshape(-1, 6).astype(np.int32)
            n, first = len(digits), round(time.timestamp() * 1e6)
            nominal = n * 1e6 / rate
            to_next = round(part[k + 1][2].timestamp() * 1e6) - first if k + 1 < len(part) else -1
            us.append(np.rint(first + np.arange(n) * (to_next if abs(to_next - nominal) <= DRIFT * nominal else nominal) / n).astype(np.int64))
            block.append(np.full(n, number, np.int64))
            v = np.stack([digits[:, 0] << 4 | digits[:, 1] >> 4, (digits[:, 1] & 0xF) << 8 | digits[:, 2], digits[:, 3] << 4 | digits[:, 4] >> 4], 1)
            xyz.append(np.stack([((v[:, k] ^ 0x800) - 0x800) * 100.0 - head[f"{c} offset"] for k, c in enumerate("xyz")], 1) / [head[f"{c} gain"] for c in "xyz"])
        yield rows(path, np.concatenate(block), np.concatenate(us), np.concatenate(xyz))


def page_head(raw: bytes) -> dict[str, float]:
    """Gain and offset of each axis from a file's first lines."""
    return {k.decode().strip(): float(v) for k, v in re.findall(rb"([xyz] (?:gain|offset)):\s*(-?\d+)", raw)}


# Archives


def read_archive(path: str, raw: bytes) -> Iterator[pa.RecordBatch]:
    """Seconds of an archive's log: each record has one second's samples at its own time; those without samples repeat none."""
    with zipfile.ZipFile(BytesIO(raw)) as z:
        info = dict(x.split(":", 1) for x in z.read("info.txt").decode("utf-8-sig").splitlines() if ":" in x)
        log = np.frombuffer(z.read("log.bin"), np.uint8)
    scale = float(info.get("Acceleration Scale", "256").strip() or 256)
    at, number, us, block, xyz = 0, 0, [], [], []
    while at + 9 <= len(log) and log[at] == SEPARATOR:
        kind, second, size = int(log[at + 1]), int(log[at + 2 : at + 6].view("<u4")[0]), int(log[at + 6 : at + 8].view("<u2")[0])
        body = log[at + 8 : at + 8 + size]
        n = size // 6 if kind == WIDE else size * 8 // 36
        if kind in (PACKED, WIDE) and n and len(body) == size:
            if kind == WIDE:
                v = body[: n * 6].view("<i2").reshape(n, 3)
            else:  # two 12-bit numbers in three bytes, in the order y, x, z
                whole = np.r_[body, np.zeros(-len(body) % 3, np.uint8)].reshape(-1, 3).astype(np.int32)
                flat = np.stack([whole[:, 0] << 4 | whole[:, 1] >> 4, (whole[:, 1] & 0xF) << 8 | whole[:, 2]], 1).ravel()[: n * 3]
                v = ((flat ^ 0x800) - 0x800).reshape(n, 3)[:, [1, 0, 2]]
            us.append(second * 1_000_000 + np.rint(np.arange(n) * 1e6 / n).astype(np.int64))
            block.append(np.full(n, number, np.int64))
            xyz.append(v / scale)
        at, number = at + 9 + size, number + 1
        if len(us) >= BATCH:
            yield rows(path, np.concatenate(block), np.concatenate(us), np.concatenate(xyz))
            us, block, xyz = [], [], []
    if us:
        yield rows(path, np.concatenate(block), np.concatenate(us), np.concatenate(xyz))


class DeviceReader(DataSourceReader):
    def __init__(self, options: dict[str, str], kind: str):
        self.path, self.kind, self.split = options["path"], kind, int(options.get("split", SPLIT))

    def partitions(self) -> list[Split]:
        """Splits of all files; borders of block files lie between blocks."""
        out = []
        for path, size in files(self.path):
            whole = path.lower().endswith(".gz") or self.kind == "gt3x"
            step = size if whole else max(BLOCK, self.split // BLOCK * BLOCK)
            out += [Split(path, at, min(at + step, size)) for at in range(0, size, max(1, step))]
        return out or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        with opened(split.path) as f:
            plain = gzip.GzipFile(fileobj=f) if split.path.lower().endswith(".gz") else None
            source, end = plain or f, split.end
            if plain and self.kind != "cwa":
                source = BytesIO(plain.read())
                end = len(source.getbuffer())
            if self.kind == "gt3x":
                yield from read_archive(split.path, source.read())
            elif self.kind == "geneactiv":
                head = page_head(source.read(1 << 14))
                if len(head) < 6:
                    raise ValueError(f"not a page file: {split.path}")
                source.seek(split.start)
                beyond = 4 * PAGE_SAMPLES * PAGE_DIGITS  # more than a page
                yield from read_pages(split.path, source.read(end - split.start + beyond), split.start, split.start, end, head)
            else:
                if source.read(2) != HEADER_MARK:
                    raise ValueError(f"not a block file: {split.path}")
                last = (1 << 40) if plain else max(0, -(-(end - HEADER) // BLOCK))
                first = max(0, (split.start - HEADER) // BLOCK)
                source.seek(HEADER + first * BLOCK)
                yield from read_blocks(split.path, first, last, lambda n: source.read(n * BLOCK))


def _source(label: str, kind: str) -> type[DataSource]:
    class Device(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return DeviceReader(self.options, kind)

    return Device


#: Format of each extension.
FORMATS = {"cwa": "cwa", "bin": "geneactiv", "gt3x": "gt3x"}


def read_device(spark: SparkSession, path: str, kind: str, split: int = SPLIT) -> DataFrame:
    """All samples of device files: subject_id, path, block, us, x, y, z. kind: cwa, bin or gt3x. split: bytes of a task."""
    label = f"kinelake_{FORMATS[kind]}"
    spark.dataSource.register(_source(label, FORMATS[kind]))
    return spark.read.format(label).option("split", str(split)).load(path)


# Writing block files: a sink of its own, and what tests and queries read back


#: What a written block file starts with.
HEAD = HEADER_MARK + (1020).to_bytes(2, "little") + bytes(HEADER - 4)


def most_of(wide: bool) -> int:
    """Samples of a full block: 16-bit numbers, or 10 bits and an exponent."""
    return 80 if wide else 120


def blocks_of(us: np.ndarray, xyz: np.ndarray, rate: float, wide: bool = False) -> bytes:
    """A block file of samples in g at a constant rate from us[0] on: header and blocks."""
    return HEAD + _blocks(us, xyz, rate, wide, 0)


def _blocks(us: np.ndarray, xyz: np.ndarray, rate: float, wide: bool, first: int) -> bytes:
    """Blocks of samples, numbered from first on."""
    if not len(us):
        return b""
    most = most_of(wide)
    n, code = -(-len(us) // most), 15 - int(np.log2(3200 / rate) + 0.5)
    out = np.zeros(n, LAYOUT)
    at = np.arange(n) * most
    start = us[at] / 1e6
    whole = np.floor(start).astype(np.int64)
    fraction = np.minimum(np.rint((start - whole) * 32768).astype(np.int64), 32767)
    day = (whole // 86400).astype("datetime64[D]")
    month, second = day.astype("datetime64[M]"), whole % 86400
    y, m = month.astype(np.int64) // 12 - 30, month.astype(np.int64) % 12 + 1
    d = (day - month).astype(np.int64) + 1
    out["mark"], out["length"], out["fraction"], out["sequence"], out["rate"] = BLOCK_MARK, 508, 0x8000 | fraction, first + np.arange(n), code
    out["clock"] = y << 26 | m << 22 | d << 17 | second // 3600 << 12 | second // 60 % 60 << 6 | second % 60
    out["offset"] = -np.floor(fraction / 32768 * 3200.0 / (1 << (15 - code)))
    out["count"], out["form"] = np.minimum(most, len(us) - at), 0x32 if wide else 0x30
    raw = np.zeros((n * most, 3), np.int64)
    raw[: len(us)] = np.rint(np.nan_to_num(xyz) * 256)
    if wide:
        out["data"] = np.clip(raw, -32768, 32767).astype("<i2").reshape(n, -1).view(np.uint8)
    else:
        exponent = np.minimum(3, (np.abs(raw).max(1) > 511).astype(np.int64) + (np.abs(raw).max(1) > 1022) + (np.abs(raw).max(1) > 2044))
        small = np.clip(raw >> exponent[:, None], -512, 511) & 0x3FF
        out["data"] = (small[:, 0] | small[:, 1] << 10 | small[:, 2] << 20 | exponent << 30).astype("<u4").reshape(n, -1).view(np.uint8)
    out["checksum"] = (-out.view("<u2").reshape(n, -1).sum(1, dtype=np.int64)) & 0xFFFF
    return out.tobytes()


def write_blocks(df: DataFrame, folder: str, rate: float, wide: bool = False) -> DataFrame:
    """Writes each subject's samples (us, x, y, z in g, at a constant rate) as <folder>/<subject_id>.cwa; a row for each file: subject_id, path, bytes. A file has one writer, which gets the samples in order and writes blocks as they come,
    so its memory doesn't grow with the subject."""

    def run(batches):
        def parts():
            for batch in batches:
                key, us = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("subject_id", "us"))
                xyz = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1)
                for lo, hi in pairwise([0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]):
                    if hi > lo:
                        yield key[lo], us[lo:hi], xyz[lo:hi]

        store, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(inner, recursive=True)
        for name, own in groupby(parts(), key=lambda part: part[0]):
            us, xyz, number, most = np.zeros(0, np.int64), np.zeros((0, 3)), 0, most_of(wide)
            with store.open_output_stream(f"{inner}/{name}.cwa") as f:
                f.write(HEAD)
                for _, more, values_ in own:
                    us, xyz = np.r_[us, more], np.r_[xyz, values_]
                    whole = len(us) // most * most
                    f.write(_blocks(us[:whole], xyz[:whole], rate, wide, number))
                    us, xyz, number = us[whole:], xyz[whole:], number + whole // most
                f.write(_blocks(us, xyz, rate, wide, number))  # what is left, or nothing
            size = HEADER + (number + (len(us) > 0)) * BLOCK
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([f"{folder}/{name}.cwa"]), pa.array([size], pa.int64())], ["subject_id", "path", "bytes"])

    rows = df.select(F.col("subject_id").cast("string").alias("subject_id"), F.col("us").cast("long").alias("us"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    return rows.repartition("subject_id").sortWithinPartitions("subject_id", "us").mapInArrow(run, "subject_id string, path string, bytes long")
