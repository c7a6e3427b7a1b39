"""Telephony audio columns: bytes as 8-bit mu-law, A-law or ADPCM WAV files, expanded, decoded and resampled.

mu-law and A-law expand by 256-entry tables made from their formulas. ADPCM blocks decode together: one
NumPy step for each nibble place over all blocks. Linear resampling doubles the rate within a document.

Null and empty texts give a payload of 64 zero bytes. Every row gives one row, equal texts equal values. A WAV file holds up to 4 GB, Spark a value of up to 2 GB. Other
columns stay as they are unless they have the name of a new one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, map_slices, stored

UNIT = 64
RATE = 8000
#: WAV format codes.
CODES = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}

#: The step sizes and index moves of the IMA ADPCM recommendation (1992).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) * 2 + 33) << (code >> 4 & 7)) - 33
    return (np.where(code & 128, -size, size) * 4).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    power, low = code >> 4 & 7, (code & 15) * 2 + 1
    size = np.where(power, (low + 32) << np.maximum(power - 1, 0), low)
    return (np.where(code & 128, size, -size) * 8).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Blocks (n, bytes) of mono IMA ADPCM -> samples (n, 2 * bytes - 7); indexes over 88 count as 88."""
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(codes, 1):
        step = STEPS[index]
        move = step >> 3
        move += np.where(code & 4, step, 0)
        move += np.where(code & 2, step >> 1, 0)
        move += np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, 88)
        out[k] = value
    return out.T


def wav(data: bytes, codec: str, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAV file around the data."""
    bits = {"pcm": 16, "adpcm": 4}.get(codec, 8)
    extra = struct.pack("<H", 2 * block - 7) if codec == "adpcm" else b""
    fmt = struct.pack("<HHIIHHH", CODES[codec], 1, rate, rate * bits // 8, 2 if codec == "pcm" else block, bits, len(extra)) + extra
    count = len(data) // 2 if codec == "pcm" else len(data) // block * (2 * block - 7) if codec == "adpcm" else len(data)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(stored: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, data) of a WAV file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, code, rate = 12, 0, 0
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            code, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        if name == b"data":
            return {v: k for k, v in CODES.items()}[code], rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def expand(codec: str, data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """16-bit samples of stored bytes."""
    if codec == "mulaw":
        return MULAW[data]
    if codec == "alaw":
        return ALAW[data]
    if codec == "adpcm":
        return decode_adpcm(data[: len(data) // block * block].reshape(-1, block)).ravel()
    return data.view("<i2")


def doubled(samples: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; the last sample of a document is held. ends: where documents end."""
    out = np.empty(2 * len(samples), np.int16)
    out[0::2] = samples
    nxt = np.empty_like(samples)
    nxt[:-1] = samples[1:]
    nxt[ends - 1] = samples[ends - 1]
    out[1::2] = (samples.astype(np.int32) + nxt) >> 1
    return out


def _sums(samples: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Energy, peak and sign changes of each document."""
    wide = samples.astype(np.int32)
    turn = np.zeros(len(samples), np.int32)
    turn[1:] = (wide[1:] < 0) != (wide[:-1] < 0)
    turn[starts] = 0
    return np.add.reduceat(np.square(wide.astype(np.int64)), starts), np.maximum.reduceat(np.abs(wide), starts), np.add.reduceat(turn, starts)


def store(docs: DataFrame, text: str = "text", out: str = "media", codec: str = "mulaw") -> DataFrame:
    """docs with `out`: a WAV file (binary) whose samples are the padded UTF-8 bytes of the text; a column of that name is replaced."""
    docs = docs.drop(out)

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        made = [wav(_padded(x), codec, block=UNIT if codec == "adpcm" else 1) for x in part.column(text).cast(pa.binary()).fill_null(b"").to_pylist()]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], [*part.schema.names, out])

    return map_slices(docs, text, kernel, f"{ddl(docs)}, {out} binary")


def to_pcm(media: DataFrame, column: str = "media", out: str = "pcm", double: bool = True) -> DataFrame:
    """media with `out`: its audio expanded to 16-bit PCM, at twice the rate if double, as a WAV file. Null media stay null; a column of that name is replaced."""
    media = media.drop(out)

    def run(batches):
        for part in batches:
            made = []
            for stored in part.column(column).to_pylist():
                if stored is None:
                    made.append(None)
                    continue
                codec, rate, data = read_wav(stored)
                pcm = expand(codec, np.frombuffer(data, np.uint8))
                made.append(wav((doubled(pcm, np.array([len(pcm)])) if double and len(pcm) else pcm).tobytes(), "pcm", rate * (1 + double)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], [*part.schema.names, out])

    return media.mapInArrow(run, f"{ddl(media)}, {out} binary")


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def digest(docs: DataFrame, codec: str = "mulaw") -> DataFrame:
    """A row for each document: its text is stored as a WAV file in a table of the shared folder, read back, expanded and resampled.

    doc_id, sizes and digests of payload and file, a feature text (mu-law, A-law and ADPCM readings of the payload, and the resampled PCM) and
    pcm, the resampled 16-bit WAV file itself.
    """
    texts = docs.select("doc_id", F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    media = stored(store(texts, codec=codec).drop("text"), "media")

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, back, files = [], [], part.column("media").to_pylist()
        for media in files:
            data = read_wav(media)[2]
            back.append(data)
            rows.append([len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()])
        flat = np.frombuffer(b"".join(back), np.uint8)
        ends = np.cumsum([len(x) for x in back])
        starts = np.concatenate(([0], ends[:-1]))
        readings = []
        samples = {x: expand(x, flat) for x in ("mulaw", "alaw", "adpcm")}
        for name, first in (("mulaw", starts), ("alaw", starts), ("adpcm", starts // UNIT * (2 * UNIT - 7))):
            energy, peak, turns = _sums(samples[name], first)
            count = np.diff(np.append(first, len(samples[name])))
            readings.append([f"{name}:n={n},rms={np.sqrt(e / n):.3f},peak={p},turns={t}" for n, e, p, t in zip(count.tolist(), energy.tolist(), peak.tolist(), turns.tolist(), strict=True)])
        own = starts if codec != "adpcm" else starts // UNIT * (2 * UNIT - 7)
        stop = np.append(own[1:], len(samples[codec]))
        wide = doubled(samples[codec], stop).tobytes()
        cut = [wide[4 * lo : 4 * hi] for lo, hi in zip(own.tolist(), stop.tolist(), strict=True)]
        feature = ["|".join(x) for x in zip(*readings, (f"pcm16k:crc32={zlib.crc32(x)}" for x in cut), strict=True)]
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        arrays = [part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(feature), pa.array([wav(x, "pcm", 2 * RATE) for x in cut], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    return map_slices(media, "media", kernel, schema, most=1 << 20)
