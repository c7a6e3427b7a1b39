"""Removal of long repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if a string of `length` bytes that covers it starts anywhere else too, in another document or in its own.

1. Every document is cut into cells: runs of window starts whose windows share the least hash of their GRAM-byte
   strings. That choice depends on a window's content alone, so equal windows lie in cells of equal hash.
2. Cells meet by hash, packed, and those whose hash stands alone go. Equal windows can only lie in what is left.
3. The texts of the left cells meet by hash again, equal texts (compared byte by byte) as one with all their places.
4. There a suffix sort by difference cover modulo 3 runs over them: triples of the sampled suffixes (those at
   places 1 and 2 modulo 3) are sorted and named, names are recursed on in triples until they stand for `length` - 3 bytes,
   the remaining suffixes are merged by their leading bytes and the names after them, and neighbours in each order
   are compared. Windows equal to a neighbour's are repeated.
5. Their places go back to the documents, which are cut.

Cells whose hash more than HOT places share are cut to single windows first and meet by the window's own hash, so a common
passage in many surroundings doesn't gather in one task. Hashes only bring texts together; what is alike is told by bytes. Null and empty texts, and those shorter than `length`, lose nothing.
Repeated rows are documents of their own: they lose all windows that they have. Bytes of a character cut in two are dropped from the kept text, but not
from the counts and digests of bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import equal_spans, gather, gram_hashes, span_hashes
from .common import ddl, free, mix64, release, slices, utf8

LENGTH, GRAM = 200, 96
#: Bytes that one suffix sort takes, about; a group of cells of one hash isn't split, so it may be more.
SORT_BYTES = 2_500_000
#: Bits of a name of which three are one key; longer names are joined two at a time.
NAME_BITS = 21
HOT = 20_000
#: Text of the documents that a bucket holds, about, and text whose cells meet in one bucket of hashes, about.
BUCKET_BYTES, MEET_BYTES = 3 << 20, 8 << 20
#: Cells that a task deals to buckets at once, about: the more, the larger are its packs.
DEAL_CELLS = 400_000
#: Packs of at most as many bytes are records one after another; larger ones are compressed columns.
SMALL = 2048


#: Types of what is packed: cells with hashes, cells that met, and what goes.
CELL = ("u8", "i8", "i8", "i4", "u2")  # hash, doc_id, text_key, first window start, windows
MET = (*CELL, "?")  # and whether many places share it
SPAN = ("i8", "i8", "i4", "i4")  # doc_id, text_key, first byte, end


def _record(kinds: tuple[str, ...]) -> np.dtype:
    return np.dtype([("flag", "u1"), *((f"f{i}", k) for i, k in enumerate(kinds))])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: a flag, then type, size and data of each; large packs are compressed, small ones carry a few bytes more than their data."""
    raw = b"".join(x.dtype.str.encode().ljust(4) + len(d := x.tobytes()).to_bytes(4, "little") + d for x in arrays)
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > SMALL else b"\0" + raw


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw[1:]) if raw[0] else raw[1:], 0, []
    while at < len(raw):
        size = int.from_bytes(raw[at + 4 : at + 8], "little")
        out.append(np.frombuffer(raw[at + 8 : at + 8 + size], raw[at : at + 4].decode().strip()))
        at += 8 + size
    return out


def _joined(rows: list[bytes], kinds: tuple[str, ...] | None = None) -> list[np.ndarray]:
    """The arrays of several packs, one after another; kinds are the types of records, if packs may be such."""
    if kinds is None:
        return [np.concatenate(x) for x in zip(*map(_unpack, rows), strict=True)]
    records = np.frombuffer(b"".join(x for x in rows if x[0] == 2), _record(kinds))
    columns = [_unpack(x) for x in rows if x[0] != 2]
    return [np.concatenate((records[f"f{i}"], *(x[i] for x in columns))) for i in range(len(kinds))]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if n < width else h


def cells(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, document, first window start in it, windows) of each cell of texts that end at at[1:]."""
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < length:
        return empty
    h = gram_hashes(data, gram)
    least = _least(h, length - gram + 1)
    good = np.zeros(len(least) + 1, np.int8)
    size = np.diff(at)
    long_ = size >= length
    np.add.at(good, at[:-1][long_], 1)
    np.add.at(good, (at[1:] - length + 1)[long_], -1)
    good = np.cumsum(good[:-1]) > 0
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1]) | ~good[:-1]
    new[at[:-1][at[:-1] < len(least)]] = True
    starts = np.flatnonzero(new & good)
    if not len(starts):
        return empty
    stop = np.flatnonzero(np.r_[new | ~good, True])
    ends = stop[np.searchsorted(stop, starts, "right")]
    doc = np.searchsorted(at, starts, "right") - 1
    return least[starts], doc, starts - at[doc], ends - starts


def repeated(text: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which of the window starts of cells (text[start : start + windows + length - 1]) have an equal window elsewhere: a mask over text, by difference cover modulo 3."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(length + 8, np.uint8)))
    sample = np.flatnonzero(np.arange(n + length) % 3 != 0)
    sample = sample[sample < n]
    name = np.zeros(n + length, np.int64)  # of sampled places only

    def rename(keys: np.ndarray) -> None:
        name[sample] = np.unique(keys, return_inverse=True)[1]

    def joined(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        if int(name.max(initial=0)) < 1 << NAME_BITS:
            return a << 42 | b << 21 | c
        return np.unique(a << 31 | b, return_inverse=True)[1] << 31 | c

    # triples of bytes, sorted
    rename(padded[sample].astype(np.int64) << 16 | padded[sample + 1].astype(np.int64) << 8 | padded[sample + 2])
    span, goal = 3, length - 3
    while span < goal:  # triples of names, each a multiple of 3 apart, until they stand for `goal` bytes
        step = min(span // 3 * 3, (goal - span + 1) // 2 // 3 * 3 or 3)
        last = min(2 * step, goal - span) // 3 * 3
        if last < step:
            step = last
        rename(joined(name[sample], name[sample + step], name[sample + last]))
        if last == 0:
            break
        span += last
    tail = length - span  # bytes left after the names, 3 to 5
    ok = np.zeros(n + 1, np.int8)
    np.add.at(ok, starts, 1)
    np.add.at(ok, starts + windows, -1)
    valid = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    out = np.zeros(n, bool)
    for shift, left_out in ((1, 2), (2, 1), (0, 0)):  # suffixes that a shift brings to sampled places compare by bytes, then names
        own = valid[valid % 3 != left_out]
        key = name[own + shift]
        for k in (*range(shift), *range(shift + span, length)):
            if int(key.max(initial=0)) >= 1 << 55:
                key = np.unique(key, return_inverse=True)[1]
            key = key << 8 | padded[own + k]
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        out[own[order[1:][same]]] = True
        out[own[order[:-1][same]]] = True
    assert tail <= 5
    return out


def _apart(text: np.ndarray, lo: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Numbers that tell apart spans of one group (equal hashes) whose bytes differ; 0 for those equal to their group's first."""
    _, first, back = np.unique(group, return_index=True, return_inverse=True)
    head, out = first[back], np.zeros(len(group), np.int64)
    same = size == size[head]
    same[same] = equal_spans(text, lo[same], text, lo[head[same]], size[same])
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        out[i] = 1 + seen.setdefault(text[lo[i] : lo[i] + size[i]].tobytes(), len(seen))
    return out


def _alike(h: np.ndarray, own: np.ndarray, text: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by cell hash in which equal texts stand together, and where in it each run of equal texts begins; equal byte by byte."""
    order = np.lexsort((own, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])]
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    if (other := _apart(text, lo, size, group)).any():  # alike by hash only
        order = np.lexsort((other, own, h))
        new = np.r_[True, (group[order][1:] != group[order][:-1]) | (other[order][1:] != other[order][:-1])]
    return order, new


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _spread(names: list[str], kinds: tuple[str, ...], bucket: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """A packed row for each bucket. Small packs are cut out of one array of records, so many buckets cost neither a Python step nor a header each."""
    order, record = np.argsort(bucket, kind="stable"), _record(kinds)
    bucket = bucket[order]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(order) else np.zeros(1, np.int64)
    many, home = np.diff(edge), bucket[edge[:-1]]
    large = many * record.itemsize > SMALL
    columns = [_pack(*(x[order[a:b]].astype(k, copy=False) for x, k in zip(arrays, kinds, strict=True))) for a, b in zip(edge[:-1][large], edge[1:][large], strict=True)]
    few = order[np.repeat(~large, many)]
    records = np.empty(len(few), record)
    records["flag"] = 2
    for i, x in enumerate(arrays):
        records[f"f{i}"] = x[few]
    ends = np.r_[0, np.cumsum(many[~large]) * record.itemsize].astype(np.int32)
    cut_out = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(records.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.r_[home[~large], home[large]], pa.int32()), pa.concat_arrays([cut_out, pa.array(columns, pa.binary())])], names)


def spans(docs: DataFrame, buckets: int, length: int = LENGTH, gram: int = GRAM, meetings: int | None = None) -> DataFrame:
    """(doc_bucket, pack): packs of (doc_id, text_key, first byte, end) that go. docs: doc_id (no nulls), text_key, text. Hashes meet in `meetings` buckets, as many as `buckets` if not given."""
    meetings = meetings or buckets

    def deal(held):
        h, *more = map(np.concatenate, zip(*held, strict=True))
        return _spread(["bucket", "pack"], CELL, (h % np.uint64(meetings)).astype(np.int32), h, *more)

    def scan(batches):
        held, n = [], 0
        for part in slices(batches, "text"):
            h, doc, start, windows = cells(*utf8(part.column("text")), length, gram)
            if len(h):
                ids, keys = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "text_key"))
                held.append((h, ids, keys, start.astype(np.int32), windows.astype(np.uint16)))
                n += len(h)
            if n >= DEAL_CELLS:
                yield deal(held)
                held, n = [], 0
        if held:
            yield deal(held)
        release()

    def alike(part: pa.Table) -> pa.Table:
        h, ids, keys, start, windows = _joined(part.column("pack").to_pylist(), CELL)
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        keep = count[back] > 1
        hot = (count[back] > HOT)[keep]
        ids, keys = ids[keep], keys[keep]
        return pa.Table.from_batches([_spread(["doc_bucket", "pack"], MET, _home(ids, keys, buckets), h[keep], ids, keys, start[keep], windows[keep], hot)])

    def texts(key, part: pa.Table, found: pa.Table) -> pa.Table:
        none = pa.table({"bucket": pa.array([], pa.int32()), "pack": pa.array([], pa.binary())})
        if not part.num_rows or not found.num_rows:
            return none
        h, ids, keys, start, windows, hot = _joined(found.column("pack").to_pylist(), MET)
        body, at = _inflated(part.column("text"))
        row = {k: i for i, k in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(), strict=True))}
        doc = np.array([row[k] for k in zip(ids.tolist(), keys.tolist(), strict=True)], np.int64)
        windows = windows.astype(np.int64)
        if hot.any():  # single windows, by their own hash
            many = np.where(hot, windows, 1)
            who = np.repeat(np.arange(len(h)), many)
            nth = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            h, ids, keys, doc, hot = h[who], ids[who], keys[who], doc[who], hot[who]
            start, windows = start[who] + nth.astype(np.int32), np.where(hot, 1, windows[who])
        lo = at[doc] + start
        size = windows + length - 1
        own = span_hashes(body, lo, lo + size)
        h = np.where(hot, mix64(h ^ own), h)
        # equal cells are one text with several places
        order, new = _alike(h, own, body, lo, size)
        first = np.flatnonzero(new)
        which = order[first]
        many = np.diff(np.r_[first, len(order)]).astype(np.int32)
        bucket = (h % np.uint64(buckets)).astype(np.int32)
        dealt, spots = np.argsort(bucket[which], kind="stable"), order[np.argsort(bucket[order], kind="stable")]
        which, many, out = which[dealt], many[dealt], []
        homes, begin = np.unique(bucket[which], return_index=True)
        stop, upto = np.r_[begin[1:], len(which)], np.r_[0, np.cumsum(np.bincount(np.searchsorted(homes, bucket), minlength=len(homes)))]
        for i, (b, x, y) in enumerate(zip(homes.tolist(), begin.tolist(), stop.tolist(), strict=True)):
            mine, places = which[x:y], spots[upto[i] : upto[i + 1]]
            out.append((b, _pack(h[mine], own[mine], windows[mine].astype(np.uint16), many[x:y], gather(body, lo[mine], size[mine]), ids[places], keys[places], start[places])))
        release()
        return pa.table({"bucket": pa.array([x for x, _ in out], pa.int32()), "pack": pa.array([x for _, x in out], pa.binary())})

    def sort(part: pa.Table) -> pa.Table:
        h, own, windows, places, text, ids, keys, start = _joined(part.column("pack").to_pylist())
        windows, size = windows.astype(np.int64), windows.astype(np.int64) + length - 1
        lo, place_at = np.cumsum(size) - size, np.cumsum(places) - places
        order, first = _alike(h, own, text, lo, size)
        text_of = np.empty(len(h), np.int64)
        text_of[order] = np.cumsum(first) - 1  # equal texts of different tasks are one
        which = order[first]  # ordered by hash
        total = np.bincount(text_of, weights=places).astype(np.int64)
        mask = [np.zeros(0, bool)] * len(which)
        upto, a = np.cumsum(size[which]), 0
        new_hash = np.r_[True, h[which][1:] != h[which][:-1], True]
        while a < len(which):  # whole hash groups, as many as one sort takes
            b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SORT_BYTES, "right"))
            b = max(b, a + 1)
            while not new_hash[b]:
                b = b - 1 if new_hash[a + 1 : b].any() else b + 1
            some = which[a:b]
            local = np.cumsum(size[some]) - size[some]
            if b - a > 1 or windows[some[0]] > 1:
                found = repeated(gather(text, lo[some], size[some]), local, windows[some], length)
            else:
                found = np.zeros(int(size[some].sum()), bool)
            for i, (x, w) in enumerate(zip(local.tolist(), windows[some].tolist(), strict=True)):
                mask[a + i] = found[x : x + w]
            a = b
        out_i, out_k, out_a, out_b = [], [], [], []
        for i in range(len(h)):
            t = text_of[i]
            if total[t] > 1:
                begin, end = np.array([0]), windows[i : i + 1]
            elif mask[t].any():
                begin, end = _runs(mask[t])
            else:
                continue
            at = slice(place_at[i], place_at[i] + places[i])
            n = len(begin)
            out_i.append(np.repeat(ids[at], n))
            out_k.append(np.repeat(keys[at], n))
            out_a.append((start[at][:, None] + begin).ravel())
            out_b.append((start[at][:, None] + end + length - 1).ravel())
        if not out_i:
            return pa.table({"doc_bucket": pa.array([], pa.int32()), "pack": pa.array([], pa.binary())})
        ids, keys, a, b = map(np.concatenate, (out_i, out_k, out_a, out_b))
        release()
        return pa.Table.from_batches([_spread(["doc_bucket", "pack"], SPAN, _home(ids, keys, buckets), ids, keys, a, b)])

    met = docs.mapInArrow(scan, "bucket int, pack binary").groupBy("bucket").applyInArrow(alike, "doc_bucket int, pack binary")
    held = deflated(docs, "text", buckets).groupBy("doc_bucket").cogroup(met.withColumnRenamed("doc_bucket", "at").groupBy("at")).applyInArrow(texts, "bucket int, pack binary")
    return held.groupBy("bucket").applyInArrow(sort, "doc_bucket int, pack binary")


def deflated(rows: DataFrame, text: str, buckets: int, id_: str = "doc_id", key_: str = "text_key", bucket_: str = "doc_bucket") -> DataFrame:
    """rows with the document's bucket, and the text compressed for the shuffle."""

    def run(batches):
        for part in slices(batches, text):
            squeeze = zstandard.ZstdCompressor(level=1).compress
            where = _home(*(part.column(c).to_numpy(zero_copy_only=False) for c in (id_, key_)), buckets)
            small = pa.array([squeeze(x) for x in part.column(text).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(small if n == text else c for n, c in zip(part.schema.names, part.columns, strict=True)), pa.array(where, pa.int32())], [*part.schema.names, bucket_])

    schema = ddl(rows.withColumn(text, F.col(text).cast("binary")))
    return rows.mapInArrow(run, f"{schema}, `{bucket_}` int")


def _inflated(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    rows = [expand(x) for x in column.to_pylist()]
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


def _home(ids: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(ids.astype(np.uint64) ^ mix64(keys.astype(np.uint64))) % np.uint64(buckets)).astype(np.int32)


def cut(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text") -> DataFrame:
    """docs with the kept text in place of its text and repeat_bytes, repeat_removed, repeat_spans, repeat_sha256 (of the kept bytes) after its columns; columns of those names are replaced."""
    docs = docs.drop("repeat_bytes", "repeat_removed", "repeat_spans", "repeat_sha256")
    names = docs.columns
    null_, id_, key_, bucket_ = (free(names, x) for x in ("was_null", "key_id", "text_key", "doc_bucket"))
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets, meetings = max(32, total // BUCKET_BYTES), max(64, total // MEET_BYTES)
    rows = docs.withColumns({null_: F.isnull(F.col(text)), text: F.coalesce(F.col(text).cast("string"), F.lit(""))})
    rows = rows.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), key_: F.xxhash64(text)})

    keyed = rows.select(F.col(id_).alias("doc_id"), F.col(key_).alias("text_key"), F.col(text).alias("text"))
    gone = spans(keyed, buckets, length, gram, meetings)
    whole = deflated(rows, text, buckets, id_, key_, bucket_)

    def keep(key, part: pa.Table, found: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip([*names, "repeat_bytes", "repeat_removed", "repeat_spans", "repeat_sha256"], [*(pa.string() if n == text else part.schema.field(n).type for n in names), pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)})
        where: dict[tuple[int, int], np.ndarray] = {}
        if found.num_rows:
            ids, keys, a, b = _joined(found.column("pack").to_pylist(), SPAN)
            order = np.lexsort((a, keys, ids))
            ids, keys, pair = ids[order], keys[order], np.stack((a[order], b[order]), axis=1)
            edge = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
            where = dict(zip(zip(ids[edge].tolist(), keys[edge].tolist(), strict=True), np.split(pair, edge[1:]), strict=True))
        body, at = _inflated(part.column(text))
        made = []
        for i, k in enumerate(zip(part.column(id_).to_pylist(), part.column(key_).to_pylist(), strict=True)):
            own = body[at[i] : at[i + 1]]
            mask = np.zeros(len(own) + 1, np.int32)
            if k in where:
                np.add.at(mask, where[k][:, 0], 1)
                np.add.at(mask, where[k][:, 1], -1)
            off = np.cumsum(mask[:-1]) > 0
            left = own[~off].tobytes()
            made.append((left.decode("utf-8", "ignore"), len(own), int(off.sum()), len(_runs(off)[0]), hashlib.sha256(left).hexdigest()))
        kept, *more = zip(*made, strict=True)
        kept = pa.array([None if null else x for x, null in zip(kept, part.column(null_).to_pylist(), strict=True)], pa.string())
        columns = [kept if n == text else part.column(n) for n in names]
        return pa.table([*columns, *(pa.array(x) for x in more)], [*names, "repeat_bytes", "repeat_removed", "repeat_spans", "repeat_sha256"])

    schema = ", ".join([ddl(rows.select(*names)), "repeat_bytes long, repeat_removed long, repeat_spans long, repeat_sha256 string"])
    return whole.groupBy(bucket_).cogroup(gone.withColumnRenamed("doc_bucket", "repeat_at").groupBy("repeat_at")).applyInArrow(keep, schema)


def cut_sql(length: int = LENGTH) -> str:
    """DuckDB SQL for doc_id, n_bytes, n_removed, n_spans and kept_sha256, of all windows."""
    step = 1000
    return f"""
with d as materialized (select row_number() over () as r, doc_id, hex(coalesce(text, '')) as x from documents),
c as materialized (select r, len(x) // 2 as n, j * {step} as base, substr(x, j * {2 * step} + 1, {2 * (step + length - 1)}) as y from (select r, x, unnest(range(0, len(x) // 2 // {step} + 1)) as j from d)),
w as materialized (select r, base + i as pos, md5_number(substr(y, 2 * i + 1, {2 * length})) as h from (select r, n, base, y, unnest(range(0, {step})) as i from c) where base + i + {length} <= n),
m as materialized (select r, pos from (select r, pos, count(*) over (partition by h) as k from w) where k > 1),
g as (select r, pos, pos - lag(pos) over (partition by r order by pos) as gap from m),
i as (select r, pos, sum(case when gap is null or gap > {length} then 1 else 0 end) over (partition by r order by pos) as run from g),
span as materialized (select r, run, min(pos) as lo, max(pos) + {length} as hi from i group by all),
gone as (select r, sum(hi - lo)::bigint as n_removed, count(*) as n_spans from span group by r),
kept as (select r, lo, hi from (select r, coalesce(lag(hi) over (partition by r order by run), 0) as lo, lo as hi from span) union all select span.r, max(hi), any_value(len(x) // 2) from span join d using (r) group by span.r),
left_ as (select kept.r, string_agg(substr(x, 2 * lo + 1, 2 * (hi - lo)), '' order by lo) as y from kept join d using (r) group by kept.r)
select doc_id, (len(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(y, x))) as kept_sha256 from d left join gone using (r) left join left_ using (r)"""
