"""Best-fit packing of tokenised documents into sequences of fixed capacity, improved by swap-based local search.

Only how many pieces have each length reaches the driver (`capacity` numbers at most), never the pieces. There, bins
are kept as patterns with multiplicities: equal bins are one entry. A first fill takes the best fitting
length for each gap; then the local search moves a piece, swaps one for one or two for one between
underfull bins, always towards the fuller bin, so that the sum of squared fill rises until bins empty.
On the executors every piece takes a rank within its length, found by counting in hashed buckets, so that a
length of which a third of all pieces are is dealt over many tasks, and its rank finds its place in the plan.

Null and empty texts are one piece, the closing id 0 alone. Repeated rows are pieces of their own. Only doc_id and text are read, so extra columns
of any name do no harm; null ids are pieces like others. Rows that share id and piece number, null ids among them, are dealt by their ids' checksum too.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load_words
from .common import map_slices, stored

CAPACITY = 2048
#: Rows of a length that one task ranks, about.
BUCKET_ROWS = 20_000
#: The emptiest bins that the search tries to empty first, before it goes on with the rest.
FRONT = 24

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: the document's ids by the tokenizer of `path`, then id 0, cut only where over the capacity."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = load_words(path).encode(part.column("text").fill_null("").to_pylist())
        ids, ends = np.insert(ids, ends, 0).astype("<u4"), ends + np.arange(1, len(ends) + 1)
        size = np.diff(ends, prepend=0)
        many = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = piece * capacity
        length = np.minimum(size[row] - start, capacity)
        at, raw = (ends - size)[row] + start, memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", kernel, PIECES, most=1 << 20)


def first_fill(counts: dict[int, int], capacity: int) -> Counter:
    """Patterns (ascending lengths) -> how many bins have them, each gap taking the longest length that fits."""
    left, bins = dict(counts), Counter()
    alive = sorted(left)
    while alive:
        gap, use = capacity, {}
        k = len(alive) - 1
        while k >= 0 and gap >= alive[0]:
            k = min(k, int(np.searchsorted(alive, gap, "right")) - 1)
            if k < 0:
                break
            n = min(gap // alive[k], left[alive[k]])
            use[alive[k]] = n
            gap -= n * alive[k]
            k -= 1
        times = min(left[x] // n for x, n in use.items())
        bins[tuple(sorted(x for x, n in use.items() for _ in range(n)))] += times
        for x, n in use.items():
            left[x] -= n * times
        alive = [x for x in alive if left[x]]
    return bins


@lru_cache(maxsize=4096)
def _twos(bin_: tuple) -> list[tuple[int, int, int]]:
    """Sums of two pieces, from distinct lengths: a bin of 2048 has 63 of them at most."""
    lengths, many = sorted(set(bin_)), Counter(bin_)
    return sorted((x + y, x, y) for i, x in enumerate(lengths) for y in lengths[i:] if x != y or many[x] > 1)


def _exchange(a: tuple, b: tuple, gap: int) -> tuple[tuple, tuple] | None:
    """What to take out of a and of b (which has the gap) so that b gains the most that fits; None if it can't gain."""
    ones_a, ones_b = sorted(set(a)), sorted(set(b))
    twos_a, twos_b = _twos(a), _twos(b)
    best, found = 0, None
    give = [((x,), x) for x in ones_a]
    back = [((), 0), *(((y,), y) for y in ones_b)]
    for gives, backs in ((give, back), ([((x, y), s) for s, x, y in twos_a], back[1:]), (give, [((x, y), s) for s, x, y in twos_b])):
        if not gives or not backs:
            continue
        sums = np.array([s for _, s in backs])
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        for out, s in gives:
            k = int(np.searchsorted(sums, s - gap, "left"))  # the least that b may give back
            if k < len(sums) and best < (d := s - int(sums[k])) <= gap:
                best, found = d, (out, backs[order[k]][0])
        if best == gap:
            break
    return found


def _without(bin_: tuple, out: tuple, into: tuple) -> tuple:
    items = list(bin_)
    for x in out:
        items.remove(x)
    return tuple(sorted([*items, *into]))


def _raised(bits: int, gap: int) -> int:
    """Bits of bits moved up by 1, 2, ... gap."""
    out, n = bits << 1, 1
    while n < gap:
        step = min(n, gap - n)
        out, n = out | out << step, n + step
    return out


def _masks(bin_: tuple, capacity: int) -> tuple[int, int, int, int]:
    """As bits of a number: the bin's pieces, its sums of two, and what one piece and two pieces may hold that it takes in exchange to be fuller and fit."""
    ones, twos, gap = 0, 0, capacity - sum(bin_)
    for x in set(bin_):
        ones |= 1 << x
    for x, _, _ in _twos(bin_):
        twos |= 1 << x
    return ones, twos, _raised(1 | ones | twos, gap), _raised(ones, gap)


def local_search(bins: Counter, capacity: int) -> Counter:
    """Exchanges between underfull bins until the fewest possible bins are left or no exchange raises the squared fill. A pair of bins is asked again only when one of them is new,
    and asked by two meets of bit masks, so the search needs no other end."""
    bins = Counter(bins)
    least, count = -(-sum(sum(p) * n for p, n in bins.items()) // capacity), sum(bins.values())
    open_ = sorted((size, p) for p in bins if (size := sum(p)) < capacity)
    log, seen = [p for _, p in open_], {}  # patterns as they came, and how many of them each has met
    masks = {p: _masks(p, capacity) for p in log}

    def better(some: list[tuple[int, tuple]]) -> tuple | None:
        for size, a in some:
            ones, twos = masks[a][:2]
            for total, b in reversed(sorted({(sum(p), p) for p in log[seen[a] :] if p in masks}) if a in seen else open_):
                if total < size:
                    break
                if (ones & masks[b][2] or twos & masks[b][3]) and (a != b or bins[a] > 1):
                    return a, b, *_exchange(a, b, capacity - total)
            seen[a] = len(log)
        return None

    while count > least and (found := better(open_[:FRONT]) or better(open_[FRONT:])):
        a, b, out, back = found
        times = bins[a] // 2 if a == b else min(bins[a], bins[b])
        bins.subtract({a: times})
        bins.subtract({b: times})
        count -= 2 * times
        for p in (_without(a, out, back), _without(b, back, out)):
            if not p:
                continue
            bins[p] += times
            count += times
            if (size := sum(p)) < capacity:
                log.append(p)
                if p not in masks:
                    masks[p] = _masks(p, capacity)
                    insort(open_, (size, p))
        for p in {a, b}:
            if not bins[p]:
                del bins[p], masks[p], open_[bisect_left(open_, (sum(p), p))]
                seen.pop(p, None)
    return bins


class Plan:
    """Where the r-th piece of a length goes: runs of ranks, each a start of sequences and an offset in them."""

    def __init__(self, bins: Counter):
        used, runs, first = Counter(), [], 0
        for pattern in sorted(bins):
            offset = 0
            for length, uses in sorted(Counter(pattern).items()):
                runs.append((length << 40 | used[length], uses, first, offset))
                used[length] += uses * bins[pattern]
                offset += length * uses
            first += bins[pattern]
        self.sequences = first
        self.keys, self.uses, self.first, self.offset = np.array(sorted(runs), np.int64).reshape(-1, 4).T.copy()

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length << 40 | rank
        run = np.searchsorted(self.keys, key, "right") - 1
        nth = key - self.keys[run]
        return self.first[run] + nth // self.uses[run], self.offset[run] + nth % self.uses[run] * length


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (PIECES) with sequence_id and offset: all pieces in as few sequences as the search finds, gapless from 0."""
    cut = stored(cut, "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    if not counts:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    plan = Plan(local_search(first_fill(counts, capacity), capacity))
    buckets = max(64, sum(counts.values()) // BUCKET_ROWS)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    base = cut.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches):
        for part in batches:
            sequence, offset = plan(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sequence), pa.array(offset)], [*part.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
