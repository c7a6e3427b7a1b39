"""Sample-level operators: resampling to a regular rate, low-pass filter, augmentation, subsampling, display masks, ambiguous local hours."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake import session
from kinelake.functions.scalar import HOUR, div
from kinelake.operators.quality import with_next


def resample(df: DataFrame, columns: list[str], step_us: int, linear: bool = True, tolerance_us: int | None = None) -> DataFrame:
    """subject_id, us and columns on each subject's grid from its first time on: linear between the neighbours, or the nearer one's value (ties to the later). A missing neighbour gives a missing value,
    and so does a neighbour farther away than the tolerance (for lines: neighbours farther apart), so that nothing is drawn over gaps."""
    firsts = df.groupBy("subject_id").agg(F.min("us").alias("first_"))
    nxt = with_next(df.select("subject_id", "us", *columns), columns).join(firsts, "subject_id")
    # the grid points in [us, next us) belong to this row alone, so no join is needed
    start = -div(F.col("first_") - F.col("us"), step_us)
    stop = F.when(F.col("next_").isNull(), div(F.col("us") - F.col("first_"), step_us)).otherwise(-div(F.col("first_") - F.col("next_.us"), step_us) - 1)
    points = nxt.where(stop >= start).withColumn("k_", F.explode(F.sequence(start, stop))).withColumn("at_", F.col("first_") + F.col("k_") * step_us)
    return points.select("subject_id", F.col("at_").alias("us"), *(_between(c, linear, tolerance_us).alias(c) for c in columns))


def _between(c: str, linear: bool, tolerance_us: int | None) -> Column:
    """Column c at at_, which lies in [us, next_.us)."""
    ahead, apart = F.col("at_") - F.col("us"), F.col("next_.us") - F.col("us")
    if linear:
        line = F.col(c) + (F.col(f"next_.{c}") - F.col(c)) * (ahead / apart)
        return F.when(ahead == 0, F.col(c).cast("double")).when(apart <= tolerance_us, line) if tolerance_us is not None else F.when(F.col("next_").isNull() | (ahead == 0), F.col(c).cast("double")).otherwise(line)
    own = F.col("next_").isNull() | (2 * ahead < apart)
    if tolerance_us is None:
        return F.when(own, F.col(c)).otherwise(F.col(f"next_.{c}")).cast("double")
    return F.when(own & (ahead <= tolerance_us), F.col(c)).when(~own & (apart - ahead <= tolerance_us), F.col(f"next_.{c}")).cast("double")


def uniform(df: DataFrame, columns: list[str], rate: str, tolerance_us: int = 1_000_000) -> DataFrame:
    """subject_id, us, columns and the rate on a grid of `rate` (a whole number a subject, in that column) points a second from each subject's first time to its last: point k stands k/rate seconds after the first,
    to the microsecond, and has the nearest row's values, or none if that is farther away than the tolerance. So gaps are rows without values, and count as not worn."""
    r = F.col(rate).cast("long")
    firsts = df.groupBy("subject_id").agg(F.min("us").alias("first_"))
    nxt = with_next(df.select("subject_id", "us", *columns, rate), columns).join(firsts, "subject_id")
    least = lambda off: F.greatest(F.lit(0), -div(r - 2 * r * off, 2_000_000))  # noqa: E731 - the first point not before an offset
    start = least(F.col("us") - F.col("first_"))
    stop = F.when(F.col("next_").isNull(), start).otherwise(least(F.col("next_.us") - F.col("first_")) - 1)
    at = F.col("first_") + div(2_000_000 * F.col("k_") + r, 2 * r)
    points = nxt.where(stop >= start).withColumn("k_", F.explode(F.sequence(start, stop))).withColumn("at_", at)
    points = points.where(F.col("next_").isNotNull() | (F.col("at_") == F.col("us")))  # none after the last row
    return points.select("subject_id", F.col("at_").alias("us"), *(_between(c, False, tolerance_us).alias(c) for c in columns), rate)


def butterworth(order: int, cutoff_hz: float, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a low-pass filter of even order, by the bilinear transform."""
    w = math.tan(math.pi * cutoff_hz / rate)
    out = []
    for k in range(order // 2):
        q = 2 * math.sin(math.pi * (2 * k + 1) / (2 * order))
        norm = 1 + q * w + w * w
        out.append((np.array([1, 2, 1]) * w * w / norm, np.array([1, 2 * (w * w - 1) / norm, (1 - q * w + w * w) / norm])))
    return out


#: Samples that one matrix product filters.
CHUNK = 256


@lru_cache(64)
def _tables(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A section's powers of the move of its state, what a sample pushes into it, and a block's response from rest."""
    move, push = np.array([[-a[1], 1], [-a[2], 0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(CHUNK):
        powers.append(move @ powers[-1])
    powers = np.stack(powers)
    impulse = np.r_[b[0], powers[: CHUNK - 1, 0] @ push]
    at = np.arange(CHUNK)
    return powers, push, np.where(at[:, None] >= at, impulse[np.abs(at[:, None] - at)], 0)


def _section(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x through one second-order section from a state, and the state after it. Blocks at once from rest, by their impulse response; then what the state before a block adds, a block at a time."""
    powers, push, response = _tables(tuple(map(float, b)), tuple(map(float, a)))
    many, rest = -(-len(x) // CHUNK), len(x) % CHUNK
    rows = np.concatenate((x, np.zeros(many * CHUNK - len(x)))).reshape(many, CHUNK)
    out = rows @ response.T
    ends = rows @ (powers[CHUNK - 1 :: -1] @ push)
    for k in range(many):
        out[k] += powers[:CHUNK, 0] @ state
        last = rest if rest and k == many - 1 else CHUNK
        state = powers[last] @ state + (ends[k] if last == CHUNK else rows[k, :last] @ (powers[last - 1 :: -1] @ push))
    return out.ravel()[: len(x)], state


class Cascade:
    """Second-order sections in a row; a state is two numbers a section."""

    def __init__(self, sections: list[tuple[np.ndarray, np.ndarray]]):
        self.sections = sections
        unit = np.eye(2 * len(sections))
        self.move = np.stack([self._step(s) for s in unit], 1)

    def _step(self, state: np.ndarray) -> np.ndarray:
        """The state after one sample of nothing."""
        out, u = [], 0.0
        for k, (b, a) in enumerate(self.sections):
            p, q = state[2 * k], state[2 * k + 1]
            out += [-a[1] * p + q + (b[1] - a[1] * b[0]) * u, -a[2] * p + (b[2] - a[2] * b[0]) * u]
            u = p + b[0] * u
        return np.array(out)

    def rest(self, x: float) -> np.ndarray:
        """The state after x for ever."""
        return np.concatenate([[(1 - b[0]) * x, (b[2] - a[2]) * x] for b, a in self.sections])

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        state = self.rest(x[0]) if state is None else state
        after = []
        for k, (b, a) in enumerate(self.sections):
            x, end = _section(x, b, a, state[2 * k : 2 * k + 2])
            after.append(end)
        return x, np.concatenate(after)

    def runs(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x with each [lo, hi) filtered from its state, and the states after them. Short runs go together, a sample of each at a time, long ones by blocks."""
        out, after, n = x.copy(), states.copy(), hi - lo
        short = np.flatnonzero(n <= CHUNK)
        short = short[np.argsort(-n[short], kind="stable")]
        own, left = np.ascontiguousarray(states[short].T), n[short]
        for t in range(left[0] if len(left) else 0):
            live = np.searchsorted(-left, -t)  # those longer than t come first
            at = lo[short[:live]] + t
            u = x[at]
            for k, (b, a) in enumerate(self.sections):
                s1, s2 = own[2 * k, :live], own[2 * k + 1, :live]
                y = b[0] * u + s1
                s1[:], s2[:] = b[1] * u - a[1] * y + s2, b[2] * u - a[2] * y
                u = y
            out[at] = u
        after[short] = own.T
        for r in np.flatnonzero(n > CHUNK):
            out[lo[r] : hi[r]], after[r] = self.run(x[lo[r] : hi[r]], states[r])
        return out, after

    def after(self, n: int, state: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The state after n samples that give `own` from nothing."""
        return np.linalg.matrix_power(self.move, n) @ state + own


#: Rows that are filtered at once.
ROWS = 1 << 18
KEYS = ["subject_id", "chunk_"]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of about ROWS rows, and the number of each row's chunk; a chunk's rows lie together, but may go on in the next batch."""
    held, n, last, number = [], 0, None, -1
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= ROWS or (batch is None and n):
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, new = [], 0, np.zeros(part.num_rows, bool)
            for c in KEYS:
                code = part.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            ends = [tuple(part.column(c)[at].as_py() for c in KEYS) for at in (0, part.num_rows - 1)]
            new[0] = number < 0 or ends[0] != last
            group, last = number + np.cumsum(new), ends[1]
            number = int(group[-1])
            yield part, group


class _Column:
    """One column of a stream of batches, filtered run by run; a run that a batch's end cuts goes on from its state."""

    def __init__(self, cascade: Cascade):
        self.cascade, self.rest, self.group, self.state = cascade, cascade.rest(1.0), -1, None

    def step(self, v: np.ndarray, group: np.ndarray, given: dict[int, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """v filtered, the ends of its runs, and the states there. given: states before chunks that begin with a value; without it such chunks begin from nothing, else, as runs after missing values, from rest at their first value."""
        ok = np.isfinite(v)
        first = np.r_[group[0] != self.group, group[1:] != group[:-1]]
        lo = np.flatnonzero(ok & (first | ~np.r_[False, ok[:-1]]))
        hi = np.flatnonzero(ok & np.r_[first[1:] | ~ok[1:], True]) + 1
        states = v[lo][:, None] * self.rest
        if given is None:
            states[first[lo]] = 0
        for g, state in (given or {}).items():
            at = np.searchsorted(group, g)
            if at < len(group) and group[at] == g and first[at] and ok[at]:
                states[np.searchsorted(lo, at)] = state
        if not first[0] and ok[0] and self.state is not None:
            states[0] = self.state
        out, after = self.cascade.runs(v, lo, hi, states)
        self.group, self.state = group[-1], after[-1] if ok[-1] else None
        return out, hi, after


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _pass(df: DataFrame, columns: list[str], cascade: Cascade, backward: bool, chunk_us: int) -> DataFrame:
    """df through the cascade in one direction, in chunks of time. First each chunk of a subject that has several says how it moves a state; a subject's chunks (a row each) are then chained, and each chunk is filtered from the state before it,
    which comes as a row before its own. Tasks read chunks as a stream of sorted rows, many short ones at once."""
    cut, kind, every = df.withColumn("chunk_", div("us", chunk_us)), dict(df.dtypes)["subject_id"], df.columns
    by_time = F.col("us").desc() if backward else F.col("us").asc()
    form = f"subject_id {kind}, chunk_ long, k int"

    def told(batches):
        own, open_, names = [_Column(cascade) for _ in columns], {}, ["subject_id", "chunk_", "k", "n", "opens", "whole", "first", "own"]
        types = None

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for part, group in _numbered(batches):
            types = [part.schema.field("subject_id").type, pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.float64(), pa.list_(pa.float64())]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends, rows = np.r_[starts[1:], len(group)], []
            keys = list(zip(*(part.column(c).take(pa.array(starts)).to_pylist() for c in KEYS), strict=True))
            for k, c in enumerate(columns):
                v, goes_on = _numbers(part.column(c)), own[k].group == group[0]
                _, hi, after = own[k].step(v, group, None)
                ok = np.isfinite(v)
                whole = np.logical_and.reduceat(ok, starts)
                for g, (lo, end) in enumerate(zip(starts, ends, strict=True)):
                    state = after[np.searchsorted(hi, end)].tolist() if ok[end - 1] else None
                    if g == 0 and goes_on:
                        subject, chunk, _, n, opens, all_, first, _ = open_[k]
                        open_[k] = (subject, chunk, k, n + int(end), opens, all_ and bool(whole[0]), first, state)
                    else:
                        if k in open_:
                            rows.append(open_[k])
                        open_[k] = (*keys[g], k, int(end - lo), bool(ok[lo]), bool(whole[g]), float(v[lo]) if ok[lo] else 0.0, state)
            if rows:
                yield made(rows)
        if open_:
            yield made(list(open_.values()))

    def chained(batches):
        last, state = None, None
        for batch in batches:
            rows = []
            for subject, chunk, k, n, opens, whole, first, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state, last = state if (subject, k) == last else None, (subject, k)
                before = state if opens else None
                if before is not None:
                    rows.append((subject, chunk, k, before.tolist()))
                start = before if before is not None else cascade.rest(first)
                state = cascade.after(n, start, np.array(own)) if whole else None if own is None else np.array(own)
            types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["subject_id", "chunk_", "k", "before"])

    def filtered(batches):
        own, pending = [_Column(cascade) for _ in columns], [{} for _ in columns]
        for part, group in _numbered(batches):
            which = part.column("k_").to_numpy()
            for at in np.flatnonzero(which < len(columns)):
                pending[which[at]][int(group[at])] = np.array(part.column("before_")[int(at)].as_py())
            held = which == len(columns)
            part, group = part.filter(pa.array(held)), group[held]
            if not len(group):
                continue
            made = {c: pa.array(own[k].step(_numbers(part.column(c)), group, pending[k])[0], pa.float64(), from_pandas=True) for k, c in enumerate(columns)}
            pending = [{g: state for g, state in p.items() if g > group[-1]} for p in pending]
            yield pa.RecordBatch.from_arrays([made[name] if name in made else part.column(name) for name in every], every)

    spans = cut.groupBy("subject_id").agg(F.min("chunk_").alias("lo_"), F.max("chunk_").alias("hi_")).where("lo_ < hi_").select(F.col("subject_id").alias("of_"))
    several = cut.select("subject_id", "us", "chunk_", *columns).join(spans, F.col("subject_id").eqNullSafe(F.col("of_")), "left_semi")
    summary = several.repartition(*KEYS).sortWithinPartitions(*KEYS, by_time).mapInArrow(told, f"{form}, n long, opens boolean, whole boolean, first double, own array<double>")
    states = summary.repartition("subject_id").sortWithinPartitions("subject_id", "k", F.col("chunk_").desc() if backward else F.col("chunk_").asc()).mapInArrow(chained, f"{form}, before array<double>")
    # empty, not null: a column of null arrays takes Spark's Arrow writer quadratic time in the rows of a batch
    rows = cut.withColumns({"k_": F.lit(len(columns)), "before_": F.array().cast("array<double>")})
    before = states.select(*(F.col("subject_id") if f.name == "subject_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema), "chunk_", F.col("k").alias("k_"), F.col("before").alias("before_"))
    schema = ", ".join(f"`{f.name}` {'double' if f.name in columns else f.dataType.simpleString()}" for f in df.schema)
    return rows.unionByName(before).repartition(*KEYS).sortWithinPartitions(*KEYS, "k_", by_time).mapInArrow(filtered, schema)


def low_pass(df: DataFrame, columns: list[str], cutoff_hz: float, rate: float, order: int = 8, chunk_us: int = HOUR) -> DataFrame:
    """Regular samples filtered forwards and backwards; runs between missing values are filtered on their own, each from rest at its first value. Cut-offs at or above half the rate change nothing. The work's groups are a subject's chunks
    of time; between chunks only states are carried, so a long recording is many tasks."""
    if cutoff_hz * 2 >= rate:
        return df
    cascade = Cascade(butterworth(order, cutoff_hz, rate))
    once = session.kept(_pass(df, columns, cascade, False, chunk_us), "filtered")
    return _pass(once, columns, cascade, True, chunk_us)


def augment(windows: DataFrame, seed: int = 42) -> DataFrame:
    """Windows (subject_id, idx, x, y, z) with axes permuted, turned about a random axis, and decimated one to three times then restored linearly; the choice hangs on seed, subject and window alone."""
    key = F.xxhash64(F.lit(seed), "subject_id", "idx")
    unit = lambda k: F.pmod(F.xxhash64(key, F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    row = windows.withColumns({"pick_": (unit(0) * 6).cast("int"), "angle_": (unit(1) * 2 - 1) * math.pi, "u_": unit(2) * 2 - 1, "v_": unit(3) * 2 * math.pi, "keep_": (unit(4) * 3).cast("int") + 1})
    axes = ["x", "y", "z"]
    swapped = row.withColumns({f"s{i}": F.element_at(F.array(*(F.col(axes[o[i]]) for o in orders)), F.col("pick_") + 1) for i in range(3)})
    flat = F.sqrt(1 - F.col("u_") * F.col("u_"))
    turn = swapped.withColumns({"a0": flat * F.cos("v_"), "a1": flat * F.sin("v_"), "a2": F.col("u_"), "c_": F.cos("angle_"), "n_": F.sin("angle_")})

    def turned(i: int) -> Column:
        j, k = (i + 1) % 3, (i + 2) % 3
        a = [F.col(f"a{m}") for m in range(3)]
        dot = lambda p: a[0] * p["s0"] + a[1] * p["s1"] + a[2] * p["s2"]
        return F.transform(F.arrays_zip("s0", "s1", "s2"), lambda p: p[f"s{i}"] * F.col("c_") + (a[j] * p[f"s{k}"] - a[k] * p[f"s{j}"]) * F.col("n_") + a[i] * dot(p) * (1 - F.col("c_")))

    def thinned(values: Column) -> Column:
        return F.transform(values, lambda v, i: F.try_element_at(values, (i - i % F.col("keep_") + 1).cast("int")) + (F.coalesce(F.try_element_at(values, (i - i % F.col("keep_") + F.col("keep_") + 1).cast("int")), F.try_element_at(values, (i - i % F.col("keep_") + 1).cast("int"))) - F.try_element_at(values, (i - i % F.col("keep_") + 1).cast("int"))) * (i % F.col("keep_")) / F.col("keep_"))

    made = turn.withColumns({f"t{i}": turned(i) for i in range(3)})
    return made.withColumns({c: thinned(F.col(f"t{i}")) for i, c in enumerate(axes)}).select(windows.columns)


def subsample(df: DataFrame, key: str, keep: int, of: int) -> DataFrame:
    """Whole keys, `keep` of every `of` by hash: the same ones in every run."""
    return df.where(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(of)) < keep)


def mask_imputed(df: DataFrame, filled: str, raw: str, zero: bool = False) -> Column:
    """A filled column where the raw one has a value; elsewhere null, or 0."""
    return F.when(F.col(raw).isNotNull(), F.col(filled)).otherwise(F.lit(0.0) if zero else F.lit(None).cast("double"))


def drop_ambiguous_hours(df: DataFrame, zone: str) -> DataFrame:
    """Rows of UTC times (us) with local_us, without the local hours that the end of summer time repeats."""
    local = lambda c: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(c), zone))
    here = df.withColumn("local_us", local(F.col("us")))
    shift = lambda by: local(F.col("us") + by) - (F.col("us") + by)
    own = F.col("local_us") - F.col("us")
    return here.where(~((shift(HOUR) < own) | (shift(-HOUR) > own)))
