"""Centroid clustering of whole vectors, with exact integer arithmetic, sped up by geometric drift tightening.

Vectors with exactly `dims` components, none null or non-finite, take part; others (and null ones) give no row. Each component x becomes floor(scale * x), held within
+-LIMIT so that squared distances fit in 64 bits. Centroids start as the `k` vectors whose hash of seed and id is smallest (ties of repeated ids by components, null ids last); with fewer vectors
there are as many centroids, with none no rows. Each round assigns vectors to the nearest centroid (ties: smaller number) and moves every non-empty centroid to the
componentwise floor of its vectors' mean. Equal rows give equal rows.

A vector carries an upper bound of the distance to its centroid and a lower bound of that to any other. When centroids move, the lower bound gives way by less than the full drift: all vectors of
a cluster lie in a sphere about its old centroid, and seen in the plane of the sphere's centre and a moved centroid's old and new place, the distance to it can shrink
by at most drift * cos(angle), where the angle is that between the move and the sphere's tangent through the move's midpoint. Vectors whose bounds can't decide are scanned exactly.

A round is one pass over a stored table that holds vectors and bounds: it writes the next one, in which each task also leaves a row for each cluster with the sums, count and radius of
its vectors; these at most tasks * k rows are summed by Spark, and k rows reach the driver. Nothing is shuffled but those. Only vec_id and embedding are read, so extra
columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, release, stored

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Largest component after scaling, in absolute value: 64 squared differences of such still fit in 64 bits.
LIMIT = 1 << 27
#: Components up to this give squared distances below 2**53, which are exact in double precision.
EXACT = 1 << 21
#: Bounds are kept this much looser (relative), far above the rounding of square roots and cosines.
SLACK = 1e-9
STATE = "vec_id {id}, v array<int>, cluster int, upper double, lower double, total array<long>, members long, radius double, scanned long"


def prepared(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the vectors that take part, in integers."""
    sound = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))).cast("int"))
    return vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", whole.alias("v"))


def seeds(points: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The first centroids: the k vectors of smallest hash, in its order."""
    hashed = points.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = hashed.orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in first], np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of every row of x to every centroid."""
    if not len(x):
        return np.zeros((0, len(c)), np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) <= EXACT:
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - row) ** 2).sum(1) for row in c], 1)


def shrink(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much the distance from a point of the sphere to each of the moved centroids can shrink at most. old, new: (n, dims).

    Points to which the distance shrinks by more than 2a lie within a hyperbola's branch about the new place, so within its asymptotes' wedge, which opens at the midpoint of old
    and new place with the angle acos(a / half the drift). A sphere that the wedge doesn't meet can't shrink by so much; the widest wedge that only touches it gives the bound.
    """
    move = new - old
    drift = np.sqrt((move**2).sum(1))
    to = centre - (old + new) / 2
    rho = np.sqrt((to**2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip((to * move).sum(1) / (rho * drift), -1, 1)) - np.arcsin(np.clip(radius / rho, 0, 1))
        bound = np.where((rho > radius) & (angle > 0), drift * np.clip(np.cos(angle), 0, 1), drift)
    return np.where(drift > 0, bound * (1 + SLACK) + SLACK, 0.0)


@dataclass
class Moved:
    """What a pass must know: centroids now, and for each cluster how far its own moved, by how much lower bounds give way, and half the way to the nearest other centroid."""

    now: np.ndarray
    drift: np.ndarray
    loosened: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, old: np.ndarray, now: np.ndarray, radius: np.ndarray) -> Moved:
        k, f, g = len(now), old.astype(np.float64), now.astype(np.float64)
        loosened, half = np.zeros(k), np.full(k, np.inf)
        for i in range(k):
            others = np.arange(k) != i
            if k > 1:
                loosened[i] = shrink(f[i], radius[i], f[others], g[others]).max()
                half[i] = np.sqrt(distances(now[i : i + 1], now[others]).min()) / 2
        return cls(now, np.sqrt(((f - g) ** 2).sum(1)), loosened, half)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: Moved) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper, lower after the move, and which vectors were scanned. cluster -1: not assigned yet."""
    fresh = cluster < 0
    own = np.where(fresh, 0, cluster)
    upper = np.where(fresh, np.inf, (upper + moved.drift[own]) * (1 + SLACK) + SLACK)
    lower = np.where(fresh, 0.0, lower - moved.loosened[own])
    safe = np.maximum(lower, moved.half[own] * (1 - SLACK) - SLACK)
    open_ = np.flatnonzero(~(upper < safe))
    if len(open_):  # first the exact distance to the own centroid
        some = x[open_].astype(np.int64) - moved.now[own[open_]]
        upper[open_] = np.sqrt((some**2).sum(1).astype(np.float64)) * (1 + SLACK)
    scan = np.flatnonzero(~(upper < safe) | fresh)
    cluster = own.copy()
    if len(scan):
        d = distances(x[scan], moved.now)
        best = d.argmin(1)  # the first of equals
        rows = np.arange(len(scan))
        cluster[scan], upper[scan] = best, np.sqrt(d[rows, best].astype(np.float64)) * (1 + SLACK)
        d[rows, best] = np.iinfo(np.int64).max
        lower[scan] = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK) if d.shape[1] > 1 else np.inf
    return cluster, upper, lower, scan


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def passed(state: DataFrame, moved: Moved, dims: int) -> DataFrame:
    """The next state: vectors with new bounds, and a row of sums for each cluster from each task."""
    k, kind = len(moved.now), dict(state.dtypes)["vec_id"]
    schema = STATE.format(id=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, members, radius, scanned = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k), np.zeros(k, np.int64)
        names, ids = ["vec_id", "v", "cluster", "upper", "lower", "total", "members", "radius", "scanned"], None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("v"), dims)
            ids = batch.column("vec_id").type
            cluster, upper, lower, scan = assign(x, *(batch.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "upper", "lower")), moved)
            order = np.argsort(cluster, kind="stable")
            held, first = np.unique(cluster[order], return_index=True)
            total[held] += np.add.reduceat(x[order].astype(np.int64), first)
            members += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, upper)
            scanned += np.bincount(cluster[scan], minlength=k)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64())], names)
        if ids is not None:
            sums = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * dims, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.nulls(k, ids), pa.nulls(k, pa.list_(pa.int32())), pa.array(np.arange(k), pa.int32()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), sums, pa.array(members), pa.array(radius), pa.array(scanned)], names)
        release()

    return state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, schema)


def floors(state: DataFrame, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The centroids after a pass, each cluster's radius about its old one, and how many vectors were scanned."""
    k, dims = old.shape
    sums = state.where("v is null").groupBy("cluster").agg(F.sum("members").alias("n"), F.max("radius").alias("radius"), F.sum("scanned").alias("scanned"), F.array(*[F.sum(F.col("total")[d]) for d in range(dims)]).alias("total"))
    new, radius, scanned = old.copy(), np.zeros(k), 0
    for r in sums.collect():  # k rows
        radius[r["cluster"]], scanned = r["radius"], scanned + r["scanned"]
        if r["n"]:
            new[r["cluster"]] = np.array(r["total"], np.int64) // r["n"]
    return new, radius, scanned


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Assigned vectors (vec_id, v, cluster, distance; stored), the final centroids, and how many vectors each round scanned."""
    points = prepared(vectors, dims, scale)
    kind = dict(points.dtypes)["vec_id"]
    state = stored(points.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")), "vectors")
    now = seeds(state, k, seed)
    if not len(now):
        return state.select("vec_id", "v", "cluster", F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64), []
    moved, scans = Moved.of(now, now, np.zeros(len(now))), []
    for _ in range(rounds):
        after = stored(passed(state, moved, dims), "rounds")
        drop_stored(state)
        new, radius, scanned = floors(after, now)
        scans.append(scanned)
        state, moved, now = after.where("v is not null"), Moved.of(now, new, radius), new

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column("v"), dims)
                own, *_ = assign(x, *(batch.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "upper", "lower")), moved)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(((x.astype(np.int64) - now[own]) ** 2).sum(1))], ["vec_id", "v", "cluster", "distance"])

    out = stored(state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(last, f"vec_id {kind}, v array<int>, cluster int, distance long"), "clustered")
    drop_stored(state)
    return out, now, scans


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part. Sums beyond 64 bits are given as the largest 64-bit number."""
    out, centroids, _ = cluster(vectors)
    spark = vectors.sparkSession
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    fit = lambda c: F.least(c, most).cast("long")
    each = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    whole = each.agg(F.sum("own").alias("all"))
    shas = spark.createDataFrame(names, "number int, centroid_sha256 string")
    rows = each.join(F.broadcast(shas), F.col("cluster") == F.col("number")).crossJoin(F.broadcast(whole))  # one row
    rows = rows.select(F.col("cluster").alias("number"), fit(F.col("own")).alias("cluster_inertia"), fit(F.col("all")).alias("inertia"), "centroid_sha256")
    return out.join(F.broadcast(rows), F.col("cluster") == F.col("number")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def digest_sql(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL for the rows of digest(): every vector against every centroid, round by round."""
    gap = "list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v)"
    parts = [f"""p as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)) as v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = {dims})""", f"""c0 as (select (row_number() over (order by h, v) - 1)::int as c, v from (select sha256('{seed}:' || vec_id) as h, v from p order by h, v limit {k}))"""]
    for n in range(rounds + 1):
        parts.append(f"a{n} as (select r, any_value(vec_id) as vec_id, any_value(p.v) as v, min(({gap}, c)) as m from p, c{n} c group by r)")
        if n < rounds:
            parts.append(f"s{n} as (select c, i, (sum(x::bigint) - ((sum(x::bigint) % count(*)) + count(*)) % count(*)) // count(*) as x from (select m[2] as c, unnest(range(1, {dims + 1})) as i, unnest(v) as x from a{n}) group by c, i)")
            parts.append(f"c{n + 1} as (select c.c, coalesce(any_value(s.v), any_value(c.v)) as v from c{n} c left join (select c, list(x::double order by i) as v from s{n} group by c) s on s.c = c.c group by c.c)")
    return f"""with {", ".join(parts)},
d as (select vec_id, m[2]::int as cluster, m[1]::bigint as distance from a{rounds})
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: x::bigint), ',')) as centroid_sha256
from d join c{rounds} c on c.c = cluster"""
