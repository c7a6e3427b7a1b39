"""Approximate nearest neighbours by collision counting (query-aware hashing: Huang et al. 2015).

Rows are dealt into blocks by a hash of their id, so that equal vectors spread. Each block has one sorted array for each of
PROJECTIONS random lines. Around a query's own projection a window opens on every line and widens by the factor WIDEN, which
is virtual rehashing: nothing is hashed anew. Each row counts the windows that hold it; rows that collide on
THRESHOLD of the lines are verified by their true distance, until VERIFY of the block's rows are. The best of all
blocks are merged. A block is built once for each GROUP_QUERIES queries and those queries come to it, so that with n rows of which q ask,
n * ceil(q / GROUP_QUERIES) + q * blocks vectors are shuffled; blocks grow with the rows up to BLOCK_MOST.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id; vectors are compared with
those of their own dimension. Rows that share id and vector count once. Rows that share an id with different vectors are candidates of
their own, and each that asks gets results of its own, under the one query_id. A query's own id is no candidate of it. Distances are
Euclidean in double precision on the original vectors, ties go to smaller ids. Only vec_id, the vector column and what `queries` names are
read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import gather

PROJECTIONS, THRESHOLD, WIDEN, FIRST = 64, 0.8, 1.05, 0.2
#: Share of a block's rows, and rows at least, that are verified.
VERIFY, VERIFY_LEAST = 0.1, 64
#: Rows of a block at least and at most, blocks to have before they grow, and queries that meet a block at once.
BLOCK_LEAST, BLOCK_MOST, BLOCKS, GROUP_QUERIES = 8192, 65_536, 64, 32_768


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def distinct(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, keys and vectors (double) of a group's rows in the order of ids; rows of one id and key once."""
    ids, keys = (part.column(c).to_numpy() for c in ("vec_id", "key"))
    flat = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    order = np.lexsort((keys, ids))
    order = order[np.r_[True, (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])]]
    return ids[order], keys[order], flat.reshape(len(ids), -1)[order]


class Block:
    """Sorted arrays of a block's projections, one after another."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, dim = ids, vectors, vectors.shape[1]
        rng, lines = np.random.default_rng(dim), []
        for _ in range(-(-PROJECTIONS // dim)):  # random directions, orthogonal as far as the dimension allows
            lines.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0])
        self.lines = np.concatenate(lines, axis=1)[:, :PROJECTIONS]
        shadow = vectors @ self.lines
        order = np.argsort(shadow, axis=0, kind="stable")
        self.spread = max(float(shadow.std()), 1e-12)
        self.apart = np.arange(PROJECTIONS) * (4 * float(np.abs(shadow).max()) + 1e3 * self.spread)
        self.order, self.sorted = order.T.astype(np.int32).ravel(), (np.take_along_axis(shadow, order, 0) + self.apart).T.ravel()
        self.most = float(np.abs(shadow).max())

    def nearest(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
        """The k nearest found, ties to smaller ids."""
        n, centre = len(self.ids), (query @ self.lines).clip(-2 * self.most, 2 * self.most) + self.apart
        lo = np.searchsorted(self.sorted, centre)
        hi, width, limit = lo, FIRST * self.spread, 4 * self.most + 2 * self.spread
        count, left_over = np.zeros(n, np.int64), np.ones(n, bool)
        found, scores, total, need = [], [], 0, min(n, max(VERIFY_LEAST, k + 1, int(VERIFY * n)))
        first = np.arange(PROJECTIONS) * n
        while total < need:
            left = np.maximum(np.searchsorted(self.sorted, centre - width, "left"), first)
            right = np.minimum(np.searchsorted(self.sorted, centre + width, "right"), first + n)
            fresh = gather(self.order, np.concatenate((left, hi)), np.concatenate((lo - left, right - hi)))
            count += np.bincount(fresh, minlength=n)
            lo, hi = left, right
            new = np.flatnonzero((count >= THRESHOLD * PROJECTIONS) & left_over)
            left_over[new] = False
            total += len(new)
            found.append(new)
            scores.append(np.sqrt(np.square(self.vectors[new] - query).sum(axis=1)))
            width = width * WIDEN if width < limit else float("inf")
        rows, score = np.concatenate(found), np.concatenate(scores)
        keep = self.ids[rows] != own
        rows, score = rows[keep], score[keep]
        best = np.lexsort((self.ids[rows], score))[:k]
        return list(zip(self.ids[rows[best]].tolist(), score[best].tolist(), strict=True))


def search(rows: DataFrame, queries: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of every row for which `queries` holds."""
    typed = F.col(vector) if dict(rows.dtypes)[vector] in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    good = rows.select("vec_id", typed.alias("vector"), queries.alias("asks")).where("vec_id is not null").where(usable(F.col("vector")))
    n, asks = good.agg(F.count("*"), F.count_if("asks")).first()
    blocks = max(1, round(n / min(BLOCK_MOST, max(BLOCK_LEAST, n // BLOCKS))))
    groups = max(1, -(-asks // GROUP_QUERIES))
    good = good.select(F.col("vec_id").cast("long"), F.size("vector").alias("dim"), F.xxhash64("vector").alias("key"), "vector", "asks")
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt = lambda salt, n, name: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int").alias(name)
    data = good.select("vec_id", "dim", "key", "vector", dealt(1, blocks, "block"), every("part", groups))
    asked = good.where("asks").select("vec_id", "dim", "key", "vector", every("block", blocks), dealt(2, groups, "part"))

    def meet(held: pa.Table, questions: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        if held.num_rows and questions.num_rows:
            ids, _, vectors = distinct(held)
            block = Block(ids, vectors)
            for own, key, query in zip(*distinct(questions), strict=True):
                for id_, score in block.nearest(query, own, k):
                    for column, x in zip(columns, (own, key, id_, score), strict=True):
                        column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "query_key", "vec_id", "score"])

    by = ["block", "part", "dim"]
    best = data.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(meet, "query_id long, query_key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
