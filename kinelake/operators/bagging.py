"""A balanced random forest with out-of-bag votes, grown by histograms on the executors.

How often a tree draws a row is a Poisson number of mean (least class's rows / class's rows), read off a hash of seed, tree and the row's key: so every class weighs the same in a tree, bootstraps need no
state, and who drew a row can be told again at any time. Features are cut into bins at quantiles. A level of all trees is one pass: each task counts (tree, node, feature, bin, class), Spark sums
the counts, and each node's best split by Gini impurity is chosen in a group of its own, whose size hangs on bins and classes alone. Only splits and leaves, the model, reach the driver. Votes for a row
come from the trees that never drew it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake import session

#: Largest number of times that a tree draws one row.
MOST_DRAWS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: all bits of the input reach all of the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def draws(key: np.ndarray, tree: int, seed: int, mean: np.ndarray) -> np.ndarray:
    """How often the tree draws each row (key: 64-bit): Poisson by the hash's place in the cumulated distribution."""
    u = _mix(_mix(key.astype(np.int64).view(np.uint64) + np.uint64(seed)) + np.uint64(tree)) / 2.0**64
    out, term, below = np.zeros(len(key), np.int64), np.exp(-mean), np.exp(-mean)
    for k in range(1, MOST_DRAWS + 1):
        out += u >= below
        term = term * mean / k
        below = below + term
    return out


def offered(tree: int, node: int, features: int, take: int, seed: int) -> np.ndarray:
    """The features that a node may split on."""
    h = _mix(np.arange(features, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003) + _mix(np.array([tree * (1 << 40) + node], np.uint64)))
    return np.sort(np.argsort(h, kind="stable")[:take])


@dataclass
class Forest:
    """trees: for each a dict node -> (feature, bin) for splits; leaves: for each a dict node -> class shares. Node n has children 2n+1 (bin at most the split's) and 2n+2."""

    labels: list[str]
    features: list[str]
    edges: list[list[float]]
    means: list[float]
    seed: int
    splits: list[dict[int, tuple[int, int]]]
    leaves: list[dict[int, list[float]]]

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, k], "left") for k, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(values), 0), int)

    def nodes(self, bins: np.ndarray, tree: int, depth: int) -> np.ndarray:
        """The node that each row reaches within `depth` splits."""
        at, own = np.zeros(len(bins), np.int64), self.splits[tree]
        for _ in range(depth):
            for n in np.unique(at).tolist():
                if n in own:
                    f, b = own[n]
                    rows = at == n
                    at[rows] = 2 * n + 1 + (bins[rows, f] > b)
        return at

    def votes(self, bins: np.ndarray, tree: int, depth: int) -> np.ndarray:
        at = self.nodes(bins, tree, depth)
        held, back = np.unique(at, return_inverse=True)
        return np.array([self.leaves[tree][n] for n in held.tolist()])[back]

    @property
    def depth(self) -> int:
        return max((n + 1).bit_length() for own in self.leaves for n in own)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> Forest:
        d = json.loads(text)
        return cls(**d | {"splits": [{int(k): tuple(v) for k, v in t.items()} for t in d["splits"]], "leaves": [{int(k): v for k, v in t.items()} for t in d["leaves"]]})


def _values(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([batch.column(f"f{k}").to_numpy(zero_copy_only=False) for k in range(len(features))], 1).astype(float)


def _prepared(df: DataFrame, features: list[str], labels: list[str] | None, label: str | None, key: list[str]) -> DataFrame:
    code = (F.array_position(F.array(*map(F.lit, labels)), F.col(label).cast("string")) - 1).cast("int") if label else F.lit(-1)
    whole = F.lit(True)
    for c in features:
        whole &= F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))
    return df.where(whole).select(F.xxhash64(*key).alias("key"), code.alias("code"), *(F.col(f"`{c}`").cast("double").alias(f"f{k}") for k, c in enumerate(features)))


def fit(df: DataFrame, features: list[str], label: str, key: list[str], trees: int = 50, depth: int = 8, bins: int = 32, seed: int = 42, least: int = 2, take: int | None = None) -> Forest:
    """A forest over rows with a label and all features. key: columns that tell rows apart (their hash fixes who draws them). least: draws that a node needs to split; take: features offered to a node (their root)."""
    labels = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().collect())  # a row a class
    if not labels:
        raise ValueError("no labelled rows")
    rows = session.kept(_prepared(df.where(F.col(label).isNotNull()), features, labels, label, key), "forest")
    counts = {r["code"]: r["count"] for r in rows.groupBy("code").count().collect()}
    if not counts:
        raise ValueError("no row has all features")
    means = [min(counts.values()) / counts[k] if k in counts else 0.0 for k in range(len(labels))]
    cuts = rows.select(*(F.percentile_approx(f"f{k}", F.array(*(F.lit(i / bins) for i in range(1, bins))), F.lit(10_000)).alias(f"f{k}") for k in range(len(features)))).first()
    edges = [sorted({float(x) for x in cuts[f"f{k}"]}) for k in range(len(features))]
    model = Forest(labels, list(features), edges, means, seed, [{} for _ in range(trees)], [{} for _ in range(trees)])
    take, n = take or max(1, int(np.sqrt(len(features)))), len(labels)
    open_ = {t: {0} for t in range(trees)}
    for level in range(depth + 1):
        grown, now = model, {t: o for t, o in open_.items() if o}
        if not now:
            break

        def count(batches, grown=grown, now=now, level=level):
            mean = np.array(grown.means)
            for batch in batches:
                if not batch.num_rows:
                    continue
                binned, code, key_ = grown.bins(_values(batch, features)), batch.column("code").to_numpy(), batch.column("key").to_numpy()
                out = []
                for t, nodes in now.items():
                    drawn = draws(key_, t, seed, mean[code])
                    at = grown.nodes(binned, t, level)
                    for node in sorted(nodes):
                        mine = np.flatnonzero((at == node) & (drawn > 0))
                        for f in offered(t, node, len(features), take, seed).tolist() if len(mine) else ():
                            made = np.bincount(binned[mine, f] * n + code[mine], drawn[mine])
                            held = np.flatnonzero(made)
                            out.append((np.full(len(held), t), np.full(len(held), node), np.full(len(held), f), held // n, held % n, made[held].astype(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["tree", "node", "feature", "bin", "code", "n"])

        def best(part: pd.DataFrame) -> pd.DataFrame:
            t, node = int(part["tree"].iloc[0]), int(part["node"].iloc[0])
            first = part[part["feature"] == part["feature"].iloc[0]]
            total = np.bincount(first["code"], first["n"], n)
            choice = (0.0, -1, -1)
            if level < depth and total.sum() >= least and (total > 0).sum() > 1:
                impurity = lambda c: c.sum(-1) - (c**2).sum(-1) / np.maximum(c.sum(-1), 1)
                for f, own in sorted(part.groupby("feature"), key=lambda x: x[0]):
                    table = np.zeros((int(own["bin"].max()) + 1, n))
                    table[own["bin"], own["code"]] = own["n"]
                    left = table.cumsum(0)[:-1]
                    gain = impurity(total[None])[0] - impurity(left) - impurity(total - left)
                    sound = (left.sum(1) > 0) & (left.sum(1) < total.sum())
                    if sound.any():
                        k = int(np.where(sound, gain, -1).argmax())
                        if gain[k] > choice[0] + 1e-12:
                            choice = (float(gain[k]), int(f), k)
            return pd.DataFrame({"tree": [t], "node": [node], "feature": [choice[1]], "bin": [choice[2]], "shares": [list(map(float, total / total.sum()))]})

        summed = rows.mapInArrow(count, "tree long, node long, feature long, bin long, code long, n long").groupBy("tree", "node", "feature", "bin", "code").agg(F.sum("n").alias("n"))
        made = summed.groupBy("tree", "node").applyInPandas(best, "tree long, node long, feature long, bin long, shares array<double>").collect()  # the model's nodes of a level
        open_ = {t: set() for t in range(trees)}
        for r in sorted(made, key=lambda r: (r["tree"], r["node"])):
            t, node = r["tree"], r["node"]
            model.leaves[t][node] = list(r["shares"])
            if r["feature"] >= 0:
                model.splits[t][node] = (r["feature"], r["bin"])
                open_[t] |= {2 * node + 1, 2 * node + 2}
    for t in range(trees):  # a tree that drew no row votes for none
        model.leaves[t].setdefault(0, [1 / n] * n)
    return model


def predict(model: Forest, df: DataFrame, key: list[str], label: str | None = None, out: str = "label_pred", probability: str = "probability") -> DataFrame:
    """df with the predicted label (ties to the first) and the mean of the trees' class shares (labels in order). With `label`, rows are judged out of bag: only by trees that never drew them. Rows that lack a feature,
    and those that every tree drew, get nulls. Rows with equal keys get equal results; key, label and features must be the fit's."""
    depth, n = model.depth, len(model.labels)
    rows = _prepared(df, model.features, model.labels, label, key).distinct()

    def run(batches):
        means = np.array([*model.means, 0.0])  # a row without a known label (code -1) is drawn by none
        for batch in batches:
            if not batch.num_rows:
                continue
            binned, code, k = model.bins(_values(batch, model.features)), batch.column("code").to_numpy(zero_copy_only=False), batch.column("key").to_numpy()
            code = np.where(np.isnan(code.astype(float)), -1, code).astype(int)
            total, seen = np.zeros((len(k), n)), np.zeros(len(k), np.int64)
            for t in range(len(model.splits)):
                out_of = draws(k, t, model.seed, means[code]) == 0 if label else np.ones(len(k), bool)
                if out_of.any():
                    total[out_of] += model.votes(binned[out_of], t, depth)
                    seen += out_of
            share = total / np.maximum(seen, 1)[:, None]
            pick = [model.labels[i] if s else None for i, s in zip(share.argmax(1).tolist(), seen.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(pick, pa.string()), pa.array([r if s else None for r, s in zip(share.tolist(), seen.tolist(), strict=True)], pa.list_(pa.float64())), pa.array(seen)], ["key_", out, probability, "trees"])

    made = rows.mapInArrow(run, f"key_ long, {out} string, {probability} array<double>, trees long").dropDuplicates(["key_"])
    return df.withColumn("own_", F.xxhash64(*key)).join(made, F.col("own_") == F.col("key_"), "left").drop("own_", "key_")


def save(spark: SparkSession, model: Forest, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "json string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Forest:
    return Forest.from_json(spark.read.parquet(path).first()["json"])
