"""A residual one-dimensional convolutional network over windows of three axes: batched scoring, and training with gradients summed over partitions.

Blocks are pre-activated (scale and shift, rectifier, convolution, twice) with a skip; stages end in average pooling; the mean over time feeds one hidden layer and the logits. Convolutions are one matrix product
over unfolded windows. Scale and shift are trained like all else and no batch statistics are kept, so a window's result hangs on that window alone.

Training: each step is a pass over one stored batch of windows (dealt by hash), whose partitions each give one gradient; these are summed in a tree whose order is that of the partitions, so a lost
executor changes nothing. Adam with the largest second moment (AMSGrad), loss weighted by class, early stop on subjects held out, a checkpoint in the folder after each epoch from which a stopped run goes on.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake import session
from kinelake.operators import fit, score

Weights = dict[str, np.ndarray]
#: Rows of a gradient tree's node.
FAN = 32


@dataclass(frozen=True)
class Shape:
    """widths: channels of each stage; depth: its blocks; pool: how many samples one becomes after it; hidden: of the last layer but one."""

    labels: tuple[str, ...]
    widths: tuple[int, ...] = (16, 32, 64)
    depth: int = 1
    kernel: int = 5
    pool: int = 3
    hidden: int = 64


def sizes(shape: Shape) -> dict[str, tuple[int, ...]]:
    """The shape of every weight, by name."""
    k, n = shape.kernel, len(shape.labels)
    out, last = {"stem.w": (3 * k, shape.widths[0]), "stem.b": (shape.widths[0],)}, shape.widths[0]
    for s, width in enumerate(shape.widths):
        for d in range(shape.depth):
            name = f"{s}.{d}"
            out |= {f"{name}.g1": (last,), f"{name}.c1": (last,), f"{name}.w1": (last * k, width), f"{name}.b1": (width,), f"{name}.g2": (width,), f"{name}.c2": (width,), f"{name}.w2": (width * k, width), f"{name}.b2": (width,)}
            if last != width:
                out[f"{name}.skip"] = (last, width)
            last = width
    return out | {"hidden.w": (last, shape.hidden), "hidden.b": (shape.hidden,), "out.w": (shape.hidden, n), "out.b": (n,)}


def start(shape: Shape, seed: int = 42) -> Weights:
    rng, out = np.random.default_rng(seed), {}
    for name, size in sizes(shape).items():
        kind = name.rsplit(".", 1)[1][0]
        out[name] = np.ones(size) if kind == "g" else np.zeros(size) if kind in "bc" else rng.normal(0, math.sqrt(2 / size[0]), size)
    return out


def _unfold(x: np.ndarray, k: int) -> np.ndarray:
    """(n, samples, channels * k): each sample's neighbourhood, zeros beyond the ends."""
    wide = np.pad(x, ((0, 0), (k // 2, k - 1 - k // 2), (0, 0)))
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, k, axis=1)).reshape(*x.shape[:2], -1)


def _fold(g: np.ndarray, channels: int, k: int) -> np.ndarray:
    """The gradient of _unfold."""
    n, length, _ = g.shape
    wide, parts = np.zeros((n, length + k - 1, channels), g.dtype), g.reshape(n, length, channels, k)
    for i in range(k):
        wide[:, i : i + length] += parts[..., i]
    return wide[:, k // 2 : k // 2 + length]


def forward(w: Weights, shape: Shape, x: np.ndarray, tape: list | None = None) -> np.ndarray:
    """Logits of windows (n, 3, samples). tape: takes what backward needs."""
    keep = tape.append if tape is not None else lambda _: None
    h = x.transpose(0, 2, 1).astype(w["stem.w"].dtype)

    def conv(v, name, weight, bias):
        cols = _unfold(v, shape.kernel)
        keep(("conv", name + weight, name + bias, cols, v.shape[2]))
        return cols @ w[name + weight] + w[name + bias]

    def active(v, name, gain, shift):
        out = v * w[name + gain] + w[name + shift]
        keep(("active", name + gain, name + shift, v, out > 0))
        return np.maximum(out, 0)

    h = conv(h, "stem.", "w", "b")
    for s in range(len(shape.widths)):
        for d in range(shape.depth):
            name = f"{s}.{d}."
            keep(("branch", name + "skip" if name + "skip" in w else None, h))
            v = conv(active(h, name, "g1", "c1"), name, "w1", "b1")
            v = conv(active(v, name, "g2", "c2"), name, "w2", "b2")
            h = v + (h @ w[name + "skip"] if name + "skip" in w else h)
            keep(("join",))
        n, length, width = h.shape
        if length >= shape.pool > 1:
            whole = length // shape.pool
            h = h[:, : whole * shape.pool].reshape(n, whole, shape.pool, width).mean(2)
            keep(("pool", length))
    keep(("mean", h.shape[1]))
    m = h.mean(1)
    u = m @ w["hidden.w"] + w["hidden.b"]
    keep(("dense", m, u))
    return np.maximum(u, 0) @ w["out.w"] + w["out.b"]


def backward(w: Weights, shape: Shape, tape: list, d: np.ndarray) -> Weights:
    """Gradients of every weight; d: that of the logits."""
    out, joins = {}, []
    for op in reversed(tape):
        if op[0] == "dense":
            _, m, u = op
            out["out.w"], out["out.b"] = np.maximum(u, 0).T @ d, d.sum(0)
            d = (d @ w["out.w"].T) * (u > 0)
            out["hidden.w"], out["hidden.b"] = m.T @ d, d.sum(0)
            d = d @ w["hidden.w"].T
        elif op[0] == "mean":
            d = np.repeat(d[:, None] / op[1], op[1], 1)
        elif op[0] == "pool":
            wide = np.repeat(d / shape.pool, shape.pool, 1)
            d = np.concatenate([wide, np.zeros((len(d), op[1] - wide.shape[1], d.shape[2]))], 1)
        elif op[0] == "conv":
            _, weight, bias, cols, channels = op
            out[weight], out[bias] = np.tensordot(cols, d, ((0, 1), (0, 1))), d.sum((0, 1))
            d = _fold(d @ w[weight].T, channels, shape.kernel)
        elif op[0] == "active":
            _, gain, shift, v, on = op
            d = d * on
            out[gain], out[shift] = (d * v).sum((0, 1)), d.sum((0, 1))
            d = d * w[gain]
        elif op[0] == "join":
            joins.append(d)
        else:
            _, skip, h = op
            side = joins.pop()
            if skip:
                out[skip] = np.tensordot(h, side, ((0, 1), (0, 1)))
                side = side @ w[skip].T
            d = d + side
    return out


def loss(logits: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed weighted cross-entropy and its gradient."""
    high = logits - logits.max(1, keepdims=True)
    total, rows, own = np.log(np.exp(high).sum(1)), np.arange(len(code)), weight[code]
    d = np.exp(high - total[:, None]) * own[:, None]
    d[rows, code] -= own
    return float(((total - high[rows, code]) * own).sum()), d


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def shaped(vector: np.ndarray, shape: Shape) -> Weights:
    out, at, size = {}, 0, sizes(shape)
    for k in sorted(size):
        n = math.prod(size[k])
        out[k], at = vector[at : at + n].reshape(size[k]), at + n
    return out


def arrays(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, (n, 3, samples)) for each length of the batch's windows."""
    size = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
    return [(at, np.stack([batch.column(c).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n) for c in "xyz"], 1)) for n in np.unique(size).tolist() for at in [np.flatnonzero(size == n)]]


def gradient(df: DataFrame, w: Weights, shape: Shape, weight: np.ndarray, back: bool = True, batch: int = 512) -> tuple[np.ndarray, float, float]:
    """Summed gradient (empty without `back`), loss and class weight of all rows (x, y, z arrays, code). Rows of partitions are summed FAN at a time, in their order, by the executors until FAN are left."""
    vector = flat(w)

    def run(batches):
        own, total, mass = np.zeros(len(vector) if back else 0), 0.0, 0.0
        now = shaped(vector, shape)
        for part in batches:
            code = part.column("code").to_numpy(zero_copy_only=False)
            for at, x in arrays(part) if part.num_rows else ():
                for lo in range(0, len(at), batch):
                    some, tape = at[lo : lo + batch], [] if back else None
                    value, d = loss(forward(now, shape, x[lo : lo + batch], tape), code[some], weight)
                    total, mass = total + value, mass + float(weight[code[some]].sum())
                    if back:
                        own += flat(backward(now, shape, tape, d))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([own.tobytes()], pa.binary()), pa.array([total]), pa.array([mass])], ["part", "own", "total", "mass"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        own = np.zeros(len(vector) if back else 0)
        for r in rows["own"]:
            own += np.frombuffer(r)
        return pd.DataFrame({"part": [rows["part"].iloc[0] // FAN], "own": [own.tobytes()], "total": [math.fsum(rows["total"])], "mass": [math.fsum(rows["mass"])]})

    schema, parts = "part long, own binary, total double, mass double", df.rdd.getNumPartitions()
    made = df.select("x", "y", "z", "code").mapInArrow(run, schema)
    while parts > FAN:
        made, parts = made.groupBy(F.floor(F.col("part") / FAN).alias("g_")).applyInPandas(add, schema), -(-parts // FAN)
    rows = made.toPandas().sort_values("part")  # FAN rows of a gradient's size at most
    own = np.zeros(len(vector) if back else 0)
    for r in rows["own"]:
        own += np.frombuffer(r)
    return own, math.fsum(rows["total"]), math.fsum(rows["mass"])


@dataclass
class Adam:
    """Adam that divides by the largest second moment so far."""

    mean: np.ndarray
    square: np.ndarray
    most: np.ndarray
    steps: int = 0

    def step(self, at: np.ndarray, g: np.ndarray, rate: float, a: float = 0.9, b: float = 0.999) -> np.ndarray:
        self.steps += 1
        self.mean, self.square = a * self.mean + (1 - a) * g, b * self.square + (1 - b) * g * g
        self.most = np.maximum(self.most, self.square)
        return at - rate * (self.mean / (1 - a**self.steps)) / (np.sqrt(self.most / (1 - b**self.steps)) + 1e-8)


def save(spark: SparkSession, w: Weights, shape: Shape, path: str, more: dict[str, np.ndarray] | None = None, state: dict | None = None) -> None:
    """Weights (and other vectors) as Parquet rows name, shape, values; the network's shape and any state are a row of JSON."""
    rows = [(k, list(v.shape), [float(x) for x in v.ravel()], None) for k, v in (w | (more or {})).items()] + [("", [], [], json.dumps({"shape": asdict(shape), "state": state or {}}))]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>, json string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[Weights, Shape, dict[str, np.ndarray], dict]:
    """What save wrote: weights, shape, other vectors, state."""
    rows = {r["name"]: r for r in spark.read.parquet(path).collect()}  # a row a weight
    head = json.loads(rows.pop("")["json"])
    shape = Shape(**{k: tuple(v) if isinstance(v, list) else v for k, v in head["shape"].items()})
    made = {k: np.array(r["values"]).reshape(r["shape"]) for k, r in rows.items()}
    own = sizes(shape)
    return {k: v for k, v in made.items() if k in own}, shape, {k: v for k, v in made.items() if k not in own}, head["state"]


def scorer(w: Weights, shape: Shape, batch: int = 512) -> Callable[[DataFrame], DataFrame]:
    """A scorer of windows (score.array_scorer) with these weights, in single precision."""
    light = {k: v.astype(np.float32) for k, v in w.items()}
    return score.array_scorer(lambda: lambda x: forward(light, shape, x), list(shape.labels), batch)


@score.scorer("network")
def _network(path: str | None):
    if not path:
        raise ValueError("a network needs the path of saved weights")
    w, shape, *_ = load(SparkSession.active(), path)
    return scorer(w, shape)


def train(windows: DataFrame, shape: Shape, folder: str, epochs: int = 20, batches: int = 4, rate: float = 1e-3, patience: int = 5, seed: int = 42, percent: int = 20) -> tuple[Weights, list[tuple[float, float]]]:
    """The weights of the epoch with the least held-out loss, and (training, held-out) loss of each epoch. windows: subject_id, idx, x, y, z arrays, label; those without a label of the shape or with a missing value are left out.
    Classes weigh the inverse of their share of the training rows. A folder with checkpoints goes on from the last."""
    spark, code = windows.sparkSession, F.array_position(F.array(*map(F.lit, shape.labels)), F.col("label")) - 1
    whole = F.col("x").isNotNull()
    for c in "xyz":
        whole &= F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False)) & (F.size(c) > 0)
    rows = windows.where(whole & F.col("label").isin(*shape.labels)).select("subject_id", "x", "y", "z", code.cast("int").alias("code"), F.pmod(F.xxhash64(F.lit(seed), "subject_id", "idx"), F.lit(batches)).cast("int").alias("batch"))
    kept, held = fit.split(rows, "subject_id", percent)
    path = session.scratch(spark, "training")
    kept.drop("subject_id").write.partitionBy("batch").parquet(path)
    kept, held = spark.read.parquet(path), session.kept(held.drop("subject_id", "batch"), "held")
    counts = {r["code"]: r["count"] for r in kept.groupBy("code").count().collect()}  # a row a class
    if not counts:
        raise ValueError("no window to train on")
    total = sum(counts.values())
    weight = np.array([total / (len(counts) * counts[k]) if k in counts else 0.0 for k in range(len(shape.labels))])
    w, size = start(shape, seed), sum(math.prod(s) for s in sizes(shape).values())
    adam, best, history, first = Adam(*(np.zeros(size) for _ in range(3))), w, [], 0
    try:
        found = spark.read.json(f"{folder}/epochs").orderBy(F.col("epoch").desc()).first()
    except Exception as e:  # no checkpoint yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    if found:
        w, _, more, state = load(spark, f"{folder}/weights-{found['epoch']}")
        adam, best = Adam(more["adam.mean"], more["adam.square"], more["adam.most"], state["steps"]), shaped(more["best"], shape)
        history, first = [tuple(x) for x in state["history"]], found["epoch"] + 1
    for epoch in range(first, epochs):
        seen = []
        for k in range(batches):
            g, value, mass = gradient(kept.where(F.col("batch") == k), w, shape, weight)
            if mass > 0:
                w = shaped(adam.step(flat(w), g / mass, rate), shape)
                seen.append(value / mass)
        _, value, mass = gradient(held, w, shape, weight, back=False)
        history.append((float(np.mean(seen)), value / mass if mass > 0 else float(np.mean(seen))))
        last = [h for _, h in history]
        if last[-1] <= min(last):
            best = w
        save(spark, w, shape, f"{folder}/weights-{epoch}", {"adam.mean": adam.mean, "adam.square": adam.square, "adam.most": adam.most, "best": flat(best)}, {"steps": adam.steps, "history": history})
        spark.range(1).select(F.lit(epoch).alias("epoch")).coalesce(1).write.mode("append").json(f"{folder}/epochs")  # after its weights, so one without the other is never read
        if len(last) - 1 - int(np.argmin(last)) >= patience:
            break
    save(spark, best, shape, f"{folder}/best")
    return best, history
