"""Window classification: a threshold scorer, a forest, and the recording pipeline from samples to smoothed labels."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions.scalar import enmo
from kinelake.operators import epochs, sequence, spectral

#: The label schemes.
SCHEMES = {"four": ["light", "moderate-vigorous", "sedentary", "sleep"], "six": ["bicycling", "mixed", "sit-stand", "sleep", "vehicle", "walking"]}


def threshold_label(value: str, cuts: list[tuple[float, str]], top: str) -> F.Column:
    """The label of the first cut that a value is below, else `top`; null stays null."""
    out = F.lit(top)
    for limit, label in reversed(cuts):
        out = F.when(F.col(value) < limit, F.lit(label)).otherwise(out)
    return F.when(F.col(value).isNotNull(), out)


def windows(samples: DataFrame, epoch_s: float, rate: int | None = None, length: int | None = None) -> DataFrame:
    """subject_id, idx, epoch_us, n, x, y, z: fitted arrays of epoch_s * rate samples, resized to `length` if given; null arrays for windows with too few samples or a missing value. Without a rate the samples' column of that name has each subject's."""
    samples = samples if rate is None else samples.withColumn("rate", F.lit(rate))
    made = epochs.anchored(samples, epoch_s).groupBy("subject_id", "idx", "epoch_us").agg(F.count("*").alias("n"), F.max("rate").alias("rate"), F.sort_array(F.collect_list(F.struct("us", "x", "y", "z"))).alias("s"))
    size = F.floor(F.col("rate") * epoch_s).cast("int")
    out = made.select("subject_id", "idx", "epoch_us", "n", *(epochs.fit(F.col(f"s.{c}"), size).alias(c) for c in "xyz"))
    holes = F.exists("x", F.isnull) | F.exists("y", F.isnull) | F.exists("z", F.isnull)
    out = out.withColumn("whole_", ~holes).withColumns({c: F.when(F.col("whole_"), F.col(c)) for c in "xyz"}).drop("whole_")
    return out.withColumns({c: epochs.resize(F.col(c), length) for c in "xyz"}) if length else out


#: What `array_features` makes of a window.
FEATURES = ["enmoTrunc", "enmoAbs", "mean", "sd", "coefvariation", "median", "min", "max", "25thp", "75thp", "MAD", "MPD", "skew", "kurt", "autocorr", "xMean", "yMean", "zMean", "xRange", "yRange", "zRange", "xStd", "yStd", "zStd", "xyCov", "xzCov", "yzCov", "xyCorr", "xzCorr", "yzCorr", "f1", "p1", "f2", "p2", "totalPower", "entropy", "corrxy", "corrxz", "corryz", *spectral.MADE]
#: Samples that the kernels look at at once, so memory doesn't grow with a window's length.
SAMPLES = 1 << 20


def _features(v: np.ndarray, step_s: float) -> np.ndarray:
    """(windows, FEATURES) of (windows, samples, axes) in g; undefined is 0. Moments and quantiles are of the vector norm, f1, p1, f2, p2 the two strongest frequencies and their powers; corrxy is xyCorr under the forests' name. The rest is `spectral.features`."""
    n, r = v.shape[1], np.sqrt(np.square(v).sum(axis=2))
    mean, sd = r.mean(axis=1), r.std(axis=1, ddof=1 if n > 1 else 0)
    low, mid, high = np.quantile(r, [0.25, 0.5, 0.75], axis=1)
    rest = r - mean[:, None]
    spread = np.sqrt(np.square(rest).mean(axis=1))
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(b)), where=b > 1e-12)
    lag = max(1, min(n - 1, round(1 / step_s))) if n > 1 else 0
    autocorr = ratio((rest[:, lag:] * rest[:, : n - lag]).mean(axis=1), np.square(spread)) if n > 1 else np.zeros(len(r))
    flat = v - v.mean(axis=1, keepdims=True)
    std = v.std(axis=1, ddof=1 if n > 1 else 0)
    cov = {(i, j): (flat[:, :, i] * flat[:, :, j]).sum(axis=1) / max(1, n - 1) for i, j in ((0, 1), (0, 2), (1, 2))}
    power = np.square(np.abs(np.fft.rfft(rest, axis=1)))[:, 1:] / n if n > 1 else np.zeros((len(r), 1))
    order = np.argsort(-power, axis=1, kind="stable")
    second = order[:, min(1, order.shape[1] - 1)]
    row, total = np.arange(len(r)), power.sum(axis=1)
    share = power / np.maximum(total, 1e-300)[:, None]
    entropy = -(share * np.log(np.maximum(share, 1e-300))).sum(axis=1)
    hz = lambda k: (k + 1) / (n * step_s)
    columns = [
        np.maximum(r - 1, 0).mean(axis=1), np.abs(r - 1).mean(axis=1), mean, sd, ratio(sd, mean), mid, r.min(axis=1), r.max(axis=1), low, high, np.median(np.abs(r - mid[:, None]), axis=1), np.abs(np.diff(r, axis=1)).mean(axis=1) if n > 1 else 0 * mean,
        ratio((rest**3).mean(axis=1), spread**3), ratio((rest**4).mean(axis=1), spread**4) - 3 * (spread**4 > 1e-12), autocorr, *v.mean(axis=1).T, *np.ptp(v, axis=1).T, *std.T,
        *cov.values(), *(ratio(c, std[:, i] * std[:, j]) for (i, j), c in cov.items()), hz(order[:, 0]), power[row, order[:, 0]], hz(second), power[row, second], total, entropy,
    ]
    columns += [columns[FEATURES.index(c)] for c in ("xyCorr", "xzCorr", "yzCorr")]
    return np.column_stack((*columns, spectral.features(v, step_s)))


def array_features(df: DataFrame, step_s: float = 1 / 30) -> DataFrame:
    """Windows (arrays x, y, z) with a column for each of FEATURES, of a batch of windows of one length at a time; null where the arrays are, or hold a null."""
    df = df.drop(*FEATURES)

    def run(batches):
        for part in batches:
            arrays = [part.column(c) for c in "xyz"]
            size = np.where(part.column("x").is_valid().to_numpy(zero_copy_only=False), part.column("x").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            out = np.full((part.num_rows, len(FEATURES)), np.nan)
            for n in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == n)
                for some in np.array_split(at, -(-len(at) * n // SAMPLES)):
                    v = np.stack([a.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(some), n) for a in arrays], axis=2)
                    whole = np.isfinite(v).all(axis=(1, 2))
                    if whole.any():
                        out[some[whole]] = _features(v[whole], step_s)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, mask=np.isnan(c)) for c in out.T)], [*part.schema.names, *FEATURES])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{c}` double" for c in FEATURES)])
    return df.mapInArrow(run, schema)


def window_enmo(df: DataFrame) -> DataFrame:
    """df with acc: the mean ENMO of its arrays."""
    each = F.transform(F.arrays_zip("x", "y", "z"), lambda p: enmo(p["x"], p["y"], p["z"]))
    return df.withColumn("acc", F.when(F.col("x").isNotNull(), F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / F.size("x")))


def fit_forest(df: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 20, seed: int = 42) -> PipelineModel:
    """A balanced random forest over rows with label and all features: rows weigh the inverse of their class's share."""
    df = df.dropna(subset=[label, *features])
    share = df.groupBy(label).agg(F.count("*").alias("n_"))  # a row a class
    weighted = df.join(F.broadcast(share), label).withColumn("weight_", 1.0 / F.col("n_"))
    indexer = StringIndexer(inputCol=label, outputCol="code_", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(featuresCol="features_", labelCol="code_", weightCol="weight_", numTrees=trees, maxDepth=min(depth, 30), seed=seed, probabilityCol="probability_", rawPredictionCol="raw_", predictionCol="prediction_")
    return Pipeline(stages=[indexer, VectorAssembler(inputCols=features, outputCol="features_", handleInvalid="keep"), forest]).fit(weighted)


def predict_forest(model: PipelineModel, df: DataFrame, out: str = "label") -> DataFrame:
    """df with the predicted label and the class probabilities (array, labels in sorted order); rows that lack a feature stay, with nulls."""
    labels, needed = model.stages[0].labels, model.stages[1].getInputCols()
    made = PipelineModel(model.stages[1:]).transform(df)
    whole = F.lit(True)
    for c in needed:
        whole &= F.col(f"`{c}`").isNotNull()
    made = made.withColumns({out: F.when(whole, F.element_at(F.array(*map(F.lit, labels)), (F.col("prediction_") + 1).cast("int"))), "probability": F.when(whole, vector_to_array("probability_"))})
    return made.drop("features_", "raw_", "probability_", "prediction_")


#: Cut points of the mean intensity in mg for four classes.
CUTS = [(10.0, "sleep"), (35.0, "sedentary"), (100.0, "light")]
#: name -> (label scheme, maker of a scorer from the path of a saved model or None). A scorer adds label, and probability where it has one, to windows with acc.
SCORERS: dict[str, tuple[str | None, Callable[[str | None], Callable[[DataFrame], DataFrame]]]] = {}


def scorer(name: str, scheme: str | None = None):
    """Registers a maker of scorers; scheme: the only one it can give."""

    def keep(f):
        SCORERS[name] = (scheme, f)
        return f

    return keep


@scorer("threshold", "four")
def _threshold(path: str | None) -> Callable[[DataFrame], DataFrame]:
    return lambda w: w.withColumn("label", threshold_label("acc", CUTS, "moderate-vigorous"))


@scorer("forest")
def _forest(path: str | None) -> Callable[[DataFrame], DataFrame]:
    if not path:
        raise ValueError("a forest needs the path of a saved model")
    model = PipelineModel.load(path)
    return lambda w: predict_forest(model, array_features(w))


def load(name: str, scheme: str, path: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A registered scorer that gives the labels of the scheme; others are an error."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; there are {', '.join(sorted(SCORERS))}")
    only, make = SCORERS[name]
    if only and only != scheme:
        raise ValueError(f"the {name} scorer only gives the scheme {only!r}")
    return make(path)


def array_scorer(make: Callable[[], Callable[[np.ndarray], np.ndarray]], labels: list[str], batch: int = 512) -> Callable[[DataFrame], DataFrame]:
    """A scorer for a model over window arrays: make() is called once a task and gives a function from (windows, 3, samples) float32, of at most
    `batch` windows, to (windows, labels) logits. Windows get label (the largest logit, ties to the first), logits and probability; those without whole arrays get nulls, in their place."""

    def score(df: DataFrame) -> DataFrame:
        df = df.drop("label", "logits", "probability")

        def run(batches):
            model = make()
            for part in batches:
                size = np.where(part.column("x").is_valid().to_numpy(zero_copy_only=False), part.column("x").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
                out = np.full((part.num_rows, len(labels)), np.nan)
                for n in np.unique(size[size > 0]).tolist():
                    at = np.flatnonzero(size == n)
                    v = np.stack([part.column(c).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n) for c in "xyz"], axis=1).astype(np.float32)
                    whole = np.isfinite(v).all(axis=(1, 2))
                    at, v = at[whole], v[whole]
                    for lo in range(0, len(at), batch):
                        out[at[lo : lo + batch]] = model(v[lo : lo + batch])
                none = np.isnan(out[:, 0])
                high = np.exp(out - np.max(out, axis=1, keepdims=True))
                pick = [None if x else labels[i] for x, i in zip(none, np.where(none[:, None], 0, out).argmax(axis=1), strict=True)]
                rows = lambda m: pa.array([None if x else r for x, r in zip(none, m.tolist(), strict=True)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pick, pa.string()), rows(out), rows(high / high.sum(axis=1, keepdims=True))], [*part.schema.names, "label", "logits", "probability"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "label string, logits array<double>, probability array<double>"])
        return df.mapInArrow(run, schema)

    return score


def predict_recording(samples: DataFrame, scorer: Callable[[DataFrame], DataFrame], epoch_s: float, rate: int | None, length: int | None = None, smoother: sequence.HiddenMarkov | None = None, least_sleep_s: float | None = None, single_block: bool = False, labels: list[str] | None = None) -> DataFrame:
    """subject_id, us, acc, label of each epoch from first to last, those without samples too. scorer adds label to windows (null arrays must get null). Sleep that doesn't count becomes the still label of `labels`. Without a rate the samples' column of that name has each subject's."""
    still = sequence.still_label(labels) if labels and (least_sleep_s or single_block) else "sedentary"
    scored = scorer(window_enmo(windows(samples, epoch_s, rate, length))).select("subject_id", F.col("epoch_us").alias("us"), "acc", "label")
    ends = scored.groupBy("subject_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    grid = ends.select("subject_id", F.explode(F.sequence("lo", "hi", F.lit(int(epoch_s * 1e6)))).alias("us"))
    scored = grid.join(scored, ["subject_id", "us"], "left")
    if smoother:
        scored = smoother.smooth(scored, "label", int(epoch_s * 1e6)).withColumn("label", F.col("smoothed")).drop("smoothed")
    if least_sleep_s:
        scored = sequence.remove_short_sleep(scored, math.ceil(least_sleep_s / epoch_s), sedentary=still)
    if single_block:
        scored = sequence.single_sleep_block(scored, int(1800 / epoch_s), int(86400 / epoch_s), sedentary=still)
    return scored.withColumn("acc", F.when(F.col("label").isNotNull(), F.col("acc")))
