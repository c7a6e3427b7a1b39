"""Fitting and comparing classifiers: folds of whole subjects, held-out probabilities, the smoother trained on them, two models on the same folds."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake import session
from kinelake.operators import bagging, evaluate, score, sequence

#: fit(rows) -> model, and predict(model, rows) -> rows with label and probability.
Classifier = tuple[Callable[[DataFrame], PipelineModel], Callable[[PipelineModel, DataFrame], DataFrame]]


def forest(features: list[str], label: str, trees: int = 200, depth: int = 20, seed: int = 42) -> Classifier:
    return lambda rows: score.fit_forest(rows, features, label, trees, depth, seed), lambda model, rows: score.predict_forest(model, rows, "label_pred")


def stratified_folds(df: DataFrame, subject: str, label: str, n: int) -> DataFrame:
    """subject, fold: whole subjects, dealt so that folds have like numbers of rows of each commonest label. Subjects of one commonest label are ordered by size and dealt forth and back."""
    each = df.where(F.col(label).isNotNull()).groupBy(subject, label).agg(F.count("*").alias("n_"))
    own = each.groupBy(subject).agg(F.sum("n_").alias("rows_"), F.max(F.struct(F.col("n_"), F.col(label).alias("label_"))).alias("top_"))
    place = F.row_number().over(Window.partitionBy("top_.label_").orderBy(F.col("rows_").desc(), subject)) - 1
    dealt = own.withColumn("place_", place).withColumn("at_", F.pmod("place_", F.lit(2 * n)))
    return dealt.select(subject, F.when(F.col("at_") < n, F.col("at_")).otherwise(2 * n - 1 - F.col("at_")).cast("int").alias("fold"))


def bagged(features: list[str], label: str, key: list[str], **options) -> Classifier:
    """The balanced forest of bagging.fit as a classifier."""
    return lambda rows: bagging.fit(rows, features, label, key, **options), lambda model, rows: bagging.predict(model, rows, key)


def balanced_folds(df: DataFrame, subject: str, label: str, n: int) -> DataFrame:
    """subject, fold: whole subjects in folds whose shares of every label are as alike as a greedy pass gets them. Subjects whose label counts differ most come first; each goes to the fold that leaves the least mean
    spread (standard deviation over folds, of every label's share), ties to the fold with fewer rows, then the smaller number. Only counts of (subject, label) reach the driver."""
    spark, kind = df.sparkSession, dict(df.dtypes)[subject]
    rows = df.where(F.col(label).isNotNull() & F.col(subject).isNotNull()).groupBy(subject).pivot(label).count().fillna(0).orderBy(subject).collect()
    counts = np.array([[r[c] for c in r.__fields__[1:]] for r in rows], float).reshape(len(rows), -1)
    total, folds, where = np.maximum(counts.sum(0), 1), np.zeros((n, counts.shape[1])), {}
    for i in np.argsort(-counts.std(1), kind="stable").tolist() if len(rows) else ():
        tried = np.repeat(folds[None], n, 0)
        tried[np.arange(n), np.arange(n)] += counts[i]
        spread = np.round((tried / total).std(1).mean(1), 12)
        k = min(range(n), key=lambda k: (spread[k], folds[k].sum(), k))
        folds[k] += counts[i]
        where[i] = k
    return spark.createDataFrame([(rows[i][subject], k) for i, k in where.items()], f"`{subject}` {kind}, fold int")


def shuffle_split(df: DataFrame, subject: str, splits: int, share: float, seed: int = 42) -> DataFrame:
    """subject, split: for each of so many splits the subjects that it holds out, ceil(share * subjects) of them, by the order of a hash of seed, split and subject."""
    every = df.select(subject).where(F.col(subject).isNotNull()).distinct()
    most, out = math.ceil(every.count() * share), None
    for k in range(splits):
        held = every.orderBy(F.xxhash64(F.lit(seed), F.lit(k), subject), subject).limit(most).withColumn("split", F.lit(k))
        out = held if out is None else out.union(held)
    return out


def fit_out_of_bag(df: DataFrame, features: list[str], label: str, key: list[str], interval_us: int | None, pseudo: tuple[str, str] | None = None, **options) -> tuple[bagging.Forest, sequence.HiddenMarkov]:
    """The balanced forest on all rows, and the smoother fitted on its out-of-bag shares. df has subject_id and us."""
    model = bagging.fit(df, features, label, key, **options)
    scored = bagging.predict(model, df, key, label=label).where(F.col("probability").isNotNull() & F.col(label).isNotNull())
    scored = scored.withColumns({f"p_{i}": F.element_at("probability", i + 1) for i in range(len(model.labels))})
    return model, sequence.HiddenMarkov.fit(scored, model.labels, label, [f"p_{i}" for i in range(len(model.labels))], interval_us, pseudo)


def split(df: DataFrame, subject: str, percent: int = 20) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) rows: whole subjects by hash, the same ones in every run."""
    held = F.pmod(F.conv(F.substring(F.md5(F.col(subject).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100)) < percent
    return df.where(~held), df.where(held)


def cross_validate(df: DataFrame, models: dict[str, Classifier], subject: str, label: str, folds: int = 5, assigned: DataFrame | None = None) -> DataFrame:
    """Every row of df once a model, predicted by a fit on the other folds: its columns, model, fold, label_pred, probability. All models see the same folds (subject, fold), those given or stratified ones. Fits and predictions are a job for each model and fold."""
    where = session.kept(df.join(assigned if assigned is not None else stratified_folds(df, subject, label, folds), subject), "folds")
    out = None
    for name, (fit, predict) in models.items():
        for k in sorted(r["fold"] for r in where.select("fold").distinct().collect()):  # a row a fold
            made = predict(fit(where.where(F.col("fold") != k)), where.where(F.col("fold") == k)).withColumn("model", F.lit(name))
            made = session.kept(made, "predicted")
            out = made if out is None else out.unionByName(made, allowMissingColumns=True)
    return out


def fit_with_smoother(df: DataFrame, classifier: Classifier, subject: str, label: str, labels: list[str], interval_us: int | None, pseudo: tuple[str, str] | None = None, percent: int = 20) -> tuple[PipelineModel, sequence.HiddenMarkov]:
    """The classifier, fitted on most subjects, and the smoother, fitted on its probabilities for those held out. df has subject_id and us."""
    fit, predict = classifier
    train, held = split(df, subject, percent)
    model = fit(train)
    order = sorted(labels)
    known = model.stages[0].labels
    share = [F.coalesce(F.element_at("probability", known.index(x) + 1), F.lit(0.0)) if x in known else F.lit(0.0) for x in order]
    scored = predict(model, held).where("probability is not null").withColumns({f"p_{i}": s for i, s in enumerate(share)})
    return model, sequence.HiddenMarkov.fit(scored, order, label, [f"p_{i}" for i in range(len(order))], interval_us, pseudo)


def compare(predicted: DataFrame, label: str, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """by and the agreement metrics of each model's predictions, best macro F1 first."""
    rows = predicted.where(F.col(label).isNotNull() & F.col("label_pred").isNotNull())
    return evaluate.metrics(evaluate.confusion(rows, list(by), label, "label_pred"), list(by)).orderBy(F.col("macro_f1").desc(), *by)
