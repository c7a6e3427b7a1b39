"""Agreement of predictions with truth, from confusion counts and paired differences."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, by: list[str], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """by, y_true, y_pred, n, share of the true label's rows."""
    counts = df.groupBy(*by, F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "y_true")))


def label_report(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, label, support, precision, recall, f1 for the union of true and predicted labels; undefined is 0."""
    side = lambda c, n: counts.groupBy(*by, F.col(c).alias("label")).agg(F.sum("n").alias(n))
    hit = counts.where("y_true = y_pred").select(*by, F.col("y_true").alias("label"), F.col("n").alias("hit"))
    every = side("y_true", "support").join(side("y_pred", "predicted"), [*by, "label"], "full").join(hit, [*by, "label"], "left").na.fill(0, ["support", "predicted", "hit"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    made = every.withColumns({"precision": share(F.col("hit"), F.col("predicted")), "recall": share(F.col("hit"), F.col("support"))})
    return made.withColumn("f1", share(2 * F.col("hit"), F.col("support") + F.col("predicted")))


def metrics(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, accuracy, macro_f1, kappa, balanced_accuracy."""
    report = label_report(counts, by)
    n = F.sum("support")
    chance = F.sum(F.col("support") * F.col("predicted")) / (n * n)
    accuracy = F.sum("hit") / n
    return report.groupBy(*by).agg(accuracy.alias("accuracy"), F.avg("f1").alias("macro_f1"), F.when(chance < 1, (accuracy - chance) / (1 - chance)).alias("kappa"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))


def hours_per_class(df: DataFrame, by: list[str], label: str, epochs_per_hour: float = 120.0) -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label")).agg((F.count("*") / epochs_per_hour).alias("hours"))


def mean_sd(df: DataFrame, by: list[str], value: str, sample: bool = False) -> DataFrame:
    """by, mean, sd (population, or sample), text such as '0.812 ± 0.034'."""
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), sd.alias("sd")).withColumn("text", F.format_string("%.3f ± %.3f", "mean", "sd"))


def mae(df: DataFrame, by: list[str], true: str, pred: str) -> DataFrame:
    """by, mae and the population sd of the absolute error."""
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(pred) - F.col(true))).alias("mae"), F.stddev_pop(F.abs(F.col(pred) - F.col(true))).alias("sd"))


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x in (0.0, 1.0):
        return x

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or tiny)
        out = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / ((1 + top * d) or tiny), (1 + top / c) or tiny
                out *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def p_values(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df, strict=True)])


def paired_t(df: DataFrame, by: list[str], a: str, b: str, p: bool = True) -> DataFrame:
    """by, n, t and, if asked, the two-sided p and its text ('<0.001' below that)."""
    d = F.col(a) - F.col(b)
    made = df.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.when(F.stddev_samp(d) > 0, F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*")))).alias("t"))
    return made.withColumn("p", F.pandas_udf(p_values, "double")("t", (F.col("n") - 1).cast("double"))).withColumn("p_text", F.when(F.col("p") < 0.001, "<0.001").otherwise(F.format_string("%.3f", "p"))) if p else made


def bland_altman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, n, r, mean_difference, sd (sample), lower and upper limits of agreement, mean of pair means."""
    d = F.col(a) - F.col(b)
    made = df.groupBy(*by).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"), F.avg((F.col(a) + F.col(b)) / 2).alias("mean_of_means"))
    return made.withColumns({"lower": F.col("mean_difference") - 1.96 * F.col("sd"), "upper": F.col("mean_difference") + 1.96 * F.col("sd")})


def error_quartiles(df: DataFrame, by: list[str], error: Column) -> DataFrame:
    q = lambda x: F.percentile(error, F.lit(x))
    return df.groupBy(*by).agg(F.count("*").alias("n"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.avg(error).alias("mean"), F.stddev_samp(error).alias("sd"))


def class_weights(df: DataFrame, label: str, codes: list[str]) -> DataFrame:
    """label, weight = rows / count; labels without rows count one."""
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, codes))).alias("label"))
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    made = every.join(F.broadcast(counts), "label", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    total = df.where(F.col(label).isNotNull()).agg(F.count("*").alias("total"))  # one row
    return made.crossJoin(total).select("label", (F.col("total") / F.col("n")).alias("weight"))


def with_metadata(predicted: DataFrame, people: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Predictions of the subjects that have metadata, with its columns."""
    return predicted.join(people, subject)


def subgroup(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns have the wanted values; a wanted None stands for all."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def paired(df: DataFrame, key: list[str], model: str, value: str, a: str, b: str) -> DataFrame:
    """key, a, b: the value under two models of the keys that have both."""
    own = lambda name: F.max(F.when(F.col(model) == name, F.col(value))).alias(name)
    return df.where(F.col(model).isin(a, b)).groupBy(*key).agg(own(a), own(b)).where(F.col(a).isNotNull() & F.col(b).isNotNull())


def performance_table(df: DataFrame, rows: str, columns: str, value: str, names: list[str]) -> DataFrame:
    """A row for each of `rows` with the mean value under each name of `columns`, best first by the first name."""
    return df.groupBy(rows).pivot(columns, names).agg(F.avg(value)).orderBy(F.col(names[0]).desc_nulls_last(), rows)


def folds(df: DataFrame, subject: str, n: int) -> DataFrame:
    """df with fold: whole subjects, dealt by a hash of the subject, so that no order over all subjects is needed and every run gives the same folds."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.col(subject).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int"))


def fold_members(assigned: DataFrame, subject: str) -> DataFrame:
    """fold, members ('a, b, c', sorted), n."""
    return assigned.groupBy("fold").agg(F.array_join(F.array_sort(F.collect_set(F.col(subject).cast("string"))), ", ").alias("members"), F.countDistinct(subject).alias("n"))
