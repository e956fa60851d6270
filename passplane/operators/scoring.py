"""Vectors and linear classifiers: length, decision, training, confusion, and evaluation by left-out samples."""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_length(vector: Column) -> Column:
    """The vector scaled to length 1; the squared length is taken as 1e-9 at least."""
    squared = F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.transform(vector, lambda v: v.cast("double") / F.sqrt(F.greatest(squared, F.lit(1e-9))))


def decision(vector: Column, weights: Column, rho: Column) -> Column:
    """The value of a linear machine: positive for the first class."""
    return F.aggregate(F.zip_with(vector, weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, v: a + v) - rho


def confusion(rows: DataFrame, keys: list[str], label: str, predicted: str) -> DataFrame:
    """(keys, tp, tn, fp, fn): one aggregation; class 1 is positive."""
    hit = lambda y, p: F.count_if((F.col(label) == y) & (F.col(predicted) == p))
    return rows.groupBy(*keys).agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))


def fit(samples: DataFrame, class_weight: float = 1.0, c: float = 1.0, steps: int = 100) -> tuple[list[float], float]:
    """(weights, rho) of a linear machine for samples (vec, label 0 or 1), as decision() takes them.

    Spark's support vector classifier; c is the cost of an error, times class_weight for class 1, over all samples. Samples
    with a null vector or label are left out. With one class, or without samples, the machine always gives that class, or 0;
    it has no weights then, so its value is -rho for any vector.
    """
    rows = samples.where("vec IS NOT NULL AND label IS NOT NULL").select(
        array_to_vector(F.col("vec").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, float(class_weight)).otherwise(1.0).alias("cost")
    )
    seen = rows.agg(F.sum("cost").alias("cost"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    if seen.low is None or seen.low == seen.high:
        return [], -1.0 if seen.high == 1 else 1.0
    # the classifier takes the mean of the losses, so c over all samples is this share of the squared length
    machine = LinearSVC(weightCol="cost", regParam=1 / (c * seen.cost), maxIter=steps, tol=1e-6, standardization=False).fit(rows)
    return machine.coefficients.toArray().tolist(), -float(machine.intercept)


def leave_out(samples: DataFrame, weights: list[float], folds: int, steps: int = 100, at_once: int = 4) -> DataFrame:
    """(class_weight, sample_id, label, predicted): each sample predicted by machines trained on the other folds' samples.

    Samples (sample_id, vec, label) are dealt to folds by a hash of the id. There are folds x weights fits, some at once;
    only their machines reach the driver, and one join with them predicts every sample. Samples with a null vector have a
    null prediction. Rows of one id share a fold.
    """
    dealt = samples.select("sample_id", "vec", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("sample_id"), F.lit(folds)).cast("int").alias("fold"))
    held = dealt.persist()
    try:
        with ThreadPool(at_once) as pool:
            jobs = [(k, float(w)) for k in range(folds) for w in weights]
            machines = pool.starmap(lambda k, w: (k, w, *fit(held.where(F.col("fold") != k), w, steps=steps)), jobs)
    finally:
        held.unpersist()
    # folds x weights rows, whatever the samples
    known = dealt.sparkSession.createDataFrame(machines, "fold int, class_weight double, w array<double>, rho double")
    value = F.when(F.size("w") == 0, -F.col("rho")).otherwise(decision(F.col("vec"), F.col("w"), F.col("rho")))
    predicted = F.when(F.col("vec").isNotNull(), (value > 0).cast("int"))
    return dealt.join(F.broadcast(known), "fold").select("class_weight", "sample_id", "label", predicted.alias("predicted"))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: float, c: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """A linear machine for classes 0 and 1 by averaged subgradient steps on the hinge loss; class 1 has the weight."""
    sign, cost = np.where(y == 1, 1.0, -1.0), np.where(y == 1, weight, 1.0) * c
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b = w.copy(), 0.0
    for t in range(1, steps + 1):
        inside = (sign * (x @ w + b) < 1) * cost * sign
        rate = 1 / (t + 10)
        w -= rate * (w - inside @ x)
        b += rate * inside.sum()
        mean_w += (w - mean_w) / t
        mean_b += (b - mean_b) / t
    return mean_w, mean_b


def leave_one_out(samples: DataFrame, weights: list[float], most: int = 256) -> DataFrame:
    """(class_weight, sample_id, label, predicted): each sample predicted by a machine trained on all others.

    Samples (sample_id, vec, label) are gathered on the driver, so there may be at most so many; the fits, one for each
    sample and weight, are dealt to tasks. Larger tables are for leave_out().
    """
    spark = samples.sparkSession
    rows = samples.select("sample_id", "vec", "label").orderBy("sample_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"leave-one-out takes at most {most} samples")
    shared = spark.sparkContext.broadcast((np.array([r.vec for r in rows], float), np.array([r.label for r in rows])))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = shared.value
        for pdf in parts:
            out = []
            for at, weight in zip(pdf["at"], pdf["class_weight"], strict=True):
                others = np.arange(len(y)) != at
                w, b = fit_linear(x[others], y[others], weight)
                out.append(int(x[at] @ w + b > 0))
            yield pdf.assign(predicted=out)

    tasks = spark.createDataFrame([(k, r.sample_id, int(r.label), w) for k, r in enumerate(rows) for w in weights], "at int, sample_id long, label int, class_weight double")
    return tasks.repartition(8).mapInPandas(run, "at int, sample_id long, label int, class_weight double, predicted int").drop("at")
