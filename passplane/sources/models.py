"""Linear classifiers read from model files: text with named lists, as libraries for vision write it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from passplane.operators import scoring


@dataclass(frozen=True)
class LinearModel:
    """Weights, the value that is subtracted, and the labels of a value above 0 and of any other."""

    weights: tuple[float, ...]
    rho: float
    labels: tuple[int, int]

    def value(self, vector: Column) -> Column:
        """The value of a vector column; null for a vector of another length."""
        weights = F.array(*[F.lit(w) for w in self.weights])
        return F.when(F.size(vector) == len(self.weights), scoring.decision(vector, weights, F.lit(self.rho)))

    def label(self, vector: Column) -> Column:
        """The label of a vector column; null for a vector of another length."""
        value = self.value(vector)
        return F.when(value > 0, F.lit(self.labels[0])).when(value.isNotNull(), F.lit(self.labels[1]))


def _numbers(text: str, name: str) -> list[float] | None:
    """The first list of numbers after a name."""
    found = re.search(rf"(?m)^\s*-?\s*{name}\s*:[^\[]*\[([^\]]*)\]", text)
    return [float(x) for x in found[1].split(",") if x.strip()] if found else None


def read_linear(spark: SparkSession, path: str) -> LinearModel | None:
    """The machine of a file with one support vector (support_vectors, rho, alpha, class_labels); None, and so no scores, if
    the file is not there, is of another kind or is damaged."""
    try:
        rows = spark.read.text(path, wholetext=True).head(1)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    text = rows[0].value if rows else ""
    try:
        vector, rho = _numbers(text, "support_vectors"), re.search(r"(?m)^\s*-?\s*rho\s*:\s*([-+.eE0-9]+)", text)
        labels = re.search(r"class_labels[\s\S]*?data\s*:\s*\[([^\]]*)\]", text)
        alpha = _numbers(text, "alpha") or [1.0]
        if not vector or not rho or not labels or "LINEAR" not in text or len(alpha) != 1:
            return None
        low, high = (int(float(x)) for x in labels[1].split(","))
        # a value above 0 stands for the first label
        return LinearModel(tuple(w * alpha[0] for w in vector), float(rho[1]), (low, high))
    except ValueError:
        return None
