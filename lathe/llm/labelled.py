"""What the operators that learn from labels share: folds, labelled rows, a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of at most so many rows (about 32 MB) are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds (null ids: null)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)).cast("int")


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """docs' rows that have a label 0 or 1, with it as column `label_`. Ids that repeat in labels count
    once, by their largest label."""
    wanted = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label).cast("int").alias("label_"))
    if labels.count() <= BROADCAST_LABELS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, docs[id_col] == F.col("_label_id")).drop("_label_id")


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on standardised inputs, by Newton's method,
    given for the inputs as they are. With one class only, the intercept is a mild prior."""
    if not len(x) or y.min() == y.max():
        return np.zeros(x.shape[1] if x.ndim > 1 else 0), 0.0 if not len(x) else (2.0 if y[0] else -2.0)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + l2 * len(y) * np.r_[0, w[1:]]
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)) * l2 * len(y), slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[1:] / spread, float(w[0] - (w[1:] * mean / spread).sum())
