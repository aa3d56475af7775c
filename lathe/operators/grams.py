"""The linear family from sums of products: one scan for all folds, penalties and models.

A row belongs to a pattern: for each pair of folds' conditions, whether it trains, tests or neither. For each pattern
a scan makes the number of rows, the means, the centred products of features and label, and the label's least and greatest
value. These moments add up (Chan, Golub and LeVeque's update), so the training rows of a fold are the sum of some
patterns, and so are its test rows. Ridge solves its normal equations, lasso and elastic net descend by coordinates
on the covariances, from the largest penalty to the smallest with the last solution as a start. Squared errors on test rows
follow from their moments too; no model scores a row.

A task keeps one matrix a pattern and the driver gets one; between them matrices are summed in two rounds, so that no task
reads more than about the square root of their number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.operators.features import FEATURES, LABEL

PREDICTION = "prediction"
#: More features than this make matrices of over 134 MB; other solvers take over there.
WIDEST = 4096
_MOMENTS = "pattern long, part int, n long, low double, high double, mean binary, products binary"


@dataclass(frozen=True)
class Moments:
    """n rows, the means of features and label (last), their centred products, and the label's range."""

    n: int
    mean: np.ndarray
    products: np.ndarray
    low: float
    high: float

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n = self.n + other.n
        gap = other.mean - self.mean
        products = self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, self.mean + gap * (other.n / n), products, min(self.low, other.low), max(self.high, other.high))

    @classmethod
    def none(cls, width: int) -> Moments:
        return cls(0, np.zeros(width + 1), np.zeros((width + 1, width + 1)), math.inf, -math.inf)

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Moments:
        z = np.c_[x, y]
        mean = z.mean(0)
        return cls(len(z), mean, (z - mean).T @ (z - mean), float(y.min()), float(y.max()))

    @property
    def width(self) -> int:
        return len(self.mean) - 1

    def only(self, feature: int) -> Moments:
        """Those of one feature and the label: what a scan of that feature alone would make."""
        at = [feature, self.width]
        return Moments(self.n, self.mean[at], self.products[np.ix_(at, at)], self.low, self.high)

    def scores(self, w: np.ndarray, a: float) -> dict[str, float | None]:
        """R2 and RMSE that intercept a and weights w have on these rows."""
        if not self.n:
            return {"r2": None, "rmse": None}
        v = np.r_[-w, 1.0]
        bias = float(self.mean @ v) - a
        sse = max(float(v @ self.products @ v), 0.0) + self.n * bias * bias
        if self.low < self.high:
            r2 = 1 - sse / float(self.products[-1, -1])
        else:
            exact = sse <= 1e-24 * self.n * max(1.0, self.high * self.high)
            r2 = 1.0 if exact else 0.0
        return {"r2": r2, "rmse": math.sqrt(sse / self.n)}


def _rows(found: dict[tuple[int, int], Moments]) -> pd.DataFrame:
    out = [(p, k, m.n, m.low, m.high, m.mean.tobytes(), m.products.tobytes()) for (p, k), m in found.items()]
    return pd.DataFrame(out, columns=["pattern", "part", "n", "low", "high", "mean", "products"])


def _moments(n: int, low: float, high: float, mean: bytes, products: bytes) -> Moments:
    m = np.frombuffer(mean)
    return Moments(n, m, np.frombuffer(products).reshape(len(m), len(m)), low, high)


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = reduce(Moments.__add__, (_moments(*r) for r in zip(pdf["n"], pdf["low"], pdf["high"], pdf["mean"], pdf["products"])))
    return _rows({(pdf["pattern"].iloc[0], pdf["part"].iloc[0]): total})


def moments(df: DataFrame, pattern: Column) -> dict[int, Moments]:
    """Moments of (features, label) for each value of a pattern (a long), from one scan. Rows without features or
    label don't count."""

    def partial(batches):
        found: dict[int, Moments] = {}
        for batch in batches:
            x = batch.column("x")
            if not len(x):
                continue
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            y, p = batch.column("y").to_numpy(zero_copy_only=False), batch.column("pattern").to_numpy(zero_copy_only=False)
            for one in np.unique(p).tolist():
                at = p == one
                m = Moments.of(values[at], y[at])
                found[one] = found[one] + m if one in found else m
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pandas(_rows({(k, part): m for k, m in found.items()}), schema=_SCHEMA)

    rows = df.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).cast("double").alias("y"), pattern.cast("long").alias("pattern")).where("x is not null and y is not null")
    parts = rows.mapInArrow(partial, _MOMENTS)
    fan = max(1, math.isqrt(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    first = parts.withColumn("part", F.pmod("part", F.lit(fan)).cast("int")).groupBy("pattern", "part").applyInPandas(_summed, _MOMENTS)
    final = first.withColumn("part", F.lit(0)).groupBy("pattern").applyInPandas(_summed, _MOMENTS)
    return {r["pattern"]: _moments(r["n"], r["low"], r["high"], bytes(r["mean"]), bytes(r["products"])) for r in final.collect()}


_SCHEMA = pa.schema([("pattern", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("mean", pa.binary()), ("products", pa.binary())])


@dataclass(frozen=True)
class FoldMoments:
    """Moments of all rows, and of each fold's training and test rows."""

    whole: Moments
    folds: list[tuple[Moments, Moments]]


def fold_moments(df: DataFrame, pairs: list[tuple[Column, Column]]) -> FoldMoments:
    """pairs: conditions of training and test rows. A row's pattern has two bits for each of them; at most 31 pairs."""
    if len(pairs) > 31:
        raise ValueError("at most 31 folds")
    pattern = F.lit(0).cast("long")
    for k, conditions in enumerate(pairs):
        for j, c in enumerate(conditions):
            pattern = pattern + F.when(c, F.lit(1 << (2 * k + j))).otherwise(F.lit(0)).cast("long")
    found = moments(df, pattern)
    if not found:
        raise ValueError("there are no rows to fit")
    none = Moments.none(next(iter(found.values())).width)
    with_bit = lambda b: reduce(Moments.__add__, (m for p, m in sorted(found.items()) if p >> b & 1), none)
    whole = reduce(Moments.__add__, (m for _, m in sorted(found.items())), none)
    return FoldMoments(whole, [(with_bit(2 * k), with_bit(2 * k + 1)) for k in range(len(pairs))])


def fits(df: DataFrame) -> bool:
    """Whether rows are narrow enough for matrices."""
    row = df.select(F.size(vector_to_array(FEATURES)).alias("d")).first()
    return row is not None and row["d"] <= WIDEST


def grid_scores(found: FoldMoments, solutions) -> list[list[dict[str, float | None]]]:
    """For each point of a grid, R2 and RMSE of each fold. solutions: for a fold's training moments, weights and
    intercept at each point."""
    by_fold = [[test.scores(*s) for s in solutions(train)] for train, test in found.folds]
    return [list(point) for point in zip(*by_fold)]


# ---- solutions --------------------------------------------------------------------------------------------


def solve(m: Moments, *, alpha: float = 0.0, l1_ratio: float = 0.0, ridge: bool = False, start: np.ndarray | None = None, max_iter: int = 10_000) -> tuple[np.ndarray, float]:
    """Weights and intercept. Squared loss / 2n + l1 |w| + l2 / 2 w^2, with l1 = alpha * l1_ratio and l2 = alpha * (1 - l1_ratio);
    for `ridge`, the squared loss isn't divided by n. Constant columns get no weight, and of dependent ones
    the solution of least norm is taken (without a penalty)."""
    d = m.width
    if not m.n:
        return np.zeros(d), 0.0
    a, b = m.products[:d, :d], m.products[:d, d]
    if ridge and alpha:
        w = np.linalg.solve(a + alpha * np.eye(d), b) if d else np.zeros(0)
    elif not alpha:
        size = np.sqrt(np.diag(a))
        size[size == 0] = 1.0
        w = np.linalg.lstsq(a / np.outer(size, size), b / size, rcond=1e-12)[0] / size
    else:
        w = descend(a / m.n, b / m.n, alpha * l1_ratio, alpha * (1 - l1_ratio), start, max_iter)
    return w, float(m.mean[d] - m.mean[:d] @ w)


def descend(a: np.ndarray, b: np.ndarray, l1: float, l2: float, start: np.ndarray | None = None, max_iter: int = 10_000) -> np.ndarray:
    """Coordinate descent for w'aw / 2 - b'w + l1 |w| + l2 / 2 w^2, until a round moves nothing by more than
    1e-13 of the fit; rounds over the non-zero weights alternate with rounds over all."""
    d = len(b)
    w = np.zeros(d) if start is None else start.copy()
    slope = b - a @ w  # what is left of b
    diagonal = np.diag(a)
    scale = np.sqrt(np.maximum(diagonal, 0.0))
    top = max(float(np.abs(b / np.where(scale > 0, scale, 1.0)).max(initial=0.0)), 1e-300)
    everything = np.flatnonzero(diagonal > 0)

    def sweep(coordinates: np.ndarray) -> float:
        nonlocal slope
        most = 0.0
        for j in coordinates:
            z = slope[j] + diagonal[j] * w[j]
            new = math.copysign(max(abs(z) - l1, 0.0), z) / (diagonal[j] + l2)
            if new != w[j]:
                step = new - w[j]
                slope -= a[:, j] * step
                w[j] = new
                most = max(most, abs(step) * scale[j])
        return most

    for _ in range(max_iter):
        if sweep(everything) <= 1e-13 * top:
            break
        for _ in range(max_iter):
            if sweep(np.flatnonzero(w)) <= 1e-13 * top:
                break
        slope = b - a @ w
    return w


@dataclass(frozen=True)
class LinearModel:
    coefficients: DenseVector
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        w = self.coefficients.toArray()
        used = np.flatnonzero(w).tolist()
        if len(used) <= 64:
            x = vector_to_array(FEATURES)
            total = reduce(lambda a, j: a + x[j] * F.lit(float(w[j])), used, F.lit(float(self.intercept)))
        else:
            pairs = F.zip_with(vector_to_array(FEATURES), F.lit(w.tolist()), lambda x, c: x * c)
            total = F.aggregate(pairs, F.lit(float(self.intercept)), lambda a, v: a + v)
        return df.withColumn(PREDICTION, total)
