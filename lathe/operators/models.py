"""Regressors. All have fit(df) -> model with transform(df) -> df + `prediction`, and `importances`.

df has `features` and `label`. The linear family is solved from sums of products (operators/grams.py) up to
grams.WIDEST features; beyond, penalties as stated for unscaled features are mapped onto
Spark's objective, which divides the squared loss by the spread of the label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.operators import grams
from lathe.operators.deep_forest import DeepForest, DeepForestModel  # noqa: F401
from lathe.operators.features import FEATURES, LABEL
from lathe.operators.grams import Moments
from lathe.operators.kernel import KernelModel, KernelSVR  # noqa: F401
from lathe.operators.neighbours import Neighbours, NeighboursModel  # noqa: F401

PREDICTION = "prediction"
SPARK_DEPTH = 30  # the most that Spark's trees grow


def _importances(model: Any) -> list[float] | None:
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray().tolist()
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray()).tolist()
    return None


@dataclass
class Fitted:
    model: Any

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    @property
    def importances(self) -> list[float] | None:
        return _importances(self.model)


@dataclass(frozen=True)
class Linear:
    """Squared loss / 2n + l1 * |w| + l2 / 2 * w^2, with l1 = alpha * l1_ratio and l2 = alpha * (1 - l1_ratio);
    for `ridge`, the squared loss isn't divided by n (so alpha counts against the sum)."""

    alpha: float = 0.0
    l1_ratio: float = 0.0
    ridge: bool = False
    max_iter: int = 10_000

    def fit(self, df: DataFrame, known: Moments | None = None) -> Fitted:
        """known: the moments of df's rows, if there are any yet; else they take one scan."""
        if known is None and not grams.fits(df):
            return self._fit_in_steps(df)
        w, a = self.solution(known or grams.fold_moments(df, []).whole)
        return Fitted(grams.LinearModel(DenseVector(w), a))

    def solution(self, m: Moments, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        return grams.solve(m, alpha=self.alpha, l1_ratio=self.l1_ratio, ridge=self.ridge, start=start, max_iter=self.max_iter)

    def _fit_in_steps(self, df: DataFrame) -> Fitted:
        """Many features: gradients over all rows, again and again."""
        lr = R.LinearRegression(featuresCol=FEATURES, labelCol=LABEL, standardization=False, maxIter=self.max_iter, tol=1e-9)
        n, pop, sample = df.agg(F.count("*"), F.stddev_pop(LABEL), F.stddev_samp(LABEL)).first()
        if not self.alpha or not pop:
            return Fitted(lr.setRegParam(0.0).setSolver("auto").fit(df))
        if self.ridge:
            return Fitted(lr.setElasticNetParam(0.0).setRegParam(self.alpha / n * sample).setSolver("l-bfgs").fit(df))
        l1, l2 = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)
        lam = l1 + l2 * sample
        return Fitted(lr.setElasticNetParam(l1 / lam).setRegParam(lam).setSolver("l-bfgs").fit(df))


@dataclass(frozen=True)
class Tree:
    max_depth: int | None = 10
    seed: int = 42

    def fit(self, df: DataFrame) -> Any:
        if self.max_depth is None or self.max_depth > SPARK_DEPTH:
            return DeepForest(1, self.seed, bootstrap=False, max_depth=self.max_depth).fit(df)
        est = R.DecisionTreeRegressor(featuresCol=FEATURES, labelCol=LABEL, maxDepth=self.max_depth, maxBins=256, seed=self.seed)
        return Fitted(est.fit(df))


@dataclass(frozen=True)
class Forest:
    n_estimators: int = 200
    max_depth: int | None = None
    seed: int = 42

    def fit(self, df: DataFrame) -> Any:
        if self.max_depth is None or self.max_depth > SPARK_DEPTH:
            return DeepForest(self.n_estimators, self.seed, max_depth=self.max_depth).fit(df)
        est = R.RandomForestRegressor(featuresCol=FEATURES, labelCol=LABEL, numTrees=self.n_estimators, maxDepth=self.max_depth, featureSubsetStrategy="all", maxBins=256, seed=self.seed, maxMemoryInMB=1024)
        return Fitted(est.fit(df))


@dataclass(frozen=True)
class Boosting:
    n_estimators: int = 200
    learning_rate: float = 0.1
    max_depth: int = 3
    seed: int = 42

    def fit(self, df: DataFrame) -> Fitted:
        est = R.GBTRegressor(featuresCol=FEATURES, labelCol=LABEL, maxIter=self.n_estimators, stepSize=self.learning_rate, maxDepth=self.max_depth, lossType="squared", maxBins=256, seed=self.seed)
        return Fitted(est.fit(df))


@dataclass(frozen=True)
class FourierSVR:
    """Epsilon-insensitive regression with a Gaussian kernel, gamma = 1 / (width * variance of all entries), for any
    number of rows. KernelSVR (operators/kernel.py) is exact.

    The kernel is approximated by random Fourier features (Rahimi and Recht, 2007), and the primal
    problem is solved by gradient steps whose sums run over all partitions; memory doesn't grow with rows."""

    C: float = 1.0
    epsilon: float = 0.1
    components: int = 256
    steps: int = 60
    seed: int = 42

    def fit(self, df: DataFrame) -> FourierModel:
        rows = df.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).alias("y"))
        width = len(rows.first()["x"])
        spread = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0.0, math.sqrt(2.0 / (width * spread)), (width, self.components))
        phase = rng.uniform(0, 2 * math.pi, self.components)
        mean = rows.agg(F.avg("y")).first()[0]
        theta = np.zeros(self.components + 1)
        theta[-1] = mean
        cached = rows.persist()
        try:
            theta = _minimize(lambda t: self._loss(cached, w, phase, t), theta, self.steps)
        finally:
            cached.unpersist()
        return FourierModel(w, phase, theta)

    def _loss(self, rows: DataFrame, w: np.ndarray, phase: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
        eps, soft, m = self.epsilon, 0.05 * self.epsilon + 1e-12, self.components

        def part(batches):
            total, slope = 0.0, np.zeros(m + 1)
            for pdf in batches:
                if len(pdf):
                    z = _fourier(np.array(pdf["x"].tolist(), float), w, phase)
                    r = z @ theta[:-1] + theta[-1] - np.asarray(pdf["y"], float)
                    over = np.abs(r) - eps
                    inside = (over > 0) & (over < soft)
                    total += np.where(over >= soft, over - soft / 2, np.where(inside, over**2 / (2 * soft), 0)).sum()
                    g = np.sign(r) * np.where(over >= soft, 1.0, np.where(inside, over / soft, 0))
                    slope += np.r_[z.T @ g, g.sum()]
            yield pd.DataFrame({"total": [total], "slope": [slope.tolist()]})

        parts = rows.mapInPandas(part, "total double, slope array<double>").collect()  # a row a partition
        total = self.C * sum(p["total"] for p in parts) + 0.5 * float(theta[:-1] @ theta[:-1])
        slope = self.C * np.sum([p["slope"] for p in parts], axis=0) + np.r_[theta[:-1], 0.0]
        return total, slope


def _fourier(x: np.ndarray, w: np.ndarray, phase: np.ndarray) -> np.ndarray:
    return math.sqrt(2.0 / len(phase)) * np.cos(x @ w + phase)


def _minimize(f, x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking."""
    value, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = slope.copy(), []
        for s, y in reversed(moves):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if moves:
            q *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1])
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y), a in zip(moves, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        step, gain = 1.0, slope @ q
        while step > 1e-6:
            new = x - step * q
            new_value, new_slope = f(new)
            if new_value <= value - 1e-4 * step * gain:
                break
            step /= 2
        else:
            return x
        s, y = new - x, new_slope - slope
        if y @ s > 1e-12:
            moves = [*moves[-(memory - 1) :], (s, y)]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


@dataclass
class FourierModel:
    w: np.ndarray
    phase: np.ndarray
    theta: np.ndarray
    importances: None = None

    def transform(self, df: DataFrame) -> DataFrame:
        w, phase, theta = self.w, self.phase, self.theta

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(_fourier(np.array(x.tolist(), float), w, phase) @ theta[:-1] + theta[-1])

        return df.withColumn(PREDICTION, predict(vector_to_array(FEATURES)))


@dataclass(frozen=True)
class Wrapped:
    """Any estimator with Spark's fit and transform over the columns features, label and prediction."""

    estimator: Any
    params: dict[str, Any] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Fitted:
        return Fitted(self.estimator.copy({self.estimator.getParam(k): v for k, v in self.params.items()}).fit(df))


def optional_boosters(seed: int) -> dict[str, Any]:
    """Gradient boosters of libraries that happen to be installed."""
    out: dict[str, Any] = {}
    try:
        from xgboost.spark import SparkXGBRegressor

        out["XGBoost"] = Wrapped(SparkXGBRegressor(features_col=FEATURES, label_col=LABEL, n_estimators=300, learning_rate=0.05, max_depth=6, random_state=seed))
    except ImportError:
        pass
    try:
        from synapse.ml.lightgbm import LightGBMRegressor

        out["LightGBM"] = Wrapped(LightGBMRegressor(featuresCol=FEATURES, labelCol=LABEL, numIterations=300, learningRate=0.05, numLeaves=31, seed=seed))
    except ImportError:
        pass
    return out


def default_models(seed: int = 42) -> dict[str, Any]:
    return {
        "LinearRegression": Linear(),
        "Ridge": Linear(alpha=1.0, ridge=True),
        "Lasso": Linear(alpha=0.01, l1_ratio=1.0),
        "ElasticNet": Linear(alpha=0.01, l1_ratio=0.5),
        "DecisionTree": Tree(seed=seed),
        "RandomForest": Forest(seed=seed),
        "GradientBoosting": Boosting(seed=seed),
        "KNN": Neighbours(),
        "SVR": KernelSVR(),
        **optional_boosters(seed),
    }


# What tuning tries for each model; the combinations of a model's lists are its grid.
GRIDS: dict[str, dict[str, list]] = {
    "Ridge": {"alpha": [0.1, 1.0, 10.0]},
    "Lasso": {"alpha": [0.001, 0.01, 0.1]},
    "ElasticNet": {"alpha": [0.01, 0.1], "l1_ratio": [0.3, 0.5, 0.7]},
    "DecisionTree": {"max_depth": [5, 10, 20, None]},
    "RandomForest": {"n_estimators": [100, 200], "max_depth": [10, 20, None]},
    "GradientBoosting": {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1]},
    "KNN": {"n_neighbors": [3, 5, 10, 15]},
    "SVR": {"C": [0.1, 1.0, 10.0]},
    "XGBoost": {"n_estimators": [200, 400], "learning_rate": [0.05, 0.1], "max_depth": [4, 6]},
    "LightGBM": {"numIterations": [200, 400], "learningRate": [0.05, 0.1], "numLeaves": [31, 63]},
}


def with_params(model: Any, params: dict[str, Any]) -> Any:
    return replace(model, params={**model.params, **params}) if isinstance(model, Wrapped) else replace(model, **params)
