"""Fitting, tuning, cross-validation, metrics and ranking. Results are long tables."""

from __future__ import annotations

import itertools
import logging
import math
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.stats import regression_metrics
from lathe.operators import grams, selection
from lathe.operators.features import LABEL
from lathe.operators.grams import FoldMoments, Moments
from lathe.operators.models import GRIDS, PREDICTION, Linear, with_params

log = logging.getLogger(__name__)
METRICS = ("mae", "rmse", "mse", "r2", "median_ae", "mape_pct")


@dataclass(frozen=True)
class Folds:
    """Pairs of conditions (training rows, test rows) on a table of features."""

    pairs: list[tuple[Column, Column]]

    @classmethod
    def by_column(cls, fold: str, folds: int) -> Folds:
        return cls([(F.col(fold) != k, F.col(fold) == k) for k in range(folds)])

    @classmethod
    def expanding(cls, block: str, folds: int) -> Folds:
        return cls([(F.col(block) < k, F.col(block) == k) for k in range(1, folds + 1)])


@dataclass
class ModelResult:
    name: str
    model: Any
    metrics: dict[str, float | None]
    cv: list[dict[str, float]] = field(default_factory=list)  # r2 and rmse of each fold, in training units
    fit_seconds: float = 0.0
    importances: list[float] | None = None
    best_params: dict[str, Any] | None = None


def evaluate(predictions: DataFrame, label: str = LABEL, by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Metrics of (label, prediction), one row or one for each group. rows: how many there are, if that is known. Few
    take one aggregate; else the median error comes from refined histograms (operators/selection.py), as an aggregate
    would gather a group's errors in one task."""
    by = list(by or [])
    m = regression_metrics(F.col(label), F.col(PREDICTION))
    if rows is not None and rows <= selection.LIMIT:
        return predictions.groupBy(*by).agg(*(m[k].alias(k) for k in METRICS))
    error = F.abs(F.col(label) - F.col(PREDICTION))
    kept = predictions.select(*by, label, PREDICTION).persist(StorageLevel.DISK_ONLY)
    try:
        medians = selection.group_medians(kept, by, error, "median_ae")
        others = kept.groupBy(*by).agg(*(m[k].alias(k) for k in METRICS if k != "median_ae"))
        # a row a group, and the rows behind them are released here: so both are read now
        schema = T.StructType([*others.schema.fields, T.StructField("median_ae", T.DoubleType())])
        known = {tuple(r[c] for c in by): r["median_ae"] for r in medians.collect()}
        return predictions.sparkSession.createDataFrame([(*r, known.get(tuple(r[c] for c in by))) for r in others.collect()], schema).select(*by, *METRICS)
    finally:
        kept.unpersist()


def original_units(df: DataFrame, transform: str) -> DataFrame:
    """Label and prediction before log1p, if that was applied."""
    if transform != "log1p":
        return df
    return df.withColumns({LABEL: F.expm1(LABEL), PREDICTION: F.expm1(PREDICTION)})


def grid_of(name: str) -> list[dict[str, Any]]:
    grid = GRIDS.get(name, {})
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())] if grid else []


def cross_validate(model: Any, train: DataFrame, folds: Folds, known: FoldMoments | None = None) -> list[dict[str, float]]:
    """R2 and RMSE of each fold from one fit each. The linear family takes them from the folds' moments (known, or
    one scan for all folds)."""
    if isinstance(model, Linear) and (known or grams.fits(train)):
        return linear_grid(train, folds, [model], known)[0]
    out, rows = [], train.count()
    for fit_on, test_on in folds.pairs:
        scored = model.fit(train.where(fit_on)).transform(train.where(test_on))
        row = evaluate(scored, rows=rows).first()
        out.append({"r2": row["r2"], "rmse": row["rmse"]})
    return out


def linear_grid(train: DataFrame, folds: Folds, models: list[Linear], known: FoldMoments | None = None) -> list[list[dict[str, float]]]:
    """For each of some linear models, R2 and RMSE of each fold, from one scan for all of them. Penalties go down,
    and each solution starts the next of its kind."""
    known = known or grams.fold_moments(train, folds.pairs)

    def solutions(m: Moments) -> list[tuple]:
        out: list[tuple] = [()] * len(models)
        start: dict[float, Any] = {}
        for k in sorted(range(len(models)), key=lambda k: (models[k].l1_ratio, -models[k].alpha)):
            out[k] = models[k].solution(m, start.get(models[k].l1_ratio))
            start[models[k].l1_ratio] = out[k][0]
        return out

    return grams.grid_scores(known, solutions)


def tune(name: str, model: Any, train: DataFrame, folds: Folds, known: FoldMoments | None = None) -> tuple[Any, dict[str, Any] | None]:
    """The model with the parameters of the least mean RMSE over the folds (the first of equal ones)."""
    grid = grid_of(name)
    if not grid:
        return model, None
    points = [with_params(model, params) for params in grid]
    if isinstance(model, Linear) and (known or grams.fits(train)):
        scores = linear_grid(train, folds, points, known)
    else:
        scores = [cross_validate(m, train, folds) for m in points]
    means = [sum(s["rmse"] for s in point) / len(point) for point in scores]
    best = min(range(len(grid)), key=lambda k: (means[k], k))
    return points[best], grid[best]


#: Models that are fitted at the same time: each may hold a table of its own in the executors' memory.
CONCURRENT_FITS = 4


def train_and_evaluate(train: DataFrame, test: DataFrame, models: dict[str, Any], folds: Folds, *, transform: str = "none", tuned: bool = False, progress: Callable[[int, int, str], None] | None = None, concurrent: int = CONCURRENT_FITS) -> dict[str, ModelResult]:
    """train, test: `features`, `label` and the folds' columns. Test metrics are in original units,
    cross-validation in those that models are trained in. Up to `concurrent` models are worked on at a time, each in a
    scheduler pool of its own, so that (in a session that schedules fairly) long fits don't hold up short ones; fit_seconds
    are what passes meanwhile. Results don't depend on it."""
    train, test = train.persist(), test.persist()
    spark = train.sparkSession
    try:
        n_train, n_test = train.count(), test.count()
        known = None
        if any(isinstance(m, Linear) for m in models.values()) and grams.fits(train):
            known = grams.fold_moments(train, folds.pairs)
        told = threading.Lock()

        def work(k: int, name: str, model: Any) -> ModelResult:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{k % max(1, concurrent)}")
            if progress:
                with told:
                    progress(k, len(models), name)
            began, params = time.perf_counter(), None
            if tuned and name in GRIDS:
                try:
                    model, params = tune(name, model, train, folds, known)
                except Exception as e:  # noqa: BLE001 - a grid that can't be searched leaves the default
                    log.warning("%s: tuning failed, defaults are used: %s", name, e)
            fitted = model.fit(train, known.whole) if known and isinstance(model, Linear) else model.fit(train)
            seconds = time.perf_counter() - began
            metrics = evaluate(original_units(fitted.transform(test), transform), rows=n_test).first().asDict()
            on_train = evaluate(original_units(fitted.transform(train), transform), rows=n_train).first()
            metrics |= {"r2_train": on_train["r2"], "rmse_train": on_train["rmse"]}
            try:
                cv = cross_validate(model, train, folds, known) if folds.pairs else []
                metrics |= cv_summary(cv) if cv else {}
            except Exception as e:  # noqa: BLE001 - without scores the model still counts
                log.warning("%s: cross-validation failed: %s", name, e)
                cv = []
            return ModelResult(name, fitted, metrics, cv, seconds, fitted.importances, params)

        with ThreadPoolExecutor(max(1, min(concurrent, len(models)))) as pool:
            asked = [pool.submit(inheritable_thread_target(spark)(work), k, name, model) for k, (name, model) in enumerate(models.items(), start=1)]
            done = [a.result() for a in asked]
        return {r.name: r for r in done}
    finally:
        train.unpersist()
        test.unpersist()


def cv_summary(cv: list[dict[str, float]]) -> dict[str, float]:
    """Mean and population standard deviation of R2, and mean RMSE, over the folds."""
    r2 = [s["r2"] for s in cv]
    mean = sum(r2) / len(r2)
    return {"cv_r2_mean": mean, "cv_r2_std": math.sqrt(sum((x - mean) ** 2 for x in r2) / len(r2)), "cv_rmse_mean": sum(s["rmse"] for s in cv) / len(cv)}


RESULT_COLUMNS = (*METRICS, "r2_train", "rmse_train", "cv_r2_mean", "cv_r2_std", "cv_rmse_mean")


def results_table(spark: SparkSession, results: dict[str, ModelResult]) -> DataFrame:
    """A row for each model: model, position, the metrics and fit_seconds."""
    rows = [(n, k, *(None if r.metrics.get(c) is None else float(r.metrics[c]) for c in RESULT_COLUMNS), r.fit_seconds) for k, (n, r) in enumerate(results.items())]
    return spark.createDataFrame(rows, "model string, position int, " + ", ".join(f"{c} double" for c in RESULT_COLUMNS) + ", fit_seconds double")


def cv_table(spark: SparkSession, results: dict[str, ModelResult]) -> DataFrame:
    rows = [(n, k, float(s["r2"]), float(s["rmse"])) for n, r in results.items() for k, s in enumerate(r.cv)]
    return spark.createDataFrame(rows, "model string, fold int, r2 double, rmse double")


def importance_table(spark: SparkSession, results: dict[str, ModelResult], names: list[str]) -> DataFrame:
    """model, feature, importance; models whose importances don't match the features have none."""
    rows = [(n, f, float(v)) for n, r in results.items() if r.importances is not None and len(r.importances) == len(names) for f, v in zip(names, r.importances)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def ranked(metrics: DataFrame) -> DataFrame:
    """Metrics with `rank`: by RMSE, then by higher R2. A row for each model, so one small window."""
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy("rmse", F.desc("r2"), "model")))


def best_model(results: dict[str, ModelResult]) -> str:
    return min(results.values(), key=lambda r: (r.metrics["rmse"], -(r.metrics["r2"] or 0.0))).name


def metrics_table(metrics: DataFrame) -> DataFrame:
    """Rounded for display, by RMSE."""
    cut = {c: 2 if c == "mape_pct" else 4 for c in ("mae", "rmse", "r2", "median_ae", "mape_pct", "r2_train", "rmse_train", "cv_r2_mean", "cv_r2_std")}
    have = [c for c in cut if c in metrics.columns]
    more = [F.round("fit_seconds", 3).alias("fit_seconds")] if "fit_seconds" in metrics.columns else []
    return metrics.select("model", *(F.round(c, cut[c]).alias(c) for c in have), *more).orderBy("rmse", "model")


def winners(metrics: DataFrame) -> DataFrame:
    """metric, model: the best by rounded RMSE, MAE and R2; of equal ones the first by RMSE."""
    t = metrics.select("model", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 4).alias("r2"))
    pick = lambda metric, key: (metric, F.min_by("model", F.struct(key, F.col("rmse"), F.col("model"))))
    wins = [pick("rmse", F.col("rmse")), pick("mae", F.col("mae")), pick("r2", -F.col("r2"))]
    row = t.agg(F.array(*(F.struct(F.lit(m).alias("metric"), c.alias("model")) for m, c in wins)).alias("w"))
    return row.select(F.explode("w").alias("w")).select("w.*")
