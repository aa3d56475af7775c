"""The data behind diagnostic charts. predictions: label and prediction (and model, where many are shown)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.stats import equal_width_bin, normal_quantile_sql, order_median_sql
from lathe.operators.ordering import with_places
from lathe.options import HISTOGRAM_BINS, TOP_FEATURES

Y, P = "label", "prediction"


def predicted_vs_actual(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.col(Y).alias("actual"), F.col(P).alias("predicted"))


def diagonal(predictions: DataFrame) -> DataFrame:
    """low, high: the ends of the line on which predictions are right, over all models given."""
    return predictions.agg(F.least(F.min(Y), F.min(P)).alias("low"), F.greatest(F.max(Y), F.max(P)).alias("high"))


def residuals(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.col(P).alias("predicted"), (F.col(Y) - F.col(P)).alias("residual"))


def histogram(df: DataFrame, x: Column, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """bin (from 0), low, high, n of the bins that have rows; equal widths from the least to the largest value."""
    values = df.select(x.cast("double").alias("x")).where("x is not null")
    ends = values.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    if ends["low"] is None:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, n long")
    low, high = F.lit(ends["low"]), F.lit(ends["high"])
    width = (high - low) / bins
    counts = values.groupBy(equal_width_bin(F.col("x"), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "n")


def residual_histogram(predictions: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    return histogram(predictions, F.col(Y) - F.col(P), bins)


def target_histogram(df: DataFrame, target: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    return histogram(df, F.col(f"`{target}`"), bins)


def qq_points(predictions: DataFrame) -> DataFrame:
    """theoretical, sample: normal quantiles at the residuals' places against the residuals, a point each."""
    r = (F.col(Y) - F.col(P)).cast("double")
    placed, n = with_places(predictions.select(r.alias("sample")).where("sample is not null"), "sample", "i")
    m = placed.select("sample", F.expr(order_median_sql("cast(i as double)", f"{float(n)}D")).alias("m"))
    return m.select(F.expr(normal_quantile_sql("m")).alias("theoretical"), "sample")


def qq_line(points: DataFrame) -> DataFrame:
    """slope, intercept: the least-squares line through the points."""
    return points.agg(F.regr_slope("sample", "theoretical").alias("slope"), F.regr_intercept("sample", "theoretical").alias("intercept"))


def top_importances(importances: DataFrame, model: str, top: int = TOP_FEATURES) -> DataFrame:
    """feature, importance of a model's most important features."""
    return importances.where(F.col("model") == model).select("feature", "importance").orderBy(F.desc("importance"), "feature").limit(top)


def cv_box(cv: DataFrame) -> DataFrame:
    """For each model: low, q1, median, q3, high and mean of its folds' R2."""
    q = F.percentile("r2", F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    boxes = cv.groupBy("model").agg(q.alias("q"), F.avg("r2").alias("mean"))
    return boxes.select("model", *(F.col("q")[k].alias(name) for k, name in enumerate(("low", "q1", "median", "q3", "high"))), "mean")


def cv_points(cv: DataFrame) -> DataFrame:
    return cv.select("model", "r2")


def metric_bars(metrics: DataFrame, metric: str) -> DataFrame:
    """model, value: best first."""
    order = F.desc("value") if metric == "r2" else F.asc("value")
    return metrics.select("model", F.col(metric).alias("value")).orderBy(order, "model")


def error_bars(metrics: DataFrame) -> DataFrame:
    """model, metric, value for the error metrics."""
    return metrics.unpivot(["model"], ["mae", "rmse", "median_ae"], "metric", "value")


def fit_times(metrics: DataFrame) -> DataFrame:
    return metrics.select("model", "fit_seconds").orderBy("fit_seconds")


def overlay(predictions: DataFrame) -> DataFrame:
    """model, actual, predicted of all models."""
    return predictions.select("model", F.col(Y).alias("actual"), F.col(P).alias("predicted"))


def model_charts(predictions: DataFrame, cv: DataFrame, importances: DataFrame, model: str) -> dict[str, DataFrame]:
    """One model's charts by name; those without data are left out."""
    own = predictions.where(F.col("model") == model)
    charts = {"predicted_vs_actual": predicted_vs_actual(own), "residuals": residuals(own), "residual_histogram": residual_histogram(own), "qq": qq_points(own)}
    if cv.where(F.col("model") == model).limit(1).count():
        charts["cv"] = cv_box(cv.where(F.col("model") == model))
    if importances.where(F.col("model") == model).limit(1).count():
        charts["importance"] = top_importances(importances, model)
    return charts


def comparison_charts(predictions: DataFrame, metrics: DataFrame, cv: DataFrame) -> dict[str, DataFrame]:
    charts = {f"{m}_bars": metric_bars(metrics, m) for m in ("rmse", "mae", "r2")}
    charts |= {"error_bars": error_bars(metrics), "fit_times": fit_times(metrics), "overlay": overlay(predictions)}
    if cv.limit(1).count():
        charts["cv_points"] = cv_points(cv)
    return charts
