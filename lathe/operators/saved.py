"""Fitted models of every kind as files: facts as JSON text, tables as Parquet, Spark's own models by their writers."""

from __future__ import annotations

import importlib
import json
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.linalg import DenseVector
from pyspark.sql import SparkSession

from lathe.operators.deep_forest import _KIND, DeepForestModel
from lathe.operators.grams import LinearModel
from lathe.operators.kernel import KernelModel, facts
from lathe.operators.models import Fitted, FourierModel
from lathe.operators.neighbours import NeighboursModel


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def save_fitted(spark: SparkSession, fitted: Any, path: str) -> None:
    """path/kind says how to read the rest. What lies under path is overwritten."""
    inner = getattr(fitted, "model", None)
    if isinstance(fitted, NeighboursModel):
        fitted.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        kind = {"kind": "neighbours", "k": fitted.k, "pivots": fitted.pivots.tolist(), "segments": fitted.segments.to_dict("list")}
    elif isinstance(fitted, KernelModel):
        if fitted.blocks is not None:
            fitted.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        kind = {"kind": "kernel", **facts(fitted)}
    elif isinstance(fitted, FourierModel):
        kind = {"kind": "fourier", "w": fitted.w.tolist(), "phase": fitted.phase.tolist(), "theta": fitted.theta.tolist()}
    elif isinstance(fitted, DeepForestModel):
        trees = fitted.subtrees
        if trees is None:
            trees = spark.createDataFrame([(t, leaf, bytearray(n.tobytes())) for (t, leaf), n in fitted.small.items()], "tree int, leaf int, nodes binary")
        trees.select("tree", "leaf", "nodes").write.mode("overwrite").parquet(f"{path}/trees")
        kind = {"kind": "deep forest", "few": fitted.subtrees is None, "tops": [t.tolist() for t in fitted.tops], "importances": fitted.importances, "bundle": fitted.bundle}
    elif isinstance(inner, LinearModel):
        kind = {"kind": "linear", "coefficients": inner.coefficients.toArray().tolist(), "intercept": inner.intercept}
    elif hasattr(inner, "write"):
        inner.write().overwrite().save(f"{path}/model")
        kind = {"kind": "spark", "module": type(inner).__module__, "class": type(inner).__name__}
    else:
        raise ValueError(f"{type(inner or fitted).__name__} has no writer")
    write_json(spark, kind, f"{path}/kind")


def load_fitted(spark: SparkSession, path: str) -> Any:
    kind = read_json(spark, f"{path}/kind")
    if kind["kind"] == "neighbours":
        return NeighboursModel(spark.read.parquet(f"{path}/blocks"), np.array(kind["pivots"], float), pd.DataFrame(kind["segments"]), kind["k"])
    if kind["kind"] == "kernel":
        whole = "x" in kind
        x, weights = (np.array(kind["x"], float).reshape(len(kind["weights"]), -1), np.array(kind["weights"], float)) if whole else (None, None)
        return KernelModel(x, weights, None if whole else spark.read.parquet(f"{path}/blocks"), kind["gamma"], kind["intercept"])
    if kind["kind"] == "fourier":
        return FourierModel(*(np.array(kind[c], float) for c in ("w", "phase", "theta")))
    if kind["kind"] == "deep forest":
        trees = spark.read.parquet(f"{path}/trees")
        small = {(r["tree"], r["leaf"]): np.frombuffer(r["nodes"], _KIND) for r in trees.collect()} if kind["few"] else None
        return DeepForestModel([np.array([tuple(n) for n in t], _KIND) for t in kind["tops"]], small, None if kind["few"] else trees, kind["importances"], kind.get("bundle", 0))
    if kind["kind"] == "linear":
        return Fitted(LinearModel(DenseVector(kind["coefficients"]), kind["intercept"]))
    return Fitted(getattr(importlib.import_module(kind["module"]), kind["class"]).load(f"{path}/model"))
