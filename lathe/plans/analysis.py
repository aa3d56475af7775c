"""The whole analysis: profile, plan, split, features, training, ranking, audit, charts, script."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.operators import audit, charts, splits
from lathe.operators.features import LABEL, FeatureModel, can_log, check_target, columns_with_hours, constant_columns, date_parts, drop_missing_target, fit_features
from lathe.operators.models import PREDICTION, default_models
from lathe.operators.profile import Profile, profile, quoted
from lathe.operators.saved import load_fitted, read_json, save_fitted, write_json
from lathe.operators.training import Folds, ModelResult, best_model, cv_table, importance_table, original_units, ranked, results_table, train_and_evaluate
from lathe.options import Options
from lathe.plans.feature_plan import FeaturePlan, dates_to_expand, ids_to_drop
from lathe.sources.tables import ROW_KEY, Dataset, normalized

FOLD = "_fold"


@dataclass
class Prepared:
    """Feature tables (`features`, `label`, and folds for train) and what was decided on the way."""

    plan: FeaturePlan
    features: FeatureModel
    train: DataFrame
    test: DataFrame
    validation: DataFrame | None
    folds: Folds
    transform: str
    summary: dict[str, Any]


@dataclass
class AnalysisResult:
    options: Options
    profile: Profile
    prepared: Prepared
    results: dict[str, ModelResult]
    best: str
    metrics: DataFrame
    cv: DataFrame
    importances: DataFrame
    findings: DataFrame
    timeline: list[tuple[str, float, float]] = field(default_factory=list)

    def predictions(self, split: str = "test", models: list[str] | None = None) -> DataFrame:
        """model, label, prediction in original units, of all (or some) models."""
        rows = {"train": self.prepared.train, "test": self.prepared.test, "validation": self.prepared.validation}[split]
        if rows is None:
            raise ValueError(f"there is no {split} table")
        parts = [original_units(self.results[m].model.transform(rows), self.prepared.transform).select(F.lit(m).alias("model"), LABEL, PREDICTION) for m in models or self.results]
        return reduce(DataFrame.unionByName, parts)

    def comparison_charts(self) -> dict[str, DataFrame]:
        return charts.comparison_charts(self.predictions(), self.metrics, self.cv)

    def model_charts(self, model: str | None = None) -> dict[str, DataFrame]:
        name = model or self.best
        return charts.model_charts(self.predictions(models=[name]), self.cv, self.importances, name)


def prepare(data: Dataset, options: Options, known: Profile | None = None) -> Prepared:
    """From raw tables to feature tables. known: a profile of the training table without missing targets."""
    t = options.target
    check_target(t, data.train, data.validation, data.test)
    frames = {"train": data.train, "validation": data.validation, "test": data.test}
    frames = {k: None if df is None else drop_missing_target(normalized(df), t) for k, df in frames.items()}
    main = frames["train"].withColumn(ROW_KEY, F.monotonically_increasing_id())
    if main.sparkSession.conf.get("spark.checkpoint.dir", None):
        main = main.checkpoint()  # keys stay the same when an executor is lost; without a shared folder, a cache has to do
    main = main.persist()
    p = known or profile(main.drop(ROW_KEY), t)
    ids = ids_to_drop(p, options)
    p = p.without(ids)
    dates = dates_to_expand(p, options)
    hours = columns_with_hours(main, dates)

    def derived(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else date_parts(df.drop(*ids), dates, hours)

    main, validation, test = derived(main), derived(frames["validation"]), derived(frames["test"])
    constant = constant_columns(main, {t, ROW_KEY}) if options.drop_low_variance else []
    main, validation, test = (None if df is None else df.drop(*constant) for df in (main, validation, test))
    key = [ROW_KEY]
    if test is not None:
        train, how = main, "as supplied"
    else:
        whole, how = splits.split(main, key, options.split_strategy, options.time_column, options.test_size, options.random_state)
        train, test, validation = whole.where("split = 'train'").drop("split"), whole.where("split = 'test'").drop("split"), None
    group = options.group_column if options.group_column in train.columns else None
    when = options.time_column if options.time_column in train.columns else None
    folds, train = _with_folds(train, options, group, when)
    inputs = [c for c in train.columns if c not in (t, ROW_KEY, FOLD, group) and not (c == when and options.split_strategy == "time")]
    features = fit_features(train, t, inputs)
    logged = options.log_transform_target and can_log(t, train, test, validation)
    made = {}
    for name, df in (("train", train), ("test", test), ("validation", validation)):
        out = None if df is None else features.transform(df, [FOLD] if name == "train" else [])
        made[name] = out.withColumn(LABEL, F.log1p(LABEL)) if logged and out is not None else out
    plan = FeaturePlan(t, ids, dates, hours, constant, when, group)
    summary = {
        "n_train": made["train"].count(),
        "n_val": 0 if made["validation"] is None else made["validation"].count(),
        "n_test": made["test"].count(),
        "n_features_after": len(features.names),
        "numeric_cols": features.numeric,
        "low_cardinality_categorical": list(features.one_hot),
        "high_cardinality_categorical": list(features.frequency),
        "datetime_cols_extracted": list(dates),
        "low_variance_dropped": constant,
        "id_like_columns_dropped": ids,
        "split_strategy_used": how,
        "target_transform": "log1p" if logged else "none",
        "test_size": options.test_size,
        "random_state": options.random_state,
        "group_column": group,
    }
    return Prepared(plan, features, made["train"], made["test"], made["validation"], folds, summary["target_transform"], summary)


def _with_folds(train: DataFrame, options: Options, group: str | None, when: str | None) -> tuple[Folds, DataFrame]:
    k = options.cv_folds
    if options.cv_strategy == "time":
        order = splits.time_order(when, [ROW_KEY]) if when else [F.col(ROW_KEY)]
        f = splits.time_folds(train, order, k)
        return Folds.expanding(FOLD, k), train.withColumn(FOLD, f.block)
    if options.cv_strategy == "group" and group:
        return Folds.by_column(FOLD, k), splits.group_kfold(train, group, k).withColumnRenamed("fold", FOLD)
    return Folds.by_column(FOLD, k), splits.kfold(train, [ROW_KEY], k).withColumnRenamed("fold", FOLD)


def analyze(data: Dataset | DataFrame, options: Options) -> AnalysisResult:
    data = data if isinstance(data, Dataset) else Dataset(data)
    spark, timeline = data.train.sparkSession, []

    def stage(name: str, message: str, work):
        options.report(name, message)
        began = time.time()
        out = work()
        timeline.append((name, began, time.time()))
        return out

    t = options.target
    check_target(t, data.train, data.validation, data.test)
    models = options.models or default_models(options.random_state)
    if options.selected_models:
        models = {k: m for k, m in models.items() if k in options.selected_models}
    if not models:
        raise ValueError("no model is selected")
    raw = normalized(data.train)
    p = stage("profile", "profiling columns and target", lambda: profile(raw, t))
    clean = p if not p.stats["missing"] else None  # else the rows without target go first
    prepared = stage("prepare", "preparing features and splits", lambda: prepare(data, options, clean))
    say = lambda k, n, name: options.report("train", f"{name} ({k} of {n})")
    results = stage("train", "training models", lambda: train_and_evaluate(prepared.train, prepared.test, models, prepared.folds, transform=prepared.transform, tuned=options.tune_hyperparameters, progress=say))
    metrics = ranked(results_table(spark, results))
    found = stage("audit", "auditing the run", lambda: audit.findings(raw, t, metrics, std=p.stats["std"], skew=p.stats["skew"], n_features=len(prepared.features.names), n_train=prepared.summary["n_train"], log_requested=options.log_transform_target))
    return AnalysisResult(options, p, prepared, results, best_model(results), metrics, cv_table(spark, results), importance_table(spark, results, prepared.features.names), found, timeline)


def save_model(result: AnalysisResult, path: str) -> None:
    """The best model, of any kind, under path/model, tables of what prepares its features under path/frequency_*,
    and facts about both as JSON under path/about."""
    spark = result.metrics.sparkSession
    save_fitted(spark, result.results[result.best].model, f"{path}/model")
    f = result.prepared.features
    for k, (_, shares) in enumerate(f.frequency.items()):
        shares.write.mode("overwrite").parquet(f"{path}/frequency_{k}")
    about = {
        "best": result.best,
        "target": f.target,
        "transform": result.prepared.transform,
        "numeric": f.numeric,
        "frequency": list(f.frequency),
        "one_hot": f.one_hot,
        "medians": f.medians,
        "modes": f.modes,
        "means": f.means,
        "stds": f.stds,
        "names": f.names,
        "dropped": [*result.prepared.plan.dropped_ids, *result.prepared.plan.dropped_constant],
        "dates": result.prepared.plan.dates,
        "with_hour": result.prepared.plan.with_hour,
    }
    write_json(spark, about, f"{path}/about")


@dataclass
class SavedModel:
    """A model read back: scores raw tables, or streams if no column is frequency-encoded by a stream."""

    about: dict[str, Any]
    features: FeatureModel
    model: Any

    def score(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """keep's columns with `prediction` in original units."""
        a = self.about
        rows = normalized(df)
        kept = {f"_keep{k}": quoted(c) for k, c in enumerate(keep or [])}
        rows = date_parts(rows.withColumns(kept), a["dates"], a["with_hour"])
        out = self.model.transform(self.features.transform(rows, list(kept)))
        p = F.expm1(PREDICTION) if a["transform"] == "log1p" else F.col(PREDICTION)
        return out.select(*(F.col(k).alias(c) for k, c in zip(kept, keep or [])), p.alias(PREDICTION))


def load_model(spark, path: str) -> SavedModel:
    about = read_json(spark, f"{path}/about")
    frequency = {c: spark.read.parquet(f"{path}/frequency_{k}") for k, c in enumerate(about["frequency"])}
    features = FeatureModel(about["target"], about["numeric"], frequency, about["one_hot"], about["medians"], about["modes"], about["means"], about["stds"], about["names"])
    return SavedModel(about, features, load_fitted(spark, f"{path}/model"))
