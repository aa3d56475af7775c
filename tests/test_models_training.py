import json
import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import lathe
from lathe.operators import audit, charts, models, training
from lathe.plans import codegen, reports
from lathe.plans.analysis import analyze, load_model, prepare, save_model
from lathe.sources.tables import Dataset
from lathe.streaming.scoring import score_stream, write_scores


def table(spark, x, y):
    rows = [(Vectors.dense(a.tolist()), float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, ["features", "label"])


def problem(n=300, width=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    return x, x @ np.arange(1, width + 1) + rng.normal(size=n) + 5


def coordinate_descent(x, y, l1, l2, rounds=3000):
    xc, yc, w, n = x - x.mean(0), y - y.mean(), np.zeros(x.shape[1]), len(x)
    for _ in range(rounds):
        for j in range(x.shape[1]):
            r = yc - xc @ w + xc[:, j] * w[j]
            z = xc[:, j] @ r / n
            w[j] = np.sign(z) * max(abs(z) - l1, 0) / (xc[:, j] @ xc[:, j] / n + l2)
    return w


def test_linear_family_matches_closed_forms(spark):
    x, y = problem()
    df = table(spark, x, y)
    xc, yc = x - x.mean(0), y - y.mean()
    coef = lambda m: m.fit(df).model.coefficients.toArray()
    assert np.allclose(coef(models.Linear()), np.linalg.lstsq(xc, yc, rcond=None)[0], atol=1e-6)
    assert np.allclose(coef(models.Linear(alpha=30.0, ridge=True)), np.linalg.solve(xc.T @ xc + 30 * np.eye(3), xc.T @ yc), atol=1e-6)
    assert np.allclose(coef(models.Linear(alpha=0.5, l1_ratio=1.0)), coordinate_descent(x, y, 0.5, 0.0), atol=1e-4)
    assert np.allclose(coef(models.Linear(alpha=0.8, l1_ratio=0.3)), coordinate_descent(x, y, 0.24, 0.56), atol=1e-4)
    constant = table(spark, x, np.full(len(x), 3.0))
    assert models.Linear(alpha=1.0, ridge=True).fit(constant).transform(constant).first().prediction == pytest.approx(3.0)


def plain_knn(train_x, train_y, x, k):
    out = []
    for q in x:
        order = sorted(range(len(train_x)), key=lambda i: (((train_x[i] - q) ** 2).sum(), train_y[i]))
        out.append(np.mean([train_y[i] for i in order[:k]]))
    return np.array(out)


@pytest.mark.parametrize("width,block", [(2, 64), (12, 4096)])
def test_neighbours_are_exact(spark, width, block):
    x, y = problem(260, width)
    fitted = models.Neighbours(5, block).fit(table(spark, x[:200], y[:200]).repartition(3))
    got = fitted.transform(table(spark, x[200:], y[200:]).repartition(2)).collect()
    want = dict(zip(map(tuple, x[200:].tolist()), plain_knn(x[:200], y[:200], x[200:], 5)))
    assert len(got) == 60 and all(math.isclose(r.prediction, want[tuple(r.features.toArray())], rel_tol=1e-9) for r in got)
    assert fitted.importances is None


def test_trees_and_kernel_learn(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, size=(600, 2))
    y = np.sin(2 * x[:, 0]) * 3 + x[:, 1] ** 2 + 10
    train, test = table(spark, x[:450], y[:450]), table(spark, x[450:], y[450:])
    for m, least in ((models.Tree(8), 0.85), (models.Forest(10, 8), 0.9), (models.Boosting(25), 0.9), (models.KernelSVR(C=5.0), 0.9), (models.FourierSVR(components=128, steps=40, C=5.0), 0.9)):
        fitted = m.fit(train)
        assert training.evaluate(fitted.transform(test)).first().r2 > least
        if fitted.importances is not None:
            assert math.isclose(sum(fitted.importances), 1.0, rel_tol=1e-6)


def test_wrapped_estimators_and_zoo(spark):
    from pyspark.ml.regression import DecisionTreeRegressor

    x, y = problem(80)
    df = table(spark, x, y)
    w = models.with_params(models.Wrapped(DecisionTreeRegressor()), {"maxDepth": 1})
    assert w.fit(df).transform(df).select("prediction").distinct().count() == 2
    zoo = models.default_models(7)
    assert list(zoo)[:9] == ["LinearRegression", "Ridge", "Lasso", "ElasticNet", "DecisionTree", "RandomForest", "GradientBoosting", "KNN", "SVR"]
    assert zoo["DecisionTree"].seed == 7 and len(training.grid_of("RandomForest")) == 6 and training.grid_of("LinearRegression") == []


def pairs(spark, rows):
    return spark.createDataFrame([(float(a), float(b)) for a, b in rows], "label double, prediction double")


def test_metrics_edges(spark):
    m = training.evaluate(pairs(spark, [(1, 2), (0, 1), (4, 2), (3, 3)])).first()
    assert (m.mae, m.mse, m.median_ae) == (1.0, 1.5, 1.0) and m.mape_pct == pytest.approx((1 + 0.5 + 0) / 3 * 100)
    assert m.r2 == pytest.approx(1 - 6 / 10)
    assert training.evaluate(pairs(spark, [(0, 1), (0, 2)])).first().mape_pct is None
    assert training.evaluate(pairs(spark, [(2, 2), (2, 2)])).first().r2 == 1.0
    assert training.evaluate(pairs(spark, [(2, 2), (2, 3)])).first().r2 == 0.0


def test_cross_validation_and_tuning(spark):
    x, y = problem(100)
    df = table(spark, x, y).withColumn("fold", F.pmod(F.xxhash64("label"), F.lit(4)).cast("int"))
    folds = training.Folds.by_column("fold", 4)
    cv = training.cross_validate(models.Linear(), df, folds)
    s = training.cv_summary(cv)
    assert len(cv) == 4 and s["cv_r2_mean"] == pytest.approx(np.mean([c["r2"] for c in cv])) and s["cv_r2_std"] == pytest.approx(np.std([c["r2"] for c in cv]))
    best, params = training.tune("Ridge", models.Linear(alpha=1.0, ridge=True), df, folds)
    by = {a: np.mean([c["rmse"] for c in training.cross_validate(models.Linear(alpha=a, ridge=True), df, folds)]) for a in (0.1, 1.0, 10.0)}
    assert params == {"alpha": min(by, key=by.get)} and best.alpha == params["alpha"]


def scores(spark, rows):
    return spark.createDataFrame(rows, "model string, mae double, rmse double, r2 double, r2_train double")


def test_ranking_winners_and_flags(spark):
    t = scores(spark, [("a", 3.0, 2.0, 0.5, 0.64), ("b", 1.0, 2.0, 0.6, 0.76), ("c", 2.0, 9.0, -0.1, 0.11), ("d", 2.0, 2.00001, 0.99995, 1.0)])
    assert [r.model for r in training.ranked(t).orderBy("rank").collect()] == ["b", "a", "d", "c"]
    assert {r.metric: r.model for r in training.winners(t).collect()} == {"rmse": "a", "mae": "b", "r2": "d"}
    assert {r.model: (r.overfit, r.perfect) for r in audit.overfit_flags(t).collect()} == {"a": (False, False), "b": (True, False), "c": (True, False), "d": (False, True)}
    found = {(r.rule, r.subject) for r in audit.score_findings(t, False).collect()}
    assert found == {("perfect_fit", "d"), ("overfit", "c"), ("worse_than_mean", "c")}


def test_audit_and_its_report(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0, float(i % 3)) for i in range(30)], "y double, leak double, flat double, other double")
    t = scores(spark, [("m", 0.0, 0.0, 0.99999, 0.99999)])
    found = audit.findings(df, "y", t, std=1e-12, skew=-2.5, n_features=50, n_train=24, log_requested=False)
    assert [(r.rule_order, r.rule, r.subject) for r in found.orderBy("rule_order").collect()] == [(1, "leakage", "leak"), (2, "degenerate_target", "y"), (3, "skewed_target", "y"), (4, "wide_data", "y"), (5, "perfect_fit_with_leak", "m")]
    assert len(audit.report(spark, found).splitlines()) == 6
    calm = audit.findings(df.drop("leak"), "y", scores(spark, []), std=1.0, skew=2.5, n_features=5, n_train=24, log_requested=True)
    assert calm.count() == 0 and "nothing" in audit.report(spark, calm)


def test_charts(spark):
    p = pairs(spark, [(i, i + (i % 7) - 3) for i in range(200)])
    assert charts.residual_histogram(p).agg(F.sum("n")).first()[0] == 200 and charts.residual_histogram(p, 5).count() == 5
    assert charts.histogram(pairs(spark, [(2, 1), (2, 5)]), F.col("label")).first().n == 2
    assert charts.histogram(p.limit(0), F.col("label")).count() == 0
    d = charts.diagonal(p).first()
    assert (d.low, d.high) == (-3.0, 199.0)
    import statistics

    n = 200
    points = [r.theoretical for r in charts.qq_points(p).orderBy("theoretical").collect()]
    m = [1 - 0.5 ** (1 / n), *((i - 0.3175) / (n + 0.365) for i in range(2, n)), 0.5 ** (1 / n)]
    assert np.allclose(points, [statistics.NormalDist().inv_cdf(v) for v in m], atol=1e-7)
    n = 25_000
    many = charts.qq_points(spark.range(n).select(F.floor(F.col("id") * 7919 % n / 3).cast("double").alias("label"), F.lit(0.0).alias("prediction")))
    found = sorted((r.sample, r.theoretical) for r in many.collect())
    m = [1 - 0.5 ** (1 / n), *((i - 0.3175) / (n + 0.365) for i in range(2, n)), 0.5 ** (1 / n)]
    assert [s for s, _ in found] == sorted(float(k * 7919 % n // 3) for k in range(n))
    assert np.allclose([t for _, t in found], [statistics.NormalDist().inv_cdf(v) for v in m], atol=1e-7)
    assert charts.qq_points(p.limit(0)).count() == 0
    long = charts.error_bars(spark.createDataFrame([("m", 1.0, 2.0, 3.0)], "model string, mae double, rmse double, median_ae double"))
    assert sorted((r.metric, r.value) for r in long.collect()) == [("mae", 1.0), ("median_ae", 3.0), ("rmse", 2.0)]
    top = charts.top_importances(spark.range(40).select(F.lit("m").alias("model"), F.col("id").cast("string").alias("feature"), F.col("id").cast("double").alias("importance")), "m")
    assert top.count() == 20 and "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def sales(spark, n=240):
    rng = np.random.default_rng(5)
    rows = [(i, f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}", str(rng.choice(["red", "blue"])), f"s{i % 30}", float(rng.normal()), None if i % 50 == 0 else float(abs(rng.normal()) + i % 12)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id int, day string, colour string, shop string, size double, y double").coalesce(2)


QUICK = {"LinearRegression": models.Linear(), "DecisionTree": models.Tree(4)}


def test_whole_analysis(spark, tmp_path):
    seen = []
    r = analyze(sales(spark), lathe.Options("y", cv_folds=3, models=QUICK, log_transform_target=True, progress=lambda s, m: seen.append(s)))
    s = r.prepared.summary
    assert s["id_like_columns_dropped"] == ["row_id"] and s["datetime_cols_extracted"] == ["day"] and s["target_transform"] == "log1p"
    assert (s["n_train"], s["n_test"]) == (188, 47) and "day_year" in s["low_variance_dropped"] and s["high_cardinality_categorical"] == ["shop"]
    assert [t[0] for t in r.timeline] == ["profile", "prepare", "train", "audit"] and set(seen) == {"profile", "prepare", "train", "audit"}
    assert r.best == r.metrics.orderBy("rank").first().model and r.cv.count() == 6
    assert r.predictions().count() == 94 and set(r.model_charts()) >= {"qq", "cv", "importance"} and "overlay" in r.comparison_charts()
    assert r.predictions().agg(F.max("label")).first()[0] > 10  # original units
    for text in (reports.profile_report(r.profile), reports.preparation_report(r.prepared), reports.training_report(r), reports.best_report(r)):
        assert text
    assert training.metrics_table(r.metrics).count() == 2
    save_model(r, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    got = back.score(sales(spark), ["row_id"]).collect()
    assert len(got) == 240 and all(g.prediction is not None for g in got)
    sales(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sales(spark).schema).parquet(str(tmp_path / "in"))
    write_scores(score_stream(stream, back, ["row_id"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = {x.row_id: x.prediction for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == pytest.approx({g.row_id: g.prediction for g in got})
    with pytest.raises(ValueError):
        score_stream(sales(spark), back, [])


@pytest.mark.parametrize("cv,split", [("time", "time"), ("group", "random"), ("time", "random")])
def test_fold_strategies(spark, cv, split):
    o = lathe.Options("y", cv_folds=3, cv_strategy=cv, split_strategy=split, time_column="day", group_column="shop" if cv == "group" else None, models={"LinearRegression": models.Linear()})
    p = prepare(Dataset(sales(spark)), o)
    assert p.train.count() + p.test.count() == 235
    r = training.train_and_evaluate(p.train, p.test, o.models, p.folds)
    assert len(r["LinearRegression"].cv) == 3
    assert ("day_month" in p.features.names) == (split == "random") and not any(n.startswith("shop") for n in p.features.names) == (cv == "group")


def test_supplied_splits_and_missing_columns(spark):
    df = sales(spark)
    p = prepare(Dataset(df.where("row_id < 150"), df.where("row_id between 150 and 180").drop("colour").withColumn("colour", F.lit("green")), df.where("row_id > 180")), lathe.Options("y", cv_folds=2))
    assert (p.summary["n_train"], p.summary["n_val"], p.summary["n_test"]) == (147, 30, 58)
    assert p.summary["split_strategy_used"] == "as supplied" and p.validation.first().features is not None


def test_errors_and_selection(spark):
    with pytest.raises(ValueError, match="no model"):
        analyze(sales(spark), lathe.Options("y", selected_models=("Nope",)))
    with pytest.raises(ValueError):
        analyze(sales(spark), lathe.Options("colour"))
    r = analyze(sales(spark), lathe.Options("y", selected_models=("DecisionTree",), models=QUICK, cv_folds=2, tune_hyperparameters=False))
    assert list(r.results) == ["DecisionTree"]


def test_generated_script_runs(spark, tmp_path):
    sales(spark).coalesce(1).toPandas().to_csv(tmp_path / "s.csv", index=False)
    o = lathe.Options("y", selected_models=("LinearRegression",), cv_folds=2)
    text = codegen.script(o, str(tmp_path / "s.csv"))
    book = json.loads(codegen.notebook(text))
    assert book["nbformat"] == 4 and sum(c["cell_type"] == "code" for c in book["cells"]) == 10
    codegen.write(str(tmp_path / "run.py"), text)
    import os

    done = subprocess.run(["timeout", "240", sys.executable, "run.py"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": os.getcwd()}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "LinearRegression" in done.stdout and (tmp_path / "best_model" / "about").exists()
