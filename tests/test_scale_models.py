"""Linear models from moments, exact neighbours by pruning, medians by refinement, saved models."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lathe.operators import deep_forest, grams, kernel, models, neighbours, saved, selection, training
from tests.test_models_training import coordinate_descent, plain_knn, problem, table


def folded(spark, x, y, k=4):
    rows = [(Vectors.dense(a.tolist()), float(b), i % k) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["features", "label", "fold"]).repartition(3)


def test_grids_over_folds_equal_single_fits(spark):
    x, y = problem(400, 5)
    x[:, 4] = x[:, 0] * 2 + 0.3 * x[:, 4]  # correlated
    df = folded(spark, x, y)
    folds = training.Folds.by_column("fold", 4)
    points = [models.Linear(), *(models.Linear(alpha=a, ridge=True) for a in (0.1, 10.0)), *(models.Linear(alpha=a, l1_ratio=r) for a in (0.01, 0.3) for r in (0.3, 1.0))]
    grid = training.linear_grid(df, folds, points)
    f = np.arange(400) % 4
    for m, scores in zip(points, grid):
        for k, s in enumerate(scores):
            tx, ty = x[f != k], y[f != k]
            xc, yc = tx - tx.mean(0), ty - ty.mean()
            if not m.alpha:
                w = np.linalg.lstsq(xc, yc, rcond=None)[0]
            elif m.ridge:
                w = np.linalg.solve(xc.T @ xc + m.alpha * np.eye(5), xc.T @ yc)
            else:
                w = coordinate_descent(tx, ty, m.alpha * m.l1_ratio, m.alpha * (1 - m.l1_ratio), 6000)
            e = y[f == k] - (x[f == k] - tx.mean(0)) @ w - ty.mean()
            assert s["rmse"] == pytest.approx(math.sqrt((e**2).mean()), rel=1e-8)
            assert s["r2"] == pytest.approx(1 - (e**2).sum() / ((y[f == k] - y[f == k].mean()) ** 2).sum(), abs=1e-8)
            single = m.fit(df.where(F.col("fold") != k)).model
            assert np.allclose(single.coefficients.toArray(), w, atol=1e-6)


def test_moments_hold_far_from_zero_and_in_expanding_folds(spark):
    x, y = problem(300, 2)
    df = folded(spark, x + 1e6, y + 1e7, 5)
    folds = training.Folds.expanding("fold", 4)
    for s, (fit_on, test_on) in zip(training.cross_validate(models.Linear(), df, folds), folds.pairs):
        scored = models.Linear().fit(df.where(fit_on)).transform(df.where(test_on))
        row = training.evaluate(scored, rows=300).first()
        assert s["rmse"] == pytest.approx(row["rmse"], rel=1e-5) and s["r2"] == pytest.approx(row["r2"], abs=1e-5)


def test_constant_columns_and_targets(spark):
    x = np.c_[np.arange(40.0), np.full(40, 7.0)]
    df = folded(spark, x, np.full(40, 3.0))
    fitted = models.Linear(alpha=0.1, l1_ratio=1.0).fit(df)
    assert fitted.model.coefficients.toArray().tolist() == [0.0, 0.0] and fitted.model.intercept == pytest.approx(3.0)
    assert all(s["r2"] == 1.0 for s in training.cross_validate(models.Linear(), df, training.Folds.by_column("fold", 4)))
    y = folded(spark, x, np.arange(40.0))
    assert models.Linear().fit(y).transform(y).agg(F.max(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        models.Linear().fit(df.limit(0), None) if grams.fits(df) and grams.fold_moments(df.limit(0), []) else None


def test_wide_models_score_by_pairs(spark):
    x, y = problem(120, 70)
    df = table(spark, x, y)
    got = models.Linear(alpha=1.0, ridge=True).fit(df).transform(df).select("label", "prediction").collect()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(70), xc.T @ yc)
    want = {float(a): float(b) for a, b in zip(y, xc @ w + y.mean())}
    assert all(r.prediction == pytest.approx(want[r.label]) for r in got)


@pytest.mark.parametrize(("k", "pivots", "block"), [(1, 4, 16), (5, 32, 64), (7, 128, 4096), (1000, 8, 50)])
def test_neighbours_by_pruning_are_exact(spark, k, pivots, block):
    rng = np.random.default_rng(k)
    centres = rng.normal(scale=50, size=(6, 3))
    x = np.round(np.concatenate([c + rng.normal(size=(60, 3)) for c in centres]), 1)
    x[:120] = x[0]  # a third of the rows is one point
    y = rng.integers(0, 9, len(x)).astype(float)
    q = np.concatenate([x[::40] + 0.05, centres, [[1e4, 0, 0], x[0].tolist(), x[0].tolist()]])
    fitted = models.Neighbours(k, block, pivots).fit(table(spark, x, y).repartition(3))
    df = spark.createDataFrame([(i, Vectors.dense(a.tolist())) for i, a in enumerate(q)], ["i", "features"])
    got = {r.i: r.prediction for r in fitted.transform(df).collect()}
    want = plain_knn(x, y, q, k)
    assert len(got) == len(q) and all(got[i] == pytest.approx(w, rel=1e-9) for i, w in enumerate(want))
    work = fitted.work(df).first()
    assert work.queries == len(np.unique(q, axis=0)) and work.compared <= work.pairs
    if k <= 7:
        assert work.compared < work.pairs / 2
    fitted.release()


@pytest.mark.parametrize("limit", [1, 20, 10**6])
def test_medians_by_refinement(spark, limit):
    rng = np.random.default_rng(4)
    groups = {
        "even": rng.normal(size=200).tolist(),
        "odd": (10 ** rng.uniform(-300, 300, size=301)).tolist(),
        "ties": [0.0] * 150 + [1.0] * 150,
        "near": [0.0] * 149 + [0.5] + [1.0] * 150,
        "one": [4.0],
        "same": [2.5] * 90,
        None: [-5.0, 5.0, 7.0, 1e308],
        "nulls": [],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("nulls", None), ("even", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r.m for r in selection.group_medians(df, ["g"], F.col("v"), "m", limit).collect()}
    want = {g: float(np.median(v)) for g, v in groups.items() if v}
    assert {g: m for g, m in got.items() if g != "nulls"} == pytest.approx(want)
    alone = selection.group_medians(df, [], F.col("v"), "m", limit).first().m
    assert alone == pytest.approx(float(np.median([v for vs in groups.values() for v in vs])))


def test_metrics_are_the_same_whether_rows_are_known(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(f"m{i % 3}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(500, 2)))]
    df = spark.createDataFrame(rows, "model string, label double, prediction double")
    known = {r.model: r for r in training.evaluate(df, by=["model"], rows=500).collect()}
    monkeypatch.setattr(selection.group_medians, "__defaults__", ("median", 10))
    unknown = {r.model: r for r in training.evaluate(df, by=["model"]).collect()}
    assert known.keys() == unknown.keys()
    for g, r in known.items():
        assert all(unknown[g][c] == pytest.approx(r[c]) for c in training.METRICS)


@pytest.mark.parametrize("model", [models.Linear(), models.Linear(alpha=0.1, l1_ratio=0.5), models.Tree(3), models.Forest(3, 3), models.Forest(3), models.Tree(None), models.Boosting(3), models.Neighbours(3), models.KernelSVR(), models.FourierSVR(components=16, steps=5)], ids=lambda m: type(m).__name__)
def test_every_model_can_be_saved(spark, tmp_path, model):
    x, y = problem(80)
    df = table(spark, x, y)
    fitted = model.fit(df)
    saved.save_fitted(spark, fitted, str(tmp_path / "m"))
    again = saved.load_fitted(spark, str(tmp_path / "m"))
    read = lambda m: {r.label: r.prediction for r in m.transform(df).collect()}
    assert read(again) == pytest.approx(read(fitted), rel=1e-12)
    saved.save_fitted(spark, fitted, str(tmp_path / "m"))


def test_what_has_no_writer(spark, tmp_path):
    with pytest.raises(ValueError, match="no writer"):
        saved.save_fitted(spark, models.Fitted(object()), str(tmp_path / "m"))


def test_neighbours_blocks_cover_all_rows(spark):
    x, y = problem(500)
    fitted = models.Neighbours(3, 32, 16).fit(table(spark, x, y))
    assert fitted.segments["rows"].sum() == 500 and isinstance(fitted, neighbours.NeighboursModel)


def dense_dual(x, y, C, epsilon, gamma):
    """Weights and level by pairwise steps on the whole kernel matrix, to a hundredth of the tolerance."""
    k, n = kernel.gaussian(x, x, gamma), len(x)
    b, f = np.zeros(n), np.zeros(n)
    for _ in range(200_000):
        up = np.where(b < C, f - y + np.where(b >= 0, epsilon, -epsilon), np.inf)
        down = np.where(b > -C, f - y + np.where(b > 0, epsilon, -epsilon), -np.inf)
        i, j = up.argmin(), down.argmax()
        if down[j] - up[i] < 1e-5:
            break
        t = min((down[j] - up[i]) / max(2 - 2 * k[i, j], 1e-12), -b[i] if b[i] < 0 else C - b[i], b[j] if b[j] > 0 else b[j] + C)
        b[i], b[j] = b[i] + t, b[j] - t
        b[[i, j]] = np.where(np.abs(b[[i, j]]) < 1e-12, 0, b[[i, j]])
        f += t * (k[:, i] - k[:, j])
    return b, -(down.max() + up.min()) / 2, k


@pytest.mark.parametrize(("n", "C", "epsilon", "work"), [(300, 1.0, 0.1, 100), (300, 50.0, 0.01, 150), (2000, 1.0, 0.1, 1024)])
def test_kernel_regression_solves_its_dual(spark, n, C, epsilon, work):
    rng = np.random.default_rng(n)
    x = rng.uniform(-2, 2, size=(n, 2))
    y = np.sin(2 * x[:, 0]) * 3 + x[:, 1] ** 2 + rng.normal(scale=0.2, size=n)
    fitted = models.KernelSVR(C=C, epsilon=epsilon, working_set=work).fit(table(spark, x, y).repartition(3))
    assert fitted.gap <= 1e-3 and fitted.rounds > 0
    b = {tuple(v): w for v, w in zip(fitted.x.tolist(), fitted.weights)}
    own = np.array([b.get(tuple(v), 0.0) for v in x.tolist()])
    assert abs(own.sum()) < 1e-8 and np.abs(own).max() <= C
    k = kernel.gaussian(x, x, fitted.gamma)
    up, down = kernel.slopes(own, k @ own - y, C, epsilon)
    assert down.max() - up.min() <= 1.1e-3  # the conditions, from the whole matrix
    if n < 1000:
        want, level, _ = dense_dual(x, y, C, epsilon, fitted.gamma)
        value = lambda w: w @ k @ w / 2 - y @ w + epsilon * np.abs(w).sum()
        assert value(own) == pytest.approx(value(want), rel=1e-5)
        got = {r.label: r.prediction for r in fitted.transform(table(spark, x, y)).collect()}
        assert all(abs(got[float(a)] - p) < 0.01 for a, p in zip(y, k @ want + level))


def test_many_support_vectors_stay_a_table(spark, monkeypatch):
    x, y = problem(150, 2)
    df = table(spark, x, y)
    few = {r.label: r.prediction for r in models.KernelSVR().fit(df).transform(df).collect()}
    monkeypatch.setattr(kernel, "BROADCAST_BYTES", 100)
    fitted = models.KernelSVR().fit(df)
    assert fitted.x is None and {r.label: r.prediction for r in fitted.transform(df).collect()} == pytest.approx(few)


def test_kernel_regression_of_a_constant(spark):
    x, _ = problem(20, 2)
    df = table(spark, x, np.full(20, 4.0))
    assert all(abs(r.prediction - 4.0) <= 0.1 for r in models.KernelSVR().fit(df).transform(df).collect())


def test_a_tree_without_limit_fits_distinct_rows_exactly(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 40, size=(900, 3)).astype(float)
    x = np.unique(x, axis=0)
    y = rng.normal(size=len(x))
    x[:4, 2], y[:4] = 100.0, [1.0, -1.0, -1.0, 1.0]  # no single split of these gains anything
    x[:4, :2] = [[0, 0], [0, 1], [1, 0], [1, 1]]
    chain = np.arange(300.0)  # a chain that needs depth: each split takes one row
    for tx, ty in ((x, y), (chain[:, None], 3.0**chain)):
        fitted = deep_forest.DeepForest(1, bootstrap=False).fit(table(spark, tx, ty).repartition(3))
        got = {tuple(r.features.toArray()): (r.label, r.prediction) for r in fitted.transform(table(spark, tx, ty)).collect()}
        assert all(a == pytest.approx(b, rel=1e-9) for a, b in got.values())
    assert sum(fitted.importances) == pytest.approx(1.0)


def test_trees_split_over_tasks_and_within_one_agree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, y = problem(1200, 3)
    x = np.round(x * 4)  # fewer values than bins: histograms are exact
    y = x[:, 0] ** 2 - 3 * x[:, 1] + rng.normal(size=1200)
    df = table(spark, x, y).repartition(4)
    read = lambda m: {tuple(r.features.toArray()): r.prediction for r in m.transform(df).collect()}
    whole = deep_forest.DeepForest(1, bootstrap=False).fit(df)
    parts = deep_forest.DeepForest(1, bootstrap=False, local_rows=100).fit(df)
    assert len(parts.tops[0]) > 5 and read(parts) == pytest.approx(read(whole))
    monkeypatch.setattr(deep_forest, "BROADCAST_BYTES", 10)
    table_ = deep_forest.DeepForest(1, bootstrap=False, local_rows=100).fit(df)
    assert table_.small is None and read(table_) == pytest.approx(read(whole))


def test_deep_forests_generalise(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, size=(700, 2))
    y = np.sin(2 * x[:, 0]) * 3 + x[:, 1] ** 2 + rng.normal(scale=0.3, size=700)
    fitted = models.Forest(40).fit(table(spark, x[:500], y[:500]))
    tree = models.Tree(None).fit(table(spark, x[:500], y[:500]))
    r2 = lambda m: training.evaluate(m.transform(table(spark, x[500:], y[500:])), rows=200).first().r2
    assert r2(fitted) > 0.93 and r2(fitted) > r2(tree)
    w = deep_forest.weights(np.arange(100_000), 3, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03


def test_depth_limits_beyond_sparks(spark):
    chain = np.arange(200.0)
    t = table(spark, chain[:, None], 3.0**chain)
    some, more = (len({r.prediction for r in models.Tree(d).fit(t).transform(t).collect()}) for d in (31, 60))
    assert some < more < 200
