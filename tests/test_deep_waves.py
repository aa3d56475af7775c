"""Labels that go up and down along a feature: trees are deep, but neither scans nor searches are many."""

import numpy as np
import pytest

from lathe.operators import deep_forest
from tests.test_models_training import table


def waves(n):
    rng = np.random.default_rng(4)
    x = np.c_[rng.permutation(n).astype(float), rng.integers(0, 5, n), rng.normal(size=n)]
    return x, x[:, 0] % 100 + rng.normal(size=n) / 100


def depth(tree):
    level, deep = np.zeros(1, int), 0
    while len(level):
        level = level[tree["feature"][level] >= 0]
        level = np.r_[tree["left"][level], tree["left"][level] + 1]
        deep += 1
    return deep


def test_waves_take_few_scans(spark):
    x, y = waves(4000)
    df = table(spark, x, y).repartition(4)
    fitted = deep_forest.DeepForest(1, bootstrap=False, local_rows=500).fit(df)
    assert 4 < depth(fitted.tops[0]) < 18
    assert all(r.prediction == pytest.approx(r.label) for r in fitted.transform(df).collect())


@pytest.mark.parametrize("narrow", [1, 256])
def test_large_nodes_split_as_small_ones_do(monkeypatch, narrow):
    x, y = waves(3000)
    w = np.random.default_rng(6).integers(1, 4, 3000).astype(float)
    monkeypatch.setattr(deep_forest, "NARROW", narrow)
    monkeypatch.setattr(deep_forest, "SMALL", 10**6)
    level_wise, gained = deep_forest.grow(x, y, w, 12)  # deeper nodes of few rows have equally good splits
    monkeypatch.setattr(deep_forest, "BLOCK", 64)
    monkeypatch.setattr(deep_forest, "SMALL", 40)
    one_by_one, gained_too = deep_forest.grow(x, y, w, 12)
    assert gained_too == pytest.approx(gained)
    assert one_by_one["value"][deep_forest.leaf_of(one_by_one, x)] == pytest.approx(level_wise["value"][deep_forest.leaf_of(level_wise, x)])
    whole, _ = deep_forest.grow(x, y, w)
    leaves = deep_forest.leaf_of(whole, x)
    assert depth(whole) > 30 and (whole["value"][leaves] == y).all()
    q = x + np.random.default_rng(7).normal(size=x.shape)
    parts = deep_forest.flat(whole)
    assert (deep_forest.find(parts, x) == leaves).all() and (deep_forest.find(parts, q) == deep_forest.leaf_of(whole, q)).all()


def test_trees_meet_queries_in_bundles(spark, monkeypatch):
    x, y = waves(600)
    df = table(spark, x, y).repartition(4)
    read = lambda m: {r.label: r.prediction for r in m.transform(df).collect()}
    want = read(deep_forest.DeepForest(5, local_rows=150).fit(df))
    monkeypatch.setattr(deep_forest, "BROADCAST_BYTES", 10)
    for size, bundle in ((10**5, range(2, 10)), (1, range(1))):
        monkeypatch.setattr(deep_forest, "BUNDLE_BYTES", size)
        fitted = deep_forest.DeepForest(5, local_rows=150).fit(df)
        assert fitted.small is None and fitted.bundle in bundle and read(fitted) == pytest.approx(want)
