"""What went wrong only on larger tables, on small ones that have the same fault."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lathe.functions.stats import sample_skewness
from lathe.operators import audit, deep_forest, features, models, neighbours
from tests.test_models_training import plain_knn, table


def test_constants_over_many_partitions_have_no_correlation(spark):
    df = spark.range(0, 94 * 40, 1, 40).select(F.col("id").alias("y"), (F.col("id") % 7).alias("x"), F.lit(3).alias("three"))  # 3 / 94 * 94 isn't 3
    assert df.agg(F.stddev_pop("three")).first()[0] != 0
    got = {r["column"]: r["correlation"] for r in audit.target_correlations(df, "y").collect()}
    assert got["x"] is not None and got["three"] is None
    assert audit.target_correlations(df.select("three", "y"), "three").first()["correlation"] is None
    assert df.agg(sample_skewness(F.col("three").cast("double"))).first()[0] == 0.0


def test_more_rows_make_more_and_not_larger_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 4, raising=False)
    monkeypatch.setattr(neighbours, "PIVOTS", 8)
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(size=(2_000, 9)) * [9, 5, 3, 1, 1, 0, 0, 0, 0], 1)  # distances by products
    y, q = rng.integers(0, 9, 2_000).astype(float), x[::50] + 0.01
    fitted = models.Neighbours().fit(table(spark, x, y))
    df = spark.createDataFrame([(i, Vectors.dense(a.tolist())) for i, a in enumerate(q)], ["i", "features"])
    got = {r.i: r.prediction for r in fitted.transform(df).collect()}
    assert len(fitted.pivots) > 400 and all(got[i] == pytest.approx(w) for i, w in enumerate(plain_knn(x, y, q, 5)))
    work = fitted.work(df).first()
    assert work.queries == len(q) and work.compared < work.pairs / 10


def test_work_places_each_row_and_compares_each_pair_once(spark, monkeypatch):
    placed, compared = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    cells, visit = neighbours._cells, neighbours._visit

    def counted_cells(x, pivots):
        placed.add(len(x))
        return cells(x, pivots)

    def counted_visit(row):
        found = visit(row)
        compared.add(row["rows"] * len(found[-1]))
        return found

    monkeypatch.setattr(neighbours, "_cells", counted_cells)
    monkeypatch.setattr(neighbours, "_visit", counted_visit)
    rng = np.random.default_rng(4)
    x = np.unique(np.round(rng.uniform(size=(600, 2)) * 50, 2), axis=0)
    q = np.concatenate([x[::20] + 0.01, x[:2] + 0.01])
    fitted = models.Neighbours(3, 64, 16).fit(table(spark, x, x[:, 0]).repartition(5))
    work = fitted.work(spark.createDataFrame([(Vectors.dense(a.tolist()),) for a in q], ["features"])).first()
    queries = len(np.unique(q, axis=0))
    assert (work.queries, work.train_rows, work.pairs) == (queries, len(x), queries * len(x))
    assert placed.value == len(x) + queries
    assert compared.value == work.compared < work.pairs / 2
    fitted.release()


@pytest.mark.parametrize("n", [2, 300])
def test_work_on_odd_queries(spark, n):
    nan, inf = float("nan"), float("inf")
    x = np.arange(2.0 * n).reshape(n, 2)
    fitted = models.Neighbours(3, 32, 8).fit(table(spark, np.concatenate([x, x]), np.concatenate([x[:, 0], x[:, 0]])))
    df = spark.createDataFrame([(Vectors.dense(a),) for a in ([1.0, 2.0], [1.0, 2.0], [nan, 1.0], [nan, nan], [inf, 0.0])], ["features"])
    some = fitted.work(df.limit(2)).first()
    assert (some.queries, some.train_rows, some.pairs) == (1, n, n) and 0 < some.compared <= n
    whole = fitted.work(df).first()  # a query of unknown features has no neighbours
    assert (whole.queries, whole.train_rows, whole.compared) == (2, n, n + some.compared)
    assert tuple(fitted.work(df.limit(0)).first()) == (0, n, 0, 0)
    fitted.release()


def test_medians_of_many_rows_sort_only_the_middle(spark, monkeypatch):
    monkeypatch.setattr(features, "AGGREGATE_MEDIAN_ROWS", 0)
    sorted_rows = []
    order_rows = features.order_rows
    monkeypatch.setattr(features, "order_rows", lambda df, *a: sorted_rows.append(df.count()) or order_rows(df, *a))
    rng = np.random.default_rng(5)
    v = rng.normal(size=(6_000, 3))
    v[:, 1] = np.round(v[:, 1])  # few values: nothing to sort
    v[:3_000, 2], v[3_000:, 2] = 1.0, 2.0  # the middle ones differ
    df = spark.createDataFrame([(*map(float, r), float(i) if i % 3 else None) for i, r in enumerate(v)], "a double, b double, c double, d double").repartition(5)
    got = features.exact_medians(df, ["a", "b", "c", "d"])
    assert got == {"a": float(np.median(v[:, 0])), "b": float(np.median(v[:, 1])), "c": 1.5, "d": float(np.median([i for i in range(6_000) if i % 3]))}
    assert len(sorted_rows) == 3 and sorted(sorted_rows)[1] < 200


def test_a_large_forest_meets_its_queries_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(600, 3)), rng.normal(size=600)
    df = table(spark, x, y).repartition(4)
    read = lambda m: {r.label: r.prediction for r in m.transform(df).collect()}
    want = read(deep_forest.DeepForest(3, local_rows=150).fit(df))
    monkeypatch.setattr(deep_forest, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(deep_forest, "QUERIES", 250, raising=False)  # three slices
    fitted = deep_forest.DeepForest(3, local_rows=150).fit(df)
    assert fitted.small is None and read(fitted) == pytest.approx(want)
    plan = fitted.transform(df)._jdf.queryExecution().toString()
    assert "CoGroupsInArrow" in plan  # not a join that copies a subtree for each block of queries
