import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lathe.operators import features, ordering, splits


def numbers(spark, n, parts=3):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 37 % 101).cast("double").alias("t"), F.lit(1.0).alias("y")).repartition(parts)


@pytest.mark.parametrize("n,size,want", [(13, 0.2, 3), (10, 0.2, 2), (1, 0.2, 1), (7, 0.5, 4), (100, 0.15, 15)])
def test_random_split_is_exact_and_independent_of_partitions(spark, n, size, want):
    members = []
    for parts in (1, 4, 16):
        s = splits.random_split(numbers(spark, n, parts), ["k"], size)
        members.append(sorted(r.k for r in s.where("split = 'test'").collect()))
        assert s.count() == n
    assert len(members[0]) == want and members[0] == members[1] == members[2]
    if n > 50:
        other = splits.random_split(numbers(spark, n), ["k"], size, seed=7)
        assert sorted(r.k for r in other.where("split = 'test'").collect()) != members[0]


def test_time_split_puts_unknown_times_last(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(-i)) for i in range(20)], "k int, t double")
    s = splits.time_split(df, "t", ["k"], 0.25)
    test = {r.k for r in s.where("split = 'test'").collect()}
    assert test == {0, 4, 8, 12, 16}
    fallback, how = splits.split(df, ["k"], "time", "none", 0.25)
    assert fallback.where("split = 'test'").count() == 5 and how.startswith("random")


def test_kfold_sizes_and_small_tables(spark):
    sizes = sorted(r["count"] for r in splits.kfold(numbers(spark, 13), ["k"]).groupBy("fold").count().collect())
    assert sizes == [2, 2, 3, 3, 3]
    few = splits.kfold(numbers(spark, 3), ["k"], 5)
    assert few.count() == 3 and few.select("fold").distinct().count() == 3


def greedy(sizes, folds):
    loads = [0] * folds
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return sorted(loads)


@pytest.mark.parametrize("sizes", [[7, 3, 2, 1], [1] * 23, [50, 1, 1, 1, 1, 1, 1], [5, 5, 5, 4, 4, 3, 3, 3, 2, 1, 1, 1]])
@pytest.mark.parametrize("folds", [2, 3, 5])
def test_group_folds_are_greedy_and_whole(spark, sizes, folds):
    rows = [(f"g{g}" if g else None, g) for g, s in enumerate(sizes) for _ in range(s)]
    placed = splits.group_kfold(spark.createDataFrame(rows, "g string, x int").repartition(4), "g", folds)
    assert placed.count() == len(rows)
    assert placed.groupBy("x").agg(F.count_distinct("fold").alias("k")).agg(F.max("k")).first()[0] == 1
    loads = [r["count"] for r in placed.groupBy("fold").count().collect()]
    assert sorted(loads + [0] * (folds - len(loads))) == greedy(sizes, folds)


def test_time_folds_never_train_on_the_future(spark):
    df = numbers(spark, 47)
    order = splits.time_order("t", ["k"])
    f = splits.time_folds(df, order, 5)
    rows = df.withColumn("block", f.block)
    assert [(r.fold, r.n_train, r.n_test) for r in splits.time_series_folds(df, order, 5).orderBy("fold").collect()] == [(k, 47 - (5 - k) * 7, 7) for k in range(5)]
    for k in range(1, 6):
        train = rows.where(F.col("block") < k).agg(F.max(F.struct("t", "k")).alias("m")).first().m
        test = rows.where(F.col("block") == k).agg(F.min(F.struct("t", "k")).alias("m")).first().m
        assert tuple(train) < tuple(test)
    with pytest.raises(ValueError):
        splits.time_folds(numbers(spark, 4), order, 5)


def test_rows_at_places(spark):
    df = spark.createDataFrame([(None,), (3,), (1,), (2,), (2,)], "v int").repartition(3)
    got = ordering.order_rows(df, [F.col("v")], [0, 1, 3, 4, 9, -1])
    assert got == {0: (None,), 1: (1,), 3: (2,), 4: (3,)}
    plan_rows = df.withColumn("p", ordering.place_among([F.col("v")], [(None,), (2,)])).collect()
    assert sorted((r.v or 0, r.p) for r in plan_rows) == [(0, 0), (1, 1), (2, 1), (2, 1), (3, 2)]


@pytest.mark.parametrize("small", [True, False])
def test_exact_medians(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(features, "AGGREGATE_MEDIAN_ROWS", 0)
    df = spark.createDataFrame([(1.0, 5, None), (4.0, None, None), (2.0, 7, None), (3.0, 1, None)], "a double, b int, c double")
    assert features.exact_medians(df, ["a", "b", "c"]) == {"a": 2.5, "b": 5.0, "c": None}


def test_mode_takes_the_least_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",), (None,), (None,)], "s string")
    assert features.modes(df, ["s"]) == {"s": "a"}


def frame():
    rng = np.random.default_rng(0)
    n = 120
    pdf = pd.DataFrame({"k": range(n), "x": rng.normal(size=n), "c": rng.choice(list("xyz"), n), "brand": [f"b{(i * 7 + i // 9) % 26}" for i in range(n)], "y": rng.normal(size=n)})
    pdf.loc[::9, "x"], pdf.loc[::8, "c"] = np.nan, None
    return pdf


def test_features_against_pandas(spark):
    pdf = frame()
    train, test = pdf[:100], pdf[100:].assign(c=lambda d: ["new" if i % 2 else v for i, v in enumerate(d.c)], brand=lambda d: ["b3" if i % 3 else None for i in range(len(d))])
    to = lambda d: spark.createDataFrame(d.astype(object).where(d.notna(), None), "k long, x double, c string, brand string, y double")
    m = features.fit_features(to(train), "y", ["x", "c", "brand"])
    assert m.names == ["x", "brand", "c_x", "c_y", "c_z"]
    filled = train.x.fillna(train.x.median())
    share = train.brand.value_counts(normalize=True)
    coded = train.brand.map(share)
    top = train.c.value_counts().sort_index().idxmax()
    for part in (train, test):
        want = pd.DataFrame({"f0": (part.x.fillna(train.x.median()) - filled.mean()) / filled.std(ddof=0), "f1": (part.brand.map(share).fillna(0.0) - coded.mean()) / coded.std(ddof=0)})
        for j, v in enumerate("xyz"):
            want[f"f{j + 2}"] = (part.c.fillna(top) == v).astype(float)
        got = m.flat(to(part), ["k"]).toPandas().sort_values("k")
        assert np.allclose(got[want.columns].to_numpy(float), want.to_numpy(float))
    out = m.transform(to(test), ["k"])
    assert out.columns == ["k", "label", "features"] and len(out.first().features) == 5
    scaled = m.flat(to(train), []).toPandas()
    assert abs(scaled.f0.mean()) < 1e-9 and math.isclose(scaled.f0.std(ddof=0), 1.0)


def test_equal_frequencies_are_constant(spark):
    df = spark.createDataFrame([(f"b{i % 25}", 1.0) for i in range(100)], "s string, y double")
    m = features.fit_features(df, "y", ["s"])
    assert m.names == ["s"] and all(abs(r.f0) < 1e-12 for r in m.flat(df, []).collect())


def test_frequency_join_is_broadcast_when_small(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "s string, y double")
    out = features.frequency_encode(df, "s", features.frequencies(df, "s"))
    out.collect()
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_target_checks_and_log_guard(spark):
    a = spark.createDataFrame([(1.0, "s"), (None, "t"), (float("nan"), "u")], "y double, s string")
    assert features.drop_missing_target(a, "y").count() == 1
    for target, kw in (("no", {}), ("s", {}), ("y", {"test": a.drop("y")}), ("y", {"validation": a.drop("y")})):
        with pytest.raises(ValueError):
            features.check_target(target, a, **kw)
    low = spark.createDataFrame([(-1.0,)], "y double")
    assert features.can_log("y", a.where("s = 's'"), None) and not features.can_log("y", a.where("s = 's'"), low)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, None, "a", 1), (1, None, None, 2)], "one int, none double, some string, two int")
    assert features.constant_columns(df, {"two"}) == ["one", "none", "some"]


def test_more_than_so_many_values(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") > 59_990, F.col("id")).alias("late"), F.lit(None).cast("string").alias("none"), F.lit("x").alias("b c"))
    assert features.with_more_than(df, df.columns, 2) == {"a", "late"} and features.with_more_than(df, df.columns, 3) == {"late"}
    assert features.constant_columns(df, {"late"}) == ["none", "b c"] and features.with_more_than(df, [], 1) == set()
