import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lathe.operators import features, profile
from lathe.options import Options
from lathe.plans.feature_plan import dates_to_expand, ids_to_drop
from lathe.sources import tables


def csv(tmp_path, text, name="t.csv"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_csv_contract(spark, tmp_path):
    df = tables.read_csv(spark, csv(tmp_path, ",n,x,flag,day,s\n0,1,1.5,true,2024-01-02,a\n1,NA,,False,2024-01-03,null\n2,3,2,true,N/A,c\n"))
    assert df.dtypes == [("Unnamed: 0", "bigint"), ("n", "bigint"), ("x", "double"), ("flag", "boolean"), ("day", "string"), ("s", "string")]
    assert [tuple(r) for r in df.orderBy("Unnamed: 0").collect()] == [(0, 1, 1.5, True, "2024-01-02", "a"), (1, None, None, False, "2024-01-03", None), (2, 3, 2.0, True, None, "c")]
    assert tables.read_csv(spark, None) is None
    assert tables.default_target(df) == "flag" and tables.numeric_columns(df) == ["Unnamed: 0", "n", "x", "flag"]


def test_dataset_of_three_files(spark, tmp_path):
    a, b = csv(tmp_path, "x,y\n1,2\n2,3\n", "a.csv"), csv(tmp_path, "x,y\n1,2\n", "b.csv")
    data = tables.read_dataset(spark, a, b, a)
    assert {r.split: (r.n_rows, r.n_cols) for r in tables.shapes(data).collect()} == {"train": (2, 2), "validation": (1, 2), "test": (2, 2)}
    assert tables.read_dataset(spark, a).test is None
    with pytest.raises(ValueError):
        tables.read_dataset(spark, "")


def test_normalized_rejects_nested_and_clears_nan(spark):
    df = spark.createDataFrame([(1.0, float("nan"))], "a double, b double").withColumn("d", F.lit(1).cast("decimal(5,2)"))
    row = tables.normalized(df).first()
    assert row.b is None and isinstance(row.d, float)
    with pytest.raises(ValueError, match="neither target nor feature"):
        tables.normalized(df.withColumn("v", F.array(F.lit(1))))


@pytest.mark.parametrize(
    "values,is_id",
    [([1, 2, 3, 4], True), ([4, 3, 2, 1], True), ([2, 1, 3, 4], False), ([1, None, 2, 3], False), ([1, 1, 2, 3], False), ([1.5, 2.0, 3.0, 4.0], False), ([7.0, 8.0, 9.0, 12.0], True)],
)
def test_id_by_values(spark, values, is_id):
    df = spark.createDataFrame([(i, None if v is None else float(v), float(i % 3)) for i, v in enumerate(values)], "o int, k double, y double")
    p = profile.profile(df.repartition(3), "y", ["o"])
    assert ("k" in p.named("id_like")) == is_id


def test_id_by_name_is_a_substring_test(spark):
    df = spark.createDataFrame([(1.5, 2.5, 1.0), (1.0, 2.0, 3.0)], "width double, depth double, y double")
    assert profile.profile(df, "y").named("id_like") == ["width"]


def days(share, n=100):
    good = round(n * share)
    return [f"2024-01-{1 + i % 28:02d}" if i < good else f"x{i}" for i in range(n)]


@pytest.mark.parametrize("values,kind", [(days(1.0), "datetime"), (days(0.86), "datetime"), (days(0.85), "categorical"), (["a"] * 4, "categorical"), ([None] * 4, "categorical"), (["20240102", "20240203"], "datetime"), (["01/02/2024", "13/40/2024", "02/03/2024"], "categorical"), (["Jan 2 2024", "Feb 3 2024"], "datetime"), (["10", "R", "MAIL"], "categorical")])
def test_datetime_strings(spark, values, kind):
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(values)], "d string, y double").coalesce(1)
    assert profile.profile(df, "y").columns[0].kind == kind


def test_profile_against_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"y": rng.gamma(2.0, size=500), "x": rng.normal(size=500), "c": rng.choice(list("abc"), 500), "many": [f"v{i % 30}" for i in range(500)], "one": "k"})
    pdf.loc[::7, "x"], pdf.loc[::5, "c"], pdf.loc[::11, "y"] = np.nan, None, np.nan
    df = tables.normalized(spark.createDataFrame(pdf))
    p = profile.profile(df, "y")
    assert math.isclose(p.stats["skew"], pdf.y.skew(), rel_tol=1e-9) and math.isclose(p.stats["std"], pdf.y.std(), rel_tol=1e-9)
    assert p.stats["missing"] == pdf.y.isna().sum() and p.missing_total == pdf.isna().sum().sum()
    by = {c.name: c for c in p.columns}
    for c in ("x", "c", "many", "one"):
        assert (by[c].missing, by[c].unique, by[c].missing_pct) == (pdf[c].isna().sum(), pdf[c].nunique(), round(pdf[c].isna().mean() * 100, 2))
    assert p.high_cardinality == ["many"] and p.low_variance == ["one"] and [c for c, _ in p.missing_most()] == ["c", "x"]
    assert [c.name for c in p.without(["x"]).columns] == ["c", "many", "one"] and p.without(["x"]).missing_total == p.missing_total - by["x"].missing


def test_profile_reads_little(spark, tmp_path):
    spark.range(10).select("id", (F.col("id") * 2.0).alias("x"), F.lit("t").alias("unused")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = profile.target_stats(df.select("x"), "x")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<x:double>" in plan


def test_skew_of_few_and_constant_values(spark):
    for values in ([1.0, 2.0], [3.0] * 5, []):
        df = spark.createDataFrame([(v,) for v in values], "y double")
        assert profile.target_stats(df, "y").first().skew == 0.0


def test_decisions_protect_columns(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 3, 1.0), (2, "2024-01-02", 3, 2.0)], "row_id int, when_ string, user_id int, y double").coalesce(1)
    p = profile.profile(df, "y")
    assert ids_to_drop(p, Options("y")) == ["row_id", "user_id"]
    assert ids_to_drop(p, Options("y", time_column="row_id", group_column="user_id")) == []
    assert ids_to_drop(p, Options("y", group_column="user_id", strict_compat=True)) == ["row_id", "user_id"]
    assert ids_to_drop(p, Options("y", auto_drop_id_columns=False)) == []
    assert list(dates_to_expand(p, Options("y"))) == ["when_"]
    assert dates_to_expand(p, Options("y", split_strategy="time", time_column="when_")) == {} == dates_to_expand(p, Options("y", auto_datetime_features=False))


def test_options_from_controls_and_checks():
    o = Options.from_controls("y", time_aware=True, group_column="(none)", time_column="t")
    assert (o.cv_strategy, o.split_strategy, o.group_column, o.time_column) == ("time", "time", None, "t")
    assert Options.from_controls("y", time_aware=True, group_column="g").cv_strategy == "group"
    for bad in ({"cv_strategy": "x"}, {"split_strategy": "x"}, {"test_size": 0.0}, {"cv_folds": 1}):
        with pytest.raises(ValueError):
            Options("y", **bad)


def test_dates_hours_and_zones(spark):
    df = spark.createDataFrame([("2024-02-29 05:10:00",), ("bad",), ("2024-03-01T00:00:00+02:00",), (None,)], "d string")
    dates = {"d": "iso"}
    hours = features.columns_with_hours(df, dates)
    got = [tuple(r) for r in features.date_parts(df, dates, hours).collect()]
    assert got == [(2024, 2, 29, 3, 5), (None,) * 5, (2024, 2, 29, 3, 22), (None,) * 5]
    assert features.date_parts(df, {"absent": None}, []).columns == ["d"]
