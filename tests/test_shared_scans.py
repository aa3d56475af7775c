"""Several results from one scan of a table."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.operators import grams, ordering, splits
from lathe.queries import QUERIES

LINES = "l_quantity double, l_discount double, l_tax double, l_linenumber int, l_extendedprice double"


def lines(spark, tmp_path, rows):
    spark.createDataFrame(rows, LINES).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_importances_of_single_features_share_a_scan(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.c_[rng.uniform(1, 50, 300), rng.integers(0, 11, 300) / 100, np.full(300, 0.25), rng.integers(1, 8, 300)]
    y = 40 * x[:, 0] - 900 * x[:, 1] + 5 * x[:, 3] + rng.normal(size=300)
    rows = [(*map(float, a[:3]), int(a[3]), float(b)) for a, b in zip(x, y)]
    rows += rows[:40] + [(*r[:4], None) for r in rows[:30]]  # repeated rows, and rows without a price
    scans, moments = [], grams.moments
    monkeypatch.setattr(grams, "moments", lambda df, pattern: scans.append(len(df.columns)) or moments(df, pattern))
    got = {r["feature"]: r["importance"] for r in QUERIES["chart_importance_top"](spark, lines(spark, tmp_path, rows)).collect()}
    x, y = np.concatenate([x, x[:40]]), np.concatenate([y, y[:40]])
    slopes = {c: abs(np.polyfit(x[:, k], y, 1)[0]) for c, k in (("l_quantity", 0), ("l_discount", 1), ("l_linenumber", 3))}
    assert got == pytest.approx(slopes, rel=1e-4)  # the constant one has no slope and is not among the first three
    assert len(scans) == 1


@pytest.mark.parametrize(("rows", "said"), [([], None), ([(1.0, 0.1, 0.2, 1, None)], "no rows to fit"), ([(1.0, None, 0.2, 1, 3.0), (2.0, 0.1, 0.2, 1, 3.0)], "assembl|FAILED_EXECUTE_UDF")])
def test_importances_of_no_rows_or_unknown_features_are_refused(spark, tmp_path, rows, said):
    with pytest.raises(Exception, match=said):
        QUERIES["chart_importance_top"](spark, lines(spark, tmp_path, rows)).collect()


def test_random_split_finds_its_bound_in_one_scan(spark):
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: read.add(1) or v, "long")
    df = spark.range(0, 6000, 1, 5).select(seen("id").alias("k"))
    s = splits.random_split(df, ["k"])
    assert read.value == 6000
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"test": 1200, "train": 4800}
    assert read.value == 12_000


def split_by_hand(keys, size, seed=42):
    """How many rows of each key are in the test part: those up to the last test row, in the order of their hashes with nulls first."""
    order = lambda k: (hashlib.md5(":".join([str(seed), *(str(v) for v in k if v is not None)]).encode()).hexdigest(), [(v is not None, v or 0) for v in k])
    n = min(len(keys), math.ceil(round(len(keys) * size, 9)))
    last = order(sorted(keys, key=order)[n - 1]) if n > 0 else ("", [])
    return Counter(k for k in keys if order(k) <= last)


@pytest.mark.parametrize("size", [0.0, 0.01, 0.2, 0.5, 0.999, 1.0])
@pytest.mark.parametrize("name", ["none", "one", "few", "many", "repeated", "frequent", "unknown"])
def test_random_split_of_odd_keys(spark, name, size):
    keys = {
        "none": [],
        "one": [(7, 1)],
        "few": [(k, k % 3) for k in range(11)],
        "many": [(k, -k) for k in range(3000)],
        "repeated": [(k // 4, 1) for k in range(1000)],
        "frequent": [(5, 5)] * 700 + [(k, 0) for k in range(900)],  # the hash of a key that many rows share is far from where hashes would be evenly spread
        "unknown": [(None, None)] * 30 + [(None, k) for k in range(200)] + [(k, None) for k in range(200)],
    }[name]
    df = spark.createDataFrame(keys, "a long, b int").repartition(3)
    got = splits.random_split(df, ["a", "b"], size).groupBy("a", "b", "split").count().collect()
    assert {(r["a"], r["b"]): r["count"] for r in got if r["split"] == "test"} == split_by_hand(keys, size)
    assert sum(r["count"] for r in got) == len(keys) and {r["split"] for r in got} <= {"test", "train"}


@pytest.mark.parametrize("parts", [1, 3, None])
def test_places_of_rows_that_count_several_times(spark, parts):
    times = {None: 2, 1: 3, 4: 1, 6: 500, 9: 4}
    df = spark.createDataFrame(list(times.items()), "v int, n long").repartition(2)
    places = [v for v, n in times.items() for _ in range(n)]
    got = ordering.order_rows(df, [F.col("v")], [-1, 0, 1, 2, 4, 5, 6, 300, 505, 506, 509, 510], "n", parts)
    assert got == {r: (places[r],) for r in (0, 1, 2, 4, 5, 6, 300, 505, 506, 509)}
