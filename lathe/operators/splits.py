"""Train / test splits and cross-validation folds.

Random ones rank rows by the md5 of seed and row key, so membership doesn't depend on partitions. Every
split is a comparison with a few rows at known places of an order (`ordering`), not a global window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.operators.ordering import at_most, order_rows, place_among, row_by_prefix
from lathe.options import FOLD_SEED

SPLIT, FOLD = "split", "fold"
#: Prefixes that three digits of a hash make, and how far from its expected part of them a bound is looked for first.
PREFIXES, NEAR = 16**3, 1 / 64


def shuffled(key: list[str], seed: int) -> list[Column]:
    """An order that is as good as random."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(f"`{k}`").cast("string") for k in key))
    return [F.md5(text), *(F.col(f"`{k}`") for k in key)]


def random_split(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """df with `split`: "test" for exactly ceil(n * test_size) rows, else "train"."""
    order = shuffled(key, seed)
    # The hash at the last test row is about this part of all hashes.
    low, high = (min(max(int((test_size + gap) * PREFIXES), 0), PREFIXES - 1) for gap in (-NEAR, NEAR))
    bound = row_by_prefix(df, order, lambda n: min(n, math.ceil(round(n * test_size, 9))) - 1, f"{low:03x}", f"{high:03x}")
    return df.withColumn(SPLIT, F.when(at_most(order, bound), "test").otherwise("train") if bound else F.lit("train"))


def time_order(time_column: str, key: list[str]) -> list[Column]:
    """By time with unknown ones last, then by key."""
    t = F.col(f"`{time_column}`")
    return [t.isNull(), t, *(F.col(f"`{k}`") for k in key)]


def time_split(df: DataFrame, time_column: str, key: list[str], test_size: float = 0.2) -> DataFrame:
    """df with `split`: the first floor(n * (1 - test_size)) rows by time are "train"."""
    n_train = int(df.count() * (1 - test_size))
    order = time_order(time_column, key)
    bound = order_rows(df, order, [n_train - 1]).get(n_train - 1)
    return df.withColumn(SPLIT, F.when(at_most(order, bound), "train").otherwise("test") if bound else F.lit("test"))


def split(df: DataFrame, key: list[str], strategy: str = "random", time_column: str | None = None, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, str]:
    """df with `split`, and what was done: a time split without its column is random."""
    if strategy == "time" and time_column in df.columns:
        return time_split(df, time_column, key, test_size), f"by time ({time_column})"
    done = "random" if strategy != "time" else "random, for want of the time column"
    return random_split(df, key, test_size, seed), done


def kfold(df: DataFrame, key: list[str], folds: int = 5, seed: int = FOLD_SEED) -> DataFrame:
    """df with `fold`: a shuffled order cut into equal folds, of which the first n mod folds have one row more."""
    n = df.count()
    ends, at = [], 0
    for k in range(folds - 1):
        at += n // folds + (k < n % folds)
        ends.append(at - 1)
    order = shuffled(key, seed)
    rows = order_rows(df, order, ends)
    early = sum(e < 0 for e in ends)  # empty folds of very small tables
    return df.withColumn(FOLD, (place_among(order, [rows[e] for e in ends if e in rows]) + early).cast("int"))


def group_plan(sizes: dict[int, int], folds: int) -> dict[int, tuple[list[int], list[int]]]:
    """Largest groups first, each to the fold with the fewest rows so far. sizes: group size to number of
    groups. For each size: the folds of its first groups, then a cycle for the rest (once the folds'
    rows differ by no more than the size, equal groups go round in the order of the rows)."""
    loads = [0] * folds
    out = {}
    for size in sorted(sizes, reverse=True):
        left, first = sizes[size], []
        while left and max(loads) - min(loads) > size:
            k = loads.index(min(loads))
            first.append(k)
            loads[k] += size
            left -= 1
        cycle = sorted(range(folds), key=lambda k: (loads[k], k))
        rounds, rest = divmod(left, folds)
        for place, k in enumerate(cycle):
            loads[k] += size * (rounds + (place < rest))
        out[size] = (first, cycle)
    return out


def group_kfold(df: DataFrame, group: str, folds: int = 5, salts: int | None = None) -> DataFrame:
    """df with `fold`, none of which shares a group with another. Groups of one size are alike to the
    plan, which therefore needs only how many groups there are of each size; groups take its places by
    their rank within the size, counted in salted parts."""
    g = F.col(f"`{group}`")
    salts = salts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = df.groupBy(g.alias("_group")).agg(F.count("*").alias("_size")).withColumn("_salt", F.pmod(F.xxhash64("_group"), F.lit(salts)))
    parts = groups.groupBy("_size", "_salt").agg(F.count("*").alias("_n"))
    plan = group_plan({r["_size"]: r["n"] for r in parts.groupBy("_size").agg(F.sum("_n").alias("n")).collect()}, folds)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_size", "_salt", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_size", "_salt").orderBy("_group")) - 1
    ranked = groups.withColumn("_in", inside).join(offsets, ["_size", "_salt"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    rules = df.sparkSession.createDataFrame([(s, f, c) for s, (f, c) in plan.items()] or [(0, [], [0])], "_size long, _first array<int>, _cycle array<int>")
    n = F.size("_first")
    fold = F.when(F.col("_rank") < n, F.get("_first", F.col("_rank").cast("int"))).otherwise(F.get("_cycle", F.pmod(F.col("_rank") - n, F.lit(folds)).cast("int")))
    lookup = ranked.join(rules, "_size").select("_group", fold.alias(FOLD))
    return df.join(lookup, g.eqNullSafe(F.col("_group"))).drop("_group")


@dataclass(frozen=True)
class TimeFolds:
    """Expanding windows: fold k tests block k, and trains on all rows before it."""

    block: Column  # 0 for the rows before the first test block, k for block k
    folds: int

    def train(self, k: int) -> Column:
        return self.block < k

    def test(self, k: int) -> Column:
        return self.block == k


def time_folds(df: DataFrame, order: list[Column], folds: int = 5) -> TimeFolds:
    n = df.count()
    size = n // (folds + 1)
    if not size:
        raise ValueError(f"{n} rows are too few for {folds} time folds")
    first = n - folds * size
    ends = [first + k * size - 1 for k in range(folds)]
    rows = order_rows(df, order, ends)
    return TimeFolds(place_among(order, [rows[e] for e in ends]).cast("int"), folds)


def time_series_folds(df: DataFrame, order: list[Column], folds: int = 5) -> DataFrame:
    """A row for each fold: fold (from 0), n_train, n_test."""
    f = time_folds(df, order, folds)
    counts = df.select(f.block.alias("block")).groupBy("block").count()
    rows = [(k, F.sum(F.when(F.col("block") < k + 1, F.col("count")).otherwise(0)), F.sum(F.when(F.col("block") == k + 1, F.col("count")).otherwise(0))) for k in range(folds)]
    made = counts.agg(F.array(*(F.struct(F.lit(k).alias("fold"), a.alias("n_train"), b.alias("n_test")) for k, a, b in rows)).alias("r"))
    return made.select(F.explode("r").alias("r")).select("r.*")
