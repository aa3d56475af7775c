"""Places in a global order without a single-task sort.

Rows are ranked over sorted range partitions: a row's place is its place within the partition plus the
rows of the partitions before it. Only the partitions' counts go to the driver. In the order of a hash, rows are
counted by prefixes of the hash first, and only those of one prefix are sorted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one prefix that a task sorts.
TASK_ROWS = 100_000


def order_rows(df: DataFrame, order: list[Column], ranks: list[int], times: str | None = None, parts: int | None = None) -> dict[int, tuple]:
    """The values of `order` at the given places (from 0) of the whole order, nulls first.
    Sorts the order's columns only, and collects one row for each wanted place. times: the column that says how many
    places a row takes, else one. parts: to how many tasks the rows are dealt, else by the shuffle partitions."""
    wanted = sorted({r for r in ranks if r >= 0})
    if not wanted:
        return {}
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"o{k}" for k in range(len(order))]
    keys = df.select(*(c.alias(a) for c, a in zip(order, names)), *([F.col(times).alias("times")] if times else []))
    placed = keys.repartitionByRange(n, *names).sortWithinPartitions(*names).select("*", F.monotonically_increasing_id().alias("at")).persist(StorageLevel.DISK_ONLY)
    try:
        part = F.shiftright("at", 33)
        size = F.sum("times") if times else F.count("*")
        sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(size.alias("n")).collect()}
        local, before = {}, 0
        for p in sorted(sizes):
            for r in wanted:
                if before <= r < before + sizes[p]:
                    local[(p << 33) + r - before] = r
            before += sizes[p]
        if not local:
            return {}
        if not times:
            found = placed.where(F.col("at").isin(*local)).collect()
            return {local[r["at"]]: tuple(r[a] for a in names) for r in found}
        last = F.shiftleft(part, 33) + F.sum("times").over(Window.partitionBy(part).orderBy("at")) - 1
        held = placed.where(part.isin(*{at >> 33 for at in local})).withColumn("last", last)
        found = held.where(reduce(Column.__or__, (F.lit(at).between(F.col("last") - F.col("times") + 1, F.col("last")) for at in local))).collect()
        return {r: tuple(row[a] for a in names) for row in found for at, r in local.items() if row["last"] - row["times"] < at <= row["last"]}
    finally:
        placed.unpersist()


def row_by_prefix(df: DataFrame, order: list[Column], place: Callable[[int], int], low: str, high: str) -> tuple | None:
    """The values of `order`, which begins with a text, at the place (from 0) that `place` gives for the number of rows; None before the first.
    low, high: prefixes of equal length between which the text likely is. One scan counts rows by prefix and, from low to high, by all of
    the order; if the place has another prefix, a second scan does so for that one. Equal rows are counted before they travel."""
    names = [f"o{k}" for k in range(len(order))]
    keys = df.select(*(c.alias(a) for c, a in zip(order, names)))
    prefix = F.substring("o0", 1, len(low))
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        near = (F.when(prefix.between(low, high), F.col(a)).alias(a) for a in names)
        counted = keys.groupBy(prefix.alias("prefix"), *near).agg(F.count("*").alias("times")).persist(StorageLevel.DISK_ONLY)
        try:
            sizes = sorted((r["prefix"], r["n"]) for r in counted.groupBy("prefix").agg(F.sum("times").alias("n")).collect())
            rank = place(sum(n for _, n in sizes))
            if rank < 0:
                return None
            for found, n in sizes:
                if rank < n:
                    break
                rank -= n
            if low <= found <= high:
                rows = counted.where(F.col("prefix") == found)
                return order_rows(rows, [F.col(a) for a in names], [rank], "times", min(1 + n // TASK_ROWS, most)).get(rank)
            low = high = found
        finally:
            counted.unpersist()


def with_places(df: DataFrame, by: str, out: str) -> tuple[DataFrame, int]:
    """df with a column `out`, each row's place (from 1) in the order of the column `by`, and how many rows
    there are. Sorted once over range partitions; only their counts go to the driver and back as a small array."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())  # spreads equal values over partitions
    placed = tied.repartitionByRange(n, by, "_tie").sortWithinPartitions(by).select(*df.columns, F.monotonically_increasing_id().alias("_at")).persist(StorageLevel.DISK_ONLY)
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["p"]: r["count"] for r in placed.groupBy(part.alias("p")).count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    starts = F.array(*map(F.lit, before)) if before else F.array(F.lit(0))
    place = F.get(starts, part) + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn(out, place).drop("_at"), total


def at_most(order: list[Column], bound: tuple) -> Column:
    """Whether a row comes no later in the order than a bound; nulls come first."""
    out = F.lit(True)
    for c, b in reversed(list(zip(order, bound))):
        if b is None:
            out = c.isNull() & out
        else:
            out = c.isNull() | (c < F.lit(b)) | ((c == F.lit(b)) & out)
    return F.coalesce(out, F.lit(False))


def place_among(order: list[Column], bounds: list[tuple]) -> Column:
    """How many bounds, given in order, lie before a row: the row's part of the order."""
    out = F.lit(0)
    for b in bounds:
        out = out + (~at_most(order, b)).cast("int")
    return out
