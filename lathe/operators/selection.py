"""Exact medians of many groups by refining histograms.

A scan gives each group's count and approximate quantiles just below and above its middle (a mergeable sketch:
tasks send sketches, not values). The next one counts what lies below and between the two; as the middle's rank is
known, the counts tell where it must be, whether or not the sketch was good. A few scans leave a range of at most LIMIT rows,
whose distinct values are counted and sorted. Groups of at most LIMIT rows take one ordinary aggregate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a group that one task may sort.
LIMIT = 1_000_000
#: Half the share of ranks between the two quantiles, and the sketch's accuracy (1 / its error).
SPREAD, ACCURACY = 0.002, 5_000


@dataclass
class _Search:
    """A group of n rows: `below` of them lie under lo, `inside` between lo and hi, and the middle ones are inside."""

    key: tuple
    n: int
    lo: float
    hi: float
    below: int
    inside: int
    tried: tuple[float, float]
    cut: float | None = None  # the greatest value up to here and the least one beyond are the middle ones

    @property
    def ranks(self) -> tuple[int, int]:
        return (self.n + 1) // 2, self.n // 2 + 1

    @property
    def middle(self) -> float:
        """Where the middle is among the rows inside, as a share."""
        return ((self.n + 1) / 2 - self.below) / self.inside

    def wide(self, limit: int) -> bool:
        return self.cut is None and self.inside > limit and self.lo < self.hi

    def narrow(self, under: int, between: int) -> None:
        """Counts for the tried range [a, b]: rows under a and rows between."""
        (a, b), (low, high), top = self.tried, self.ranks, self.below + self.inside
        lo, hi, below = a, b, under
        end = under + between
        if low <= under < high or low <= end < high:
            self.cut = math.nextafter(a, -math.inf) if low <= under else b
            return
        if high <= under:
            lo, hi, below, end = self.lo, math.nextafter(a, -math.inf), self.below, under
        elif low > end:
            lo, hi, below, end = math.nextafter(b, math.inf), self.hi, end, top
        # where repeats fill both ends of a sketch, it says nothing new: halve the range
        self.tried = (lo, lo + (hi - lo) / 2) if (lo, hi) == (self.lo, self.hi) else (lo, hi)
        self.lo, self.hi, self.below, self.inside = lo, hi, below, end - below


def _grid(searches: list[_Search]) -> list[float]:
    return sorted({min(max(s.middle + d, 0.0), 1.0) for s in searches for d in (-SPREAD, SPREAD)})


def group_medians(df: DataFrame, by: list[str], value: Column, out: str = "median", limit: int = LIMIT) -> DataFrame:
    """by, out: the median of a value (nulls don't count) for each group. df is scanned several times, so it
    should be cheap to read. The driver holds a few numbers for each group of more than `limit` rows."""
    spark = df.sparkSession
    rows = df.select(*by, value.cast("double").alias("_v")).where("_v is not null")
    v = F.col("_v")
    quantiles = lambda grid: F.percentile_approx(v, F.array(*map(F.lit, grid)), F.lit(ACCURACY))
    first = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), quantiles([0.5 - SPREAD, 0.5 + SPREAD]).alias("_q"))
    found = [_Search(tuple(r[c] for c in by), r["_n"], r["_lo"], r["_hi"], 0, r["_n"], tuple(r["_q"])) for r in first.where(F.col("_n") > limit).collect()]
    if not found:
        return rows.groupBy(*by).agg(F.median("_v").alias(out))

    def told(searches: list[_Search], **values) -> DataFrame:
        """rows of these groups with a column for each given function of a search."""
        fields = [T.StructField(f"_k{k}", df.schema[c].dataType) for k, c in enumerate(by)]
        made = [[f(s) for f in values.values()] for s in searches]
        fields += [T.StructField(c, T.LongType() if isinstance(x, int) else T.DoubleType()) for c, x in zip(values, made[0])]
        side = spark.createDataFrame([(*s.key, *m) for s, m in zip(searches, made)], T.StructType(fields))
        same = reduce(Column.__and__, (rows[c].eqNullSafe(side[f"_k{k}"]) for k, c in enumerate(by)), F.lit(True))
        return rows.join(F.broadcast(side), same).drop(*(f"_k{k}" for k in range(len(by))))

    inside = v.between(F.col("_a"), F.col("_b"))
    while wide := [s for s in found if s.wide(limit)]:
        n = lambda c: F.count(F.when(c, 1))
        counts = told(wide, _a=lambda s: s.tried[0], _b=lambda s: s.tried[1]).groupBy(*by).agg(n(v < F.col("_a")), n(inside)).collect()
        known = {tuple(r[: len(by)]): tuple(r[len(by) :]) for r in counts}
        for s in wide:
            s.narrow(*known[s.key])
        again = [s for s in wide if s.wide(limit) and s.tried == (s.lo, s.hi)]
        if again:
            grid = _grid(again)
            sketch = told(again, _a=lambda s: s.lo, _b=lambda s: s.hi).where(inside).groupBy(*by).agg(quantiles(grid)).collect()
            known = {tuple(r[: len(by)]): r[len(by)] for r in sketch}
            for s in again:
                q = dict(zip(grid, known[s.key]))
                s.tried = tuple(q[min(max(s.middle + d, 0.0), 1.0)] for d in (-SPREAD, SPREAD))

    large = []
    ranged, parted = [s for s in found if s.cut is None], [s for s in found if s.cut is not None]
    if ranged:
        last = told(ranged, _a=lambda s: s.lo, _b=lambda s: s.hi, _low=lambda s: s.ranks[0] - s.below, _high=lambda s: s.ranks[1] - s.below).where(inside)
        runs = last.groupBy(*by, "_low", "_high", "_v").agg(F.count("*").alias("c")).groupBy(*by, "_low", "_high").agg(F.array_sort(F.collect_list(F.struct(v.alias("v"), "c"))).alias("runs"))

        def at(place: str) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("v"))
            here = lambda s, r: (s["n"] < F.col(place)) & (s["n"] + r["c"] >= F.col(place))
            return F.aggregate("runs", start, lambda s, r: F.struct((s["n"] + r["c"]).alias("n"), F.when(here(s, r), r["v"]).otherwise(s["v"]).alias("v")))["v"]

        large.append(runs.select(*by, ((at("_low") + at("_high")) / 2).alias(out)))
    if parted:
        sides = told(parted, _cut=lambda s: s.cut).groupBy(*by).agg(F.max(F.when(v <= F.col("_cut"), v)).alias("_l"), F.min(F.when(v > F.col("_cut"), v)).alias("_h"))
        large.append(sides.select(*by, ((F.col("_l") + F.col("_h")) / 2).alias(out)))
    done = reduce(DataFrame.unionByName, large)
    if not by:
        return done
    sizes = first.where(F.col("_n") <= limit).select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(by)))
    same = reduce(Column.__and__, (rows[c].eqNullSafe(sizes[f"_k{k}"]) for k, c in enumerate(by)), F.lit(True))
    return done.unionByName(rows.join(sizes, same, "left_semi").groupBy(*by).agg(F.median("_v").alias(out)))
