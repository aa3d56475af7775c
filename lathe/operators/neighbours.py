"""The k nearest training rows, exactly, over metric partitions.

Some training rows serve as pivots, and every distinct (features, label) goes to its nearest one's cell with its
distance from it. Cells are sorted by that distance over range partitions, so a segment (a cell's rows in one partition) is
a ring around a pivot, and a cell of any size is several segments. By the triangle inequality, a ring from lo to hi
around a pivot at distance d of a query has no row nearer than max(lo - d, d - hi), and none farther than d + hi. A cell's rows
also lie on its pivot's side of the plane midway to any other pivot, so they are no nearer than that plane. The number of
pivots grows with the rows, so that cells stay small.

A query first searches the nearest segments that together have k rows, then only those that may hold a row nearer than
its k-th so far; a segment of blocks is left out block by block in the same way. Queries are sorted by cell, so that
those of a batch visit the same few segments. Each visit keeps a block's rows that may be among the k
nearest, and these are merged by query in two rounds. Only pivots and segments' bounds reach the driver: at most as many
as pivots and shuffle partitions together. Rows that repeat are one row with a count, however many they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.operators.features import FEATURES, LABEL

PREDICTION = "prediction"
#: Pivots: one for so many distinct rows, and the fewest and most of them.
CELL_ROWS, PIVOTS, MOST_PIVOTS = 512, 128, 4096
LANES = 16
#: Queries that are packed together.
BATCH = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of rows: by differences for few columns, by products for many."""
    if q.shape[1] <= 8:
        out = np.zeros((len(q), len(x)))
        for a, b in zip(q.T, x.T):
            out += (a[:, None] - b) ** 2
        return out
    return np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T, 0)


@dataclass(frozen=True)
class Neighbours:
    """The mean label of the k nearest training rows by Euclidean distance, exactly. Equal distances are taken by label."""

    n_neighbors: int = 5
    block_rows: int = 4096
    pivots: int | None = None  # None: by the number of rows

    def fit(self, df: DataFrame) -> NeighboursModel:
        rows = df.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).cast("double").alias("y")).groupBy("x", "y").agg(F.count("*").alias("times"))
        rows = rows.persist(StorageLevel.DISK_ONLY)
        placed = None
        try:
            # Distinct rows in the order of a hash: as good as a random sample of a fixed size.
            n = rows.count()
            picked = rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(self.pivots or min(max(n // CELL_ROWS, PIVOTS), MOST_PIVOTS)).collect()
            pivots = np.array([r["x"] for r in picked], float)
            tasks = _tasks(rows, n, self.block_rows)
            placed = _assigned(rows.coalesce(tasks), pivots).persist(StorageLevel.DISK_ONLY)  # the sort by ranges reads it twice
            blocks = _blocks(placed, tasks, self.block_rows).persist(StorageLevel.DISK_ONLY)
            model = NeighboursModel(blocks, pivots, _segments(blocks), self.n_neighbors)
        finally:
            rows.unpersist()
            if placed:
                placed.unpersist()
        return model


def _tasks(df: DataFrame, n: int, rows: int) -> int:
    """How many tasks n rows are dealt to: one for so many rows, as far as there are shuffle partitions."""
    return max(1, min(-(-n // rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _cells(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[a : a + 1024], pivots).argmin(1) for a in range(0, len(x), 1024)])


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with the cell of their nearest pivot and their distance r from it."""

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                cell = _cells(x, pivots)
                r = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(r), *(batch.column(c) for c in ("x", "y", "times"))], names=["cell", "r", "x", "y", "times"])

    return rows.mapInArrow(assign, "cell int, r double, x array<double>, y double, times long")


def _blocks(rows: DataFrame, tasks: int, size: int) -> DataFrame:
    """Assigned rows in segments (cell, part) and in blocks of these: lo, hi, n (with repeats), rows, and x, y, times as bytes."""
    placed = rows.repartitionByRange(tasks, "cell", "r", F.xxhash64("x", "y")).sortWithinPartitions("cell", "r").withColumn("part", F.spark_partition_id())

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, r, times, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "r", "times", "y"))
            x, part = _matrix(batch.column("x")), batch.column("part")[0].as_py()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            out = []
            for a, b in zip(edges, edges[1:]):
                for at in range(a, b, size):
                    to = min(at + size, b)
                    out.append((int(cell[at]), part, r[at], r[to - 1], int(times[at:to].sum()), to - at, x[at:to].tobytes(), y[at:to].tobytes(), times[at:to].tobytes()))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=_BLOCK.names), schema=_BLOCK)

    return placed.mapInArrow(pack, "cell int, part int, lo double, hi double, n long, rows long, x binary, y binary, times binary")


_BLOCK = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64()), ("rows", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("times", pa.binary())])


def _segments(blocks: DataFrame) -> pd.DataFrame:
    rows = blocks.groupBy("cell", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    return pd.DataFrame([r.asDict() for r in sorted(rows)], columns=["cell", "part", "lo", "hi", "n", "rows"])


@dataclass
class NeighboursModel:
    blocks: DataFrame
    pivots: np.ndarray
    segments: pd.DataFrame
    k: int
    importances: None = None

    def release(self) -> None:
        self.blocks.unpersist()

    def _placed(self, queries: DataFrame) -> DataFrame:
        """Queries with `own`, the cell of their nearest pivot."""
        pivots = self.pivots

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    yield batch.append_column("own", pa.array(_cells(_matrix(batch.column("x")), pivots).astype(np.int32)))

        return queries.mapInArrow(place, "a long, b long, x array<double>, own int")

    def _visits(self, queries: DataFrame, rest: bool, tasks: int | None = None) -> DataFrame:
        """Placed queries, with `rest` also of `bound` (their k-th distance so far), sorted by cell and packed by the segments to visit.
        A query's own segments are those with the least upper bounds that together have k rows."""
        pivots, k = self.pivots, self.k
        s = {c: self.segments[c].to_numpy() for c in self.segments}
        norms = (pivots**2).sum(1)
        reach = (np.sqrt(norms[s["cell"]]) + s["hi"]) ** 2

        def pack(batches):
            for batch in batches:
                for low in range(0, batch.num_rows, BATCH):
                    part = batch.slice(low, BATCH)
                    x = _matrix(part.column("x"))
                    own = squared(x, pivots)
                    nearest = own.argmin(1)
                    d = np.sqrt(own)[:, s["cell"]]
                    far = d + s["hi"]
                    first, bound = _own_segments(far, s["n"], k)
                    if rest:
                        bound = np.minimum(bound, part.column("bound").to_numpy(zero_copy_only=False))
                    slack = 1e-7 * (1 + np.where(np.isfinite(bound), bound, 0)[:, None] + d)
                    wanted = first
                    if rest:
                        wanted = (np.maximum(s["lo"] - d, d - s["hi"]) <= bound[:, None] + slack) & ~first
                        i, j = np.nonzero(wanted)
                        # how far the plane midway between the pivot and the query's own one is, less what rounding makes
                        to, at = s["cell"][j], nearest[i]
                        gap = np.sqrt(((pivots[to] - pivots[at]) ** 2).sum(1))
                        error = 1e-13 * (1 + (x**2).sum(1)[i] + norms[at] + reach[j])
                        with np.errstate(divide="ignore", invalid="ignore"):
                            plane = (own[i, to] - own[i, at] - error) / (2 * gap)
                        wanted[i, j] = ~((to != at) & (plane > bound[i] + slack[i, j]))
                    a, b = (part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
                    out = []
                    for j in np.flatnonzero(wanted.any(0)).tolist():
                        at = np.flatnonzero(wanted[:, j])
                        out.append((int(s["cell"][j]), int(s["part"][j]), a[at].tobytes(), b[at].tobytes(), x[at].tobytes(), d[at, j].tobytes(), bound[at].tobytes()))
                    if out:
                        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=_VISIT.names), schema=_VISIT)

        n = tasks or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return queries.repartitionByRange(n, "own", "a").sortWithinPartitions("own").mapInArrow(pack, "cell int, part int, a binary, b binary, q binary, d binary, bound binary")

    def _nearest(self, visits: DataFrame, count: bool = False) -> DataFrame:
        """a, b, lane, d, y, times: of each block, for each query that visits it, the rows that may be among its k nearest.
        With `count` also rows of no query, with how many pairs were compared."""
        k = self.k

        def search(batches):
            for batch in batches:
                pairs = 0
                for row in batch.to_pylist():
                    x, q, a, b, limit, may = _visit(row)
                    y, times = np.frombuffer(row["y"]), np.frombuffer(row["times"], np.int64)
                    longest = (x**2).sum(1).max(initial=0.0)
                    lane = int(row["lo"] * 1e6) % LANES if np.isfinite(row["lo"]) else 0
                    step = max(1, 1_000_000 // len(x))
                    for low in range(0, len(may), step):
                        at = may[low : low + step]
                        far = squared(q[at], x)
                        pairs += far.size
                        top = np.minimum(np.partition(far, k - 1, axis=1)[:, k - 1] if k < len(x) else np.inf, limit[at] ** 2)
                        i, j = np.nonzero(far <= (top + 1e-12 * (1 + (q[at] ** 2).sum(1) + longest))[:, None])
                        d = ((q[at[i]] - x[j]) ** 2).sum(1)
                        order = np.lexsort((y[j], d, i))
                        i, j, d = i[order], j[order], d[order]
                        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                        i, j, d = at[i[kept]], j[kept], d[kept]
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a[i], b[i], np.full(len(i), lane, np.int32), d, y[j], times[j], np.zeros(len(i), np.int64))], schema=_FOUND)
                if count:
                    yield pa.RecordBatch.from_pylist([{"lane": 0, "compared": pairs}], schema=_FOUND)

        return visits.join(self.blocks, ["cell", "part"]).mapInArrow(search, "a long, b long, lane int, d double, y double, times long, compared long")

    def _merged(self, found: DataFrame) -> DataFrame:
        """a, b, best (of struct d, y, times; in order, at most k) and compared; best is empty for the rows of no query."""
        compared = F.sum("compared").alias("compared")
        short = F.slice(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("d", "y", "times")))), 1, self.k)
        lanes = found.groupBy("a", "b", "lane").agg(short.alias("best"), compared)
        whole = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, self.k)
        return lanes.groupBy("a", "b").agg(whole.alias("best"), compared)

    def _queries(self, df: DataFrame) -> DataFrame:
        """The distinct queries: a, b (two hashes of their features) and x."""
        x = vector_to_array(FEATURES)
        return df.select(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), x.alias("x")).dropDuplicates(["a", "b"])

    def _bounded(self, queries: DataFrame, first: DataFrame) -> DataFrame:
        """Queries that the first round has found, with `bound`, the distance of the k-th row it found."""
        total = F.aggregate("best", F.lit(0).cast("long"), lambda n, v: n + v["times"])
        return queries.join(first.select("a", "b", F.when(total >= self.k, self._kth()).otherwise(F.lit(float("inf"))).alias("bound")), ["a", "b"])

    def search(self, df: DataFrame) -> DataFrame:
        """For each distinct query: a, b (two hashes of its features) and best."""
        queries = self._placed(self._queries(df))
        first = self._merged(self._nearest(self._visits(queries, rest=False)))
        rest = self._merged(self._nearest(self._visits(self._bounded(queries, first), rest=True)))
        whole = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, self.k)
        return first.unionByName(rest).groupBy("a", "b").agg(whole.alias("best"))

    def _kth(self):
        """The distance at which `best` has k rows, repeats counted."""
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("d"))
        at = F.aggregate("best", start, lambda s, v: F.struct((s["n"] + v["times"]).alias("n"), F.when(s["n"] < self.k, v["d"]).otherwise(s["d"]).alias("d")))
        return F.sqrt(at["d"])

    def transform(self, df: DataFrame) -> DataFrame:
        k = self.k
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))
        take = lambda s, v: F.least(v["times"], F.lit(k).cast("long") - s["n"])
        fold = F.aggregate("best", start, lambda s, v: F.struct((s["n"] + take(s, v)).alias("n"), (s["s"] + v["y"] * take(s, v)).alias("s")))
        x = vector_to_array(FEATURES)
        found = self.search(df).select("a", "b", (fold["s"] / fold["n"]).alias(PREDICTION))
        keyed = df.drop(PREDICTION).withColumns({"_a": F.xxhash64(x), "_b": F.xxhash64(F.lit(1), x)})
        return keyed.join(found, (F.col("_a") == found["a"]) & (F.col("_b") == found["b"])).drop("_a", "_b", "a", "b")

    def work(self, df: DataFrame) -> DataFrame:
        """One row: queries, train_rows, pairs (of distinct ones) and how many of these were compared, by a search
        whose steps run once: what is read again is kept until it ends."""
        n = int(self.segments["rows"].sum())
        kept: list[DataFrame] = []

        def keep(frame: DataFrame) -> DataFrame:
            kept.append(frame.persist(StorageLevel.DISK_ONLY))
            return kept[-1]

        try:
            distinct = keep(self._queries(df))
            tasks = _tasks(df, distinct.count(), BATCH // 2)
            queries = keep(self._placed(distinct.coalesce(tasks)))
            first = keep(self._merged(self._nearest(self._visits(queries, False, tasks), count=True)).coalesce(tasks))
            rest = self._nearest(self._visits(self._bounded(queries, first), True, tasks), count=True)
            # the first round has found all queries that the second one looks for
            counts = first.select("compared", F.col("a").isNotNull().alias("query")).unionByName(rest.select("compared", F.lit(False).alias("query")))
            count, compared = counts.agg(F.count_if("query"), F.coalesce(F.sum("compared"), F.lit(0))).first()
        finally:
            for frame in kept:
                frame.unpersist()
        figures = {"queries": count, "train_rows": n, "pairs": count * n, "compared": compared}
        return df.sparkSession.range(0, 1, 1, 1).select(*(F.lit(v).cast("long").alias(c) for c, v in figures.items()))


def _own_segments(far: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which segments with the least upper bounds have k rows together, and the greatest of these bounds."""
    few = min(16, far.shape[1])
    order = np.argpartition(far, few - 1, axis=1)[:, :few]
    order = np.take_along_axis(order, np.take_along_axis(far, order, 1).argsort(1, kind="stable"), 1)
    have = n[order].cumsum(1)
    if few < far.shape[1] and have[:, -1].min() < k:
        order = far.argsort(1, kind="stable")
        have = n[order].cumsum(1)
    first = np.zeros(far.shape, bool)
    np.put_along_axis(first, order, have - n[order] < k, 1)
    return first, np.where(first, far, -np.inf).max(1) if n.sum() >= k else np.full(len(far), np.inf)


def _visit(row: dict) -> tuple[np.ndarray, ...]:
    """A block's rows, the queries that visit it, their hashes, the farthest that a row may be from each, and which of them may find
    such a row here."""
    x = np.frombuffer(row["x"]).reshape(row["rows"], -1)
    a, b = np.frombuffer(row["a"], np.int64), np.frombuffer(row["b"], np.int64)
    d, bound = np.frombuffer(row["d"]), np.frombuffer(row["bound"])
    limit = bound + 1e-7 * (1 + np.where(np.isfinite(bound), bound, 0) + d)
    may = np.flatnonzero(np.maximum(row["lo"] - d, d - row["hi"]) <= limit)
    return x, np.frombuffer(row["q"]).reshape(len(a), -1), a, b, limit, may


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("lane", pa.int32()), ("d", pa.float64()), ("y", pa.float64()), ("times", pa.int64()), ("compared", pa.int64())])
_VISIT = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("q", pa.binary()), ("d", pa.binary()), ("bound", pa.binary())])
