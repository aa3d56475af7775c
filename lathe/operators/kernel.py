"""Epsilon-insensitive regression with a Gaussian kernel: the exact dual, by block decomposition.

With one weight b for each training row, the dual is to minimise b'Kb / 2 - y'b + epsilon |b|, where |b_i| <= C and the weights
add up to nothing. The table holds each row's weight and its f = (Kb)_i. A round takes the rows that violate the
optimality conditions most (at most `working_set`; half of them by what raising costs, half by what lowering gains), solves the
dual over these alone on the driver by Newton's and pairwise steps, and adds what changed to all rows' f, where the rows are: no
kernel matrix is ever built. Workers keep kernel rows of working rows that come again, up to CACHE_BYTES. It ends when no pair
violates the conditions by more than `tol`, so the result is the solution, not an approximation of the kernel.

From nothing, the number of rounds grows with the rows, as each row must be moved at least once. So a table of over
START_ROWS rows begins with weights that are nearly right (`_start`): those of the same problem for a kernel of up to PIVOTS
features (Nystroem's, of pivots that leave the least), with the loss rounded off, by Newton's steps on sums over the rows. At bounds these weights
are exactly there: a round could not put many rows back. One pass then gives their f by the kernel
itself, and rounds go on from there until the conditions hold, so the start decides how long it takes and not what comes out.

That pass and predictions compare all rows with nearly all rows: this is for up to some hundred
thousand of them. FourierSVR in models.py approximates the kernel and takes any number.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.operators.features import FEATURES, LABEL

PREDICTION = "prediction"
CACHE_BYTES = 64_000_000
#: Support vectors of up to so many bytes are sent to the workers; more stay a table that is read in blocks.
BROADCAST_BYTES = 64_000_000
#: Rounds after which the lineage is cut, where there is a checkpoint folder.
CHECKPOINT_ROUNDS = 10
#: Tables of more rows begin with the weights of a problem of PIVOTS features (COARSE at first), chosen among CANDIDATES rows (of up to
#: CANDIDATE_BYTES); rows whose kernel values are made at a time.
START_ROWS, PIVOTS, COARSE, CANDIDATES, CANDIDATE_BYTES, CHUNK = 8192, 2048, 512, 8192, 64_000_000, 2048
#: Newton's steps for each width of the rounded loss; the last width with COARSE features and the last of all, in units of the label's
#: deviation; rows where the loss bends that a step takes its curvature from.
START_STEPS, COARSE_WIDTH, START_WIDTH, BENT_ROWS = 12, 1 / 64, 1 / 256, 8192
_LOOK = pa.schema([("loss", pa.list_(pa.float64())), ("most", pa.float64()), ("pull", pa.binary()), ("total", pa.float64()), ("bent", pa.int64()), ("x", pa.binary())])
_STATE = "id long, x array<double>, y double, b double, f double"
_cache: OrderedDict[tuple, np.ndarray] = OrderedDict()


def gaussian(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    d = (x**2).sum(1)[:, None] + (z**2).sum(1)[None] - 2 * x @ z.T
    return np.exp(-gamma * np.maximum(d, 0))


def _columns(x: np.ndarray, ids: np.ndarray, z: np.ndarray, gamma: float, place: tuple) -> np.ndarray:
    """Kernel values of a batch's rows with working rows: kept ones, and the others anew."""
    out = np.empty((len(x), len(ids)))
    new = []
    for j, i in enumerate(ids.tolist()):
        kept = _cache.get((place, i))
        if kept is not None and len(kept) == len(x):
            _cache.move_to_end((place, i))
            out[:, j] = kept
        else:
            new.append(j)
    if new:
        out[:, new] = gaussian(x, z[new], gamma)
        for j in new:
            _cache[place, int(ids[j])] = out[:, j].copy()
    size = sum(v.nbytes for v in _cache.values())
    while _cache and size > CACHE_BYTES:
        size -= _cache.popitem(last=False)[1].nbytes
    return out


def weighted(q: np.ndarray, z: np.ndarray, w: np.ndarray, gamma: float) -> np.ndarray:
    """Sums of the weighted kernel values of each row of q with all of z, a block of bounded size at a time."""
    out = np.zeros(len(q))
    left = np.c_[2 * gamma * q, -gamma * (q**2).sum(1), np.ones(len(q))]  # exponents are products of these
    right = np.c_[z, np.ones(len(z)), -gamma * (z**2).sum(1)].T.copy()
    for k in range(0, len(q), 512):
        for j in range(0, len(z), 512):
            d = left[k : k + 512] @ right[:, j : j + 512]
            out[k : k + 512] += np.exp(np.minimum(d, 0, out=d), out=d) @ w[j : j + 512]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def slopes(b: np.ndarray, g: np.ndarray, C: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """What raising each weight costs, and what lowering gains; infinite where a bound forbids it. g = f - y."""
    up = np.where(b < C, g + np.where(b >= 0, epsilon, -epsilon), np.inf)
    down = np.where(b > -C, g + np.where(b > 0, epsilon, -epsilon), -np.inf)
    return up, down


def pairwise(k: np.ndarray, g: np.ndarray, b: np.ndarray, C: float, epsilon: float, tol: float, most: int = 100_000) -> np.ndarray:
    """Weights of a small dual (others fixed; g = f - y at the start): raises the weight that violates most and lowers
    the one with which that gains most, until no pair violates by more than tol."""
    b, g, diagonal = b.copy(), g.copy(), np.diag(k)
    for _ in range(most):
        up, down = slopes(b, g, C, epsilon)
        i = int(up.argmin())
        gap = down - up[i]
        if gap.max() <= tol:
            break
        j = int((np.where(gap > 0, gap, 0) ** 2 / np.maximum(diagonal[i] + diagonal - 2 * k[i], 1e-12)).argmax())
        step = (down[j] - up[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, -b[i] if b[i] < 0 else C - b[i], b[j] if b[j] > 0 else b[j] + C)
        b[i] += step
        b[j] -= step
        for at in (i, j):  # bounds are met exactly
            b[at] = 0.0 if abs(b[at]) < 1e-14 * C else min(max(b[at], -C), C)
        g += step * (k[:, i] - k[:, j])
    return b


def settle(k: np.ndarray, g: np.ndarray, before: np.ndarray, C: float, epsilon: float, tol: float) -> np.ndarray:
    """Nearly right weights of a small dual (as in `pairwise`), by Newton's steps on a loss that is rounded off less and less. Smooth kernels
    need many pairwise steps. If it fails, the weights before."""
    up, down = slopes(before, g, C, epsilon)
    if not (np.isfinite(up).any() and np.isfinite(down).any()):
        return before
    beta, total, kb = np.zeros(len(g)), before.sum(), k @ before
    gap, a = down.max() - up.min(), -(down.max() + up.min()) / 2
    last, lengths = tol / 8, 2.0 ** -np.arange(12)
    delta, u = max(last, gap / 4), np.zeros(len(g))
    while True:
        for _ in range(40):
            r = -g - u - a
            b = rounded_weights(r, delta, C, epsilon)
            s = np.flatnonzero((b != 0) & (np.abs(b) < C))
            if not len(s):
                s = np.argsort(np.abs(np.abs(r) - epsilon - delta / 2))[:8]
            miss = beta - b + before
            step, off = -miss, miss.copy()
            off[s] = 0
            left = np.block([[k[np.ix_(s, s)] + np.eye(len(s)) * (delta / C), np.ones((len(s), 1))], [np.ones((1, len(s))), np.zeros((1, 1))]])
            solved = np.linalg.solve(left, np.r_[-(delta / C) * miss[s] + k[s] @ off, total - b.sum() - miss[s].sum()])
            step[s], v = solved[:-1], solved[-1]
            moves = k @ step
            loss = [((beta + t * step) @ (u + t * moves)) / 2 + kb @ (beta + t * step) + rounded_loss(r - t * (moves + v), delta, C, epsilon).sum() + t * v * total for t in lengths]
            t = lengths[int(np.argmin(loss))]
            beta, u, a = beta + t * step, u + t * moves, a + t * v
            if t == 1 and np.abs(moves + v).max() < delta / 50:
                break
        if delta <= last:
            break
        delta = max(last, delta / 3)
    b = rounded_weights(-g - u - a, delta, C, epsilon)
    s = (b != 0) & (np.abs(b) < C)
    if s.any():
        b[s] = np.clip(b[s] + (total - b.sum()) / s.sum(), -C, C)
    moved = b - before
    better = moved @ k @ moved / 2 + g @ moved + epsilon * (np.abs(b).sum() - np.abs(before).sum()) < 0
    return b if better and abs(b.sum() - total) <= 1e-9 * C else before


def rounded_weights(r: np.ndarray, delta: float, C: float, epsilon: float) -> np.ndarray:
    return C * np.sign(r) * np.clip((np.abs(r) - epsilon) / delta, 0, 1)


def rounded_loss(r: np.ndarray, delta: float, C: float, epsilon: float) -> np.ndarray:
    """The loss whose slope is rounded_weights."""
    s = np.maximum(np.abs(r) - epsilon, 0)
    return C * np.where(s < delta, s**2 / (2 * delta), s - delta / 2)


def pivots(x: np.ndarray, gamma: float, most: int, tol: float = 1e-10, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x that leave least of the kernel to the others (a pivoted Cholesky factor, a block of columns at a time), and the
    inverse of the pivots' own factor."""
    n, most = len(x), min(most, len(x))
    factor, rest, chosen = np.empty((n, most)), np.ones(n), []
    while len(chosen) < most and rest.max() > tol:
        m, high = len(chosen), rest.max()
        c = np.argsort(-rest)[:block]
        c = c[rest[c] > max(tol, 0.05 * high)]
        left = gaussian(x[c], x[c], gamma) - factor[c, :m] @ factor[c, :m].T
        own, d, new = np.zeros((len(c), len(c))), np.diag(left).copy(), []
        for j in range(min(len(c), most - m)):
            i = int(d.argmax())
            if d[i] <= max(tol, 0.1 * high):
                break
            own[:, j] = (left[:, i] - own[:, :j] @ own[i, :j]) / np.sqrt(d[i])
            d -= own[:, j] ** 2
            d[i] = -1.0
            new.append(i)
        if not new:
            break
        at = c[new]
        columns = np.linalg.solve(own[new][:, : len(new)], (gaussian(x, x[at], gamma) - factor[:, :m] @ factor[at, :m].T).T).T
        factor[:, m : m + len(new)] = columns
        rest = np.maximum(rest - (columns**2).sum(1), 0)
        chosen += at.tolist()
        rest[chosen] = 0
    return x[chosen], np.linalg.inv(factor[chosen, : len(chosen)])


@dataclass(frozen=True)
class KernelSVR:
    """gamma = 1 / (width * variance of all entries)."""

    C: float = 1.0
    epsilon: float = 0.1
    tol: float = 1e-3
    working_set: int = 1024
    max_rounds: int = 1_000

    def fit(self, df: DataFrame) -> KernelModel:
        spark, run = df.sparkSession, uuid.uuid4().hex
        rows = df.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).cast("double").alias("y"))
        width = len(rows.first()["x"])
        spread = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
        gamma, C, eps = 1.0 / (max(width, 1) * spread), self.C, self.epsilon
        n = rows.count()
        # a small file is one partition, but each of its rows meets all others
        rows = rows.repartition(max(1, min(2 * spark.sparkContext.defaultParallelism, n // 1000))) if n > START_ROWS else rows
        # an id is a place in the input, so it is only good within this persisted table
        state = rows.select(F.monotonically_increasing_id().alias("id"), "x", "y", F.lit(0.0).alias("b"), F.lit(0.0).alias("f")).persist(StorageLevel.MEMORY_AND_DISK)
        if n > START_ROWS:
            started = self._start(state, gamma, n).persist(StorageLevel.MEMORY_AND_DISK)
            started.count()
            state.unpersist()
            state = started
        lasting = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
        g = F.col("f") - F.col("y")
        up = F.when(F.col("b") < C, g + F.when(F.col("b") >= 0, eps).otherwise(-eps))
        down = F.when(F.col("b") > -C, g + F.when(F.col("b") > 0, eps).otherwise(-eps))
        half, gap, level, rounds = max(1, self.working_set // 2), np.inf, 0.0, 0
        while True:
            sloped = state.withColumns({"up": up, "down": down})
            low = sloped.where("up is not null").orderBy("up", "id").limit(half).collect()
            high = sloped.where("down is not null").orderBy(F.desc("down"), "id").limit(half).collect()
            if not low or not high:
                break
            gap, level = high[0]["down"] - low[0]["up"], (high[0]["down"] + low[0]["up"]) / 2
            if gap <= self.tol or rounds >= self.max_rounds:
                break
            rounds += 1
            chosen = {r["id"]: r for pair in zip(low, high) for r in pair} | {r["id"]: r for r in (*low, *high)}
            work = list(chosen.values())
            z, ids = np.array([r["x"] for r in work], float).reshape(len(work), -1), np.array([r["id"] for r in work], np.int64)
            before = np.array([r["b"] for r in work])
            k, slope, enough = gaussian(z, z, gamma), np.array([r["f"] - r["y"] for r in work]), max(self.tol / 2, gap / 10)
            settled = settle(k, slope, before, C, eps, enough)
            after = pairwise(k, slope + k @ (settled - before), settled, C, eps, enough, 20 * len(work))
            moved = np.flatnonzero(after != before)
            new = self._moved(state, run, gamma, ids[moved], z[moved], (after - before)[moved], dict(zip(ids.tolist(), after.tolist())))
            new = new.persist(StorageLevel.MEMORY_AND_DISK)
            if lasting and rounds % CHECKPOINT_ROUNDS == 0:
                new = new.checkpoint()
            new.count()
            state.unpersist()
            state = new
        model = _model(state, width, gamma, -level)
        state.unpersist()
        model.gap, model.rounds = float(gap), rounds
        return model

    def _start(self, state: DataFrame, gamma: float, n: int) -> DataFrame:
        """The state with weights near the solution that add up to nothing, and their f."""
        C, eps = self.C, self.epsilon
        width = len(state.select("x").first()["x"])
        some = state.orderBy(F.xxhash64("id"), "id").limit(max(PIVOTS, min(CANDIDATES, CANDIDATE_BYTES // (8 * max(width, 1)))))
        z, inverse = pivots(_matrix(some.select("x").toArrow().column("x").combine_chunks()), gamma, PIVOTS)
        about = state.agg(F.avg("y"), F.stddev_pop("y")).first()
        spread, tasks = about[1] or 1.0, max(1, state.rdd.getNumPartitions())
        lengths = 2.0 ** -np.arange(8)

        def chunks(batches, z):
            for batch in batches:
                x, y = _matrix(batch.column("x")), batch.column("y").to_numpy()
                for k in range(0, len(y), CHUNK):
                    yield x[k : k + CHUNK], y[k : k + CHUNK], gaussian(x[k : k + CHUNK], z, gamma)

        def look(theta, a, step, v, delta):
            """What rows say of a step: the loss for each length, the most that a row's value changes, and at the whole step the weights'
            pull and sum, how many rows are where the loss bends, and some of these."""
            m = len(theta)
            z_, coefficients = z[:m], inverse[:m, :m].T @ np.c_[theta, step]

            def own(batches):
                loss, most, pull, total, bent = np.zeros(len(lengths)), 0.0, np.zeros(m), 0.0, []
                for x, y, k in chunks(batches, z_):
                    u = k @ coefficients
                    r, q = y - a - u[:, 0], u[:, 1] + v
                    most = max(most, float(np.abs(q).max(initial=0)))
                    loss += [rounded_loss(r - t * q, delta, C, eps).sum() for t in lengths]
                    b = rounded_weights(r - q, delta, C, eps)
                    pull, total = pull + b @ k, total + b.sum()
                    bent.append(x[(b != 0) & (np.abs(b) < C)])
                bent = np.concatenate([*bent, np.zeros((0, z_.shape[1]))])
                taken = bent[np.linspace(0, len(bent) - 1, min(len(bent), max(1, BENT_ROWS // tasks))).astype(int)]
                yield pa.RecordBatch.from_pydict({"loss": [loss.tolist()], "most": [most], "pull": [pull.tobytes()], "total": [total], "bent": [len(bent)], "x": [taken.tobytes()]}, schema=_LOOK)

            got = state.select("x", "y").mapInArrow(own, "loss array<double>, most double, pull binary, total double, bent long, x binary").collect()
            rows, counts = [], []
            for r in got:
                rows.append(np.frombuffer(r["x"]).reshape(-1, z_.shape[1]))
                counts.append(np.full(len(rows[-1]), r["bent"] / max(len(rows[-1]), 1)))
            pull = inverse[:m, :m] @ np.sum([np.frombuffer(r["pull"]) for r in got], axis=0)
            return np.sum([r["loss"] for r in got], axis=0), max(r["most"] for r in got), pull, sum(r["total"] for r in got), np.concatenate(rows), np.concatenate(counts)

        def narrow(theta, a, delta):
            """Newton's steps for one width of the rounded loss. The intercept a is free, theta is penalised."""
            m, still = len(theta), (np.zeros(len(theta)), 0.0)
            _, _, pull, total, bent, counts = look(theta, a, *still, delta)
            for _ in range(START_STEPS):
                hessian = np.diag(np.r_[np.ones(m), 0.0] + 1e-9)
                for k in range(0, len(bent), 1024):
                    p = np.c_[gaussian(bent[k : k + 1024], z[:m], gamma) @ inverse[:m, :m].T, np.ones(len(bent[k : k + 1024]))]
                    hessian += C / delta * (p.T * counts[k : k + 1024]) @ p
                step = -np.linalg.solve(hessian, np.r_[theta - pull, -total])
                loss, most, *there = look(theta, a, step[:-1], step[-1], delta)
                loss = loss + [((theta + t * step[:-1]) ** 2).sum() / 2 for t in lengths]
                t = lengths[int(loss.argmin())]
                theta, a = theta + t * step[:-1], a + t * step[-1]
                pull, total, bent, counts = there if t == 1 else look(theta, a, *still, delta)[2:]
                if t == 1 and most < delta / 20:
                    break
            return theta, a, total

        theta, a, delta = np.zeros(min(COARSE, len(z))), about[0], START_WIDTH * spread
        while delta < spread:
            delta *= 4
        while True:
            if delta <= COARSE_WIDTH * spread and len(theta) == min(COARSE, len(z)) < len(z):
                theta, a, _ = narrow(theta, a, delta)
                theta = np.r_[theta, np.zeros(len(z) - len(theta))]
            theta, a, total = narrow(theta, a, delta)
            if delta <= START_WIDTH * spread:
                break
            delta /= 4

        values = inverse.T[:, : len(theta)] @ theta

        def weigh(batches):
            for batch in batches:
                b = [rounded_weights(y - a - k @ values, delta, C, eps) for _, y, k in chunks([batch], z)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate([*b, np.zeros(0)])), batch.column("f")], names=batch.schema.names)

        def sums(intercepts):
            def own(batches):
                total = np.zeros(len(intercepts))
                for _, y, k in chunks(batches, z):
                    r = y - k @ values
                    total += [rounded_weights(r - i, delta, C, eps).sum() for i in intercepts]
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

            return np.sum([r["total"] for r in state.select("x", "y").mapInArrow(own, "total array<double>").collect()], axis=0)

        # If the steps ended early, weights don't add up to nothing: an intercept is looked for at which they do, as bounds must be kept
        reach, low, high = delta, None, None
        for _ in range(30):
            if abs(total) <= 1e-8 * C:
                break
            grid = np.linspace(a - reach, a + reach, 33) if low is None else np.linspace(low, high, 33)
            found = sums(grid)  # falls as the intercept grows
            k = int((found > 0).sum())
            if 0 < k < len(grid):
                low, high = grid[k - 1], grid[k]
                a = low + (high - low) * found[k - 1] / (found[k - 1] - found[k])
                total = sums([a])[0]
            elif low is None:
                reach *= 8
            else:
                break
        state = state.mapInArrow(weigh, _STATE)
        # what is left is rounding: rows within bounds take it
        free = (F.col("b") != 0) & (F.abs("b") < C)
        total, some = state.agg(F.sum("b"), F.count_if(free)).first()
        if some:
            state = state.withColumn("b", F.when(free, F.greatest(F.lit(-C), F.least(F.lit(C), F.col("b") - total / some))).otherwise(F.col("b")))
        model = _model(state, z.shape[1], gamma, 0.0)
        return model.transform(state.withColumn(FEATURES, array_to_vector("x"))).withColumn("f", F.col(PREDICTION)).select("id", "x", "y", "b", "f")

    @staticmethod
    def _moved(state: DataFrame, run: str, gamma: float, ids: np.ndarray, z: np.ndarray, step: np.ndarray, weights: dict[int, float]) -> DataFrame:
        def add(batches):
            part = TaskContext.get().partitionId()
            for k, batch in enumerate(batches):
                if not batch.num_rows:
                    continue
                f, own = batch.column("f").to_numpy(), batch.column("id").to_numpy()
                values = _columns(_matrix(batch.column("x")), ids, z, gamma, (run, part, k))
                b = np.array([weights.get(i, w) for i, w in zip(own.tolist(), batch.column("b").to_numpy().tolist())])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), batch.column("y"), pa.array(b), pa.array(f + values @ step)], names=["id", "x", "y", "b", "f"])

        return state.mapInArrow(add, _STATE)


def _collected(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = vectors.toArrow()
    x = got.column("x").combine_chunks()
    return _matrix(x) if len(x) else np.zeros((0, 1)), got.column("b").to_numpy()


def _model(state: DataFrame, width: int, gamma: float, intercept: float) -> KernelModel:
    vectors = state.where("b <> 0").select("x", "b")
    if vectors.count() * (width + 1) * 8 <= BROADCAST_BYTES:
        return KernelModel(*_collected(vectors), None, gamma, intercept)
    blocks = _packed(vectors).persist(StorageLevel.DISK_ONLY)
    blocks.count()
    return KernelModel(None, None, blocks, gamma, intercept)


def _packed(vectors: DataFrame, size: int = 4096) -> DataFrame:
    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_pydict({"x": [_matrix(part.column("x")).tobytes()], "b": [part.column("b").to_numpy().tobytes()]}, schema=pa.schema([("x", pa.binary()), ("b", pa.binary())]))

    return vectors.mapInArrow(pack, "x binary, b binary")


@dataclass
class KernelModel:
    """Few support vectors (x, weights) are arrays, many are blocks. gap: by how much any pair still violates
    the conditions; rounds: how many were taken."""

    x: np.ndarray | None
    weights: np.ndarray | None
    blocks: DataFrame | None
    gamma: float
    intercept: float
    importances: None = None
    gap: float = 0.0
    rounds: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        gamma, a = self.gamma, self.intercept
        df = df.drop(PREDICTION)
        if self.blocks is None:
            z, w = self.x, self.weights
            spread = df.sparkSession.sparkContext.defaultParallelism
            if len(w) > START_ROWS and df.rdd.getNumPartitions() < spread:
                df = df.repartition(2 * spread)  # a small file is one partition, but each of its rows meets all of these

            @F.pandas_udf("double")
            def predict(x: pd.Series) -> pd.Series:
                q = np.array(x.tolist(), float).reshape(len(x), -1)
                return pd.Series(weighted(q, z, w, gamma) + a if len(w) else np.full(len(q), a))

            return df.withColumn(PREDICTION, predict(vector_to_array(FEATURES)))
        x = vector_to_array(FEATURES)
        queries = df.select(F.xxhash64(x).alias("p"), F.xxhash64(F.lit(1), x).alias("q"), x.alias("v")).dropDuplicates(["p", "q"])

        def pack(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    yield pa.RecordBatch.from_pydict({c: [v.tobytes()] for c, v in (("p", part.column("p").to_numpy()), ("q", part.column("q").to_numpy()), ("v", _matrix(part.column("v"))))}, schema=pa.schema([(c, pa.binary()) for c in "pqv"]))

        def sums(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    p, q, b = np.frombuffer(r["p"], np.int64), np.frombuffer(r["q"], np.int64), np.frombuffer(r["b"])
                    v = gaussian(np.frombuffer(r["v"]).reshape(len(p), -1), np.frombuffer(r["x"]).reshape(len(b), -1), gamma) @ b
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(v)], names=["p", "q", "s"])

        # every query needs every support vector: queries in blocks against these in blocks
        parts = queries.mapInArrow(pack, "p binary, q binary, v binary").crossJoin(self.blocks).mapInArrow(sums, "p long, q long, s double")
        found = parts.groupBy("p", "q").agg((F.sum("s") + a).alias(PREDICTION))
        keyed = df.withColumns({"_p": F.xxhash64(x), "_q": F.xxhash64(F.lit(1), x)})
        return keyed.join(found, (F.col("_p") == found["p"]) & (F.col("_q") == found["q"])).drop("_p", "_q", "p", "q")


def facts(model: KernelModel) -> dict[str, Any]:
    """What a saved model needs besides its blocks."""
    own = {} if model.x is None else {"x": model.x.tolist(), "weights": model.weights.tolist()}
    return {"gamma": model.gamma, "intercept": model.intercept, **own}
