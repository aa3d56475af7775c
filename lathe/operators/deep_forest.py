"""Forests of trees without a limit of depth.

While a node of a tree has more than `local_rows` rows, its split comes from histograms: a scan adds up, for each such node
of all trees and each feature, weights and weighted labels by bins (at most BINS, by quantiles), and a group of (tree,
node) finds the best one that leaves each side an eighth of the rows (if there is none, the best of all), so that few scans
do; the driver gets a row for each of these nodes, which are few as each has many rows. Below, a node's rows
go to one task, which grows the rest exactly. Labels that go up and down along a feature make trees as deep as
they have waves, each level of which takes few rows off; so large nodes are split one by one at a cost of what the smaller child has
(`_grow_large`), and rows are led to leaves by binary searches (`flat`). Small nodes are split level by level.

A row's weight in a tree is a Poisson draw of mean 1 by a hash of the row's number, the tree and the seed, as a bootstrap's counts
are; one tree alone can take all rows as they are. Growth ends where labels are equal or no feature tells rows apart, so
distinct rows are fitted exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.operators.features import FEATURES, LABEL

PREDICTION = "prediction"
BINS = 256
LOCAL_ROWS = 1_000_000
#: Within a task, nodes of more rows are split one by one. A feature of up to NARROW values takes histograms. Places in a block of an order.
SMALL, NARROW, BLOCK = 1024, 256, 4096
#: Trees of up to so many bytes are sent to the workers; larger ones stay a table that rows are joined with.
BROADCAST_BYTES = 32_000_000
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1), dtype=float) for k in range(12)])
_KIND = np.dtype([("feature", "<i4"), ("threshold", "<f8"), ("left", "<i4"), ("value", "<f8")])  # right is left + 1


def weights(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0x632BE59BD9B4E019 + seed * 0xD1342543DE82EF95) % 2**64)
    for a, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(a))) * np.uint64(m)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    return np.searchsorted(_POISSON, u, side="right").astype(float)


class _Order:
    """Rows in order of one feature, running sums along them, and the places where values change. Split gains are convex in the sums
    on the left, so of a block of places only the corners of its hull can be best; they serve every stretch of the rows."""

    def __init__(self, rows: np.ndarray, v: np.ndarray, w: np.ndarray, s: np.ndarray):
        self.rows = rows
        self.w, self.s = np.r_[0.0, np.cumsum(w[rows])], np.r_[0.0, np.cumsum(s[rows])]
        v = v[rows]
        self.cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        self.seen, self.corners, self.first = False, None, None

    def _find_corners(self) -> None:
        kept = np.zeros(len(self.cuts), bool)
        cw, cs = self.w[self.cuts], self.s[self.cuts]
        for sign in (1.0, -1.0):
            i = np.arange(len(cw))
            while len(i) > 2:
                p, c, n = i[:-2], i[1:-1], i[2:]
                below = (cw[c] - cw[p]) * (cs[n] - cs[p]) >= (cs[c] - cs[p]) * (cw[n] - cw[p]) if sign > 0 else (cw[c] - cw[p]) * (cs[n] - cs[p]) <= (cs[c] - cs[p]) * (cw[n] - cw[p])
                below &= p // BLOCK == n // BLOCK
                i = np.r_[i[0], c[~below], i[-1]]
                if below.sum() < 0.01 * len(i):
                    break
            kept[i] = True
        self.corners = np.flatnonzero(kept)
        self.first = np.searchsorted(self.corners, np.arange(len(kept) // BLOCK + 2) * BLOCK)

    def best(self, a: int, b: int) -> tuple[float, int]:
        """The best split of rows a to b: what the sides' squares add up to, and where the right one begins."""
        low, high = np.searchsorted(self.cuts, (a + 1, b))
        from_, to = -(-low // BLOCK), high // BLOCK
        if self.seen and to > from_:
            if self.corners is None:
                self._find_corners()
            at = self.cuts[np.concatenate([np.arange(low, from_ * BLOCK), self.corners[self.first[from_] : self.first[to]], np.arange(to * BLOCK, high)])]
        else:
            at = self.cuts[low:high]
        self.seen = True
        if not len(at):
            return -np.inf, -1
        lw, ls = self.w[at] - self.w[a], self.s[at] - self.s[a]
        tw, ts = self.w[b] - self.w[a], self.s[b] - self.s[a]
        gain = ls * ls / lw + (ts - ls) ** 2 / (tw - lw)
        k = int(gain.argmax())
        return float(gain[k]), int(at[k])


def _between(a, b):
    middle = a / 2 + b / 2
    return np.where(middle < b, middle, a)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, most_levels: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A tree of rows (an array of _KIND; feature -1: a leaf), and what each feature's splits gained. Weights are counts."""
    n, d = x.shape
    gained = np.zeros(d)
    nodes = np.zeros(max(1, 2 * n - 1), _KIND)
    nodes["feature"], nodes["left"] = -1, -1
    if not n:
        return nodes, gained
    orders = [np.argsort(x[:, f], kind="stable") for f in range(d)]
    values, codes = [], []
    for f, o in enumerate(orders):
        v = x[o, f]
        new = np.r_[True, v[1:] > v[:-1]]
        values.append(v[new])
        if len(values[f]) <= NARROW:
            c = np.empty(n, np.int64)
            c[o] = np.cumsum(new) - 1
            codes.append(c)
        else:
            codes.append(None)
    place, starts, levels, made = np.zeros(n, np.int64), [0], [0], 1
    if n > SMALL:
        place, starts, levels, made = _grow_large(x, y, w, most_levels, orders, values, codes, nodes, gained)
    if starts:
        made = _grow_small(x, y, w, most_levels, orders, values, codes, nodes, gained, place, np.array(starts), np.array(levels), made)
    return nodes[:made].copy(), gained


def _grow_large(x, y, w, most_levels, orders, values, codes, nodes, gained):
    """Splits nodes of more than SMALL rows one by one. A stretch of an order needs no new sums, and of the histograms of features with
    few values the larger child's are what the smaller one's leave: so a split that takes few rows off many costs little. Returns
    each row's small node (-1: none), these nodes, their levels, and how many nodes there are."""
    n, d = x.shape
    s = w * (y - y.mean())  # gains don't depend on where labels begin, but their rounding does
    few, many = [f for f in range(d) if codes[f] is not None], [f for f in range(d) if codes[f] is None]
    ends = np.cumsum([len(values[f]) for f in few], dtype=np.int64)
    begins = np.r_[0, ends[:-1]].astype(np.int64)
    cells = int(ends[-1]) if few else 0
    coded = np.stack([codes[f] + b for f, b in zip(few, begins)], 1) if few else np.zeros((n, 0), np.int64)
    last = np.zeros(cells, bool)
    last[ends - 1] = True
    where = np.repeat(np.arange(len(few)), np.diff(np.r_[begins, cells])) if few else np.zeros(0, np.int64)

    def histograms(rows):
        c = coded[rows].ravel()
        return np.bincount(c, np.repeat(w[rows], len(few)), cells), np.bincount(c, np.repeat(s[rows], len(few)), cells)

    place, starts, levels, made = np.full(n, -1), [], [], 1
    is_left = np.zeros(n, bool)
    all_rows = np.arange(n)
    todo = [(0, 0, all_rows, {f: (_Order(orders[f], x[:, f], w, s), 0, n) for f in many}, histograms(all_rows))]
    while todo:
        node, level, rows, stretches, (hw, hs) = todo.pop()
        if most_levels is not None and level >= most_levels or not (y[rows[:64]] != y[rows[0]]).any() and not (y[rows] != y[rows[0]]).any():
            nodes["value"][node] = (w[rows] @ y[rows]) / w[rows].sum()
            continue
        best, feature, at = -np.inf, -1, -1
        if cells:
            cw, cs = np.cumsum(hw), np.cumsum(hs)
            lw, ls = cw - (cw[begins] - hw[begins])[where], cs - (cs[begins] - hs[begins])[where]
            tw, ts = lw[ends - 1][where], ls[ends - 1][where]
            ok = (hw > 0) & (lw < tw) & ~last
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, ls * ls / lw + (ts - ls) ** 2 / (tw - lw), -np.inf)
            k = int(gain.argmax())
            if ok[k]:
                best, feature, at = float(gain[k]), few[where[k]], k
        for f, (order, a, b) in stretches.items():
            g, k = order.best(a, b)
            if g > best or g == best and f < feature:
                best, feature, at = g, f, k
        if feature < 0:
            nodes["value"][node] = (w[rows] @ y[rows]) / w[rows].sum()
            continue
        if codes[feature] is None:
            order, a, b = stretches[feature]
            left, right = order.rows[a:at], order.rows[at:b]
            threshold = float(_between(x[left[-1], feature], x[right[0], feature]))
            tw, ts = order.w[b] - order.w[a], order.s[b] - order.s[a]
        else:
            j = where[at]
            goes = coded[rows, j] <= at
            left, right = rows[goes], rows[~goes]
            after = at + 1 + int(np.flatnonzero(hw[at + 1 : ends[j]] > 0)[0])
            threshold = float(_between(values[feature][at - begins[j]], values[feature][after - begins[j]]))
            tw, ts = hw[begins[j] : ends[j]].sum(), hs[begins[j] : ends[j]].sum()
        gained[feature] += max(best - ts * ts / tw, 0.0)
        nodes[node] = (feature, threshold, made, 0.0)
        sides = (left, right)
        large = [len(r) > SMALL for r in sides]
        if any(large):
            smaller = int(len(right) < len(left))
            own = histograms(sides[smaller])
            hist = [None, None]
            hist[smaller], hist[1 - smaller] = own, (hw - own[0], hs - own[1])
            others = [f for f in many if f != feature]
            if others:
                is_left[left], is_left[right] = True, False
        for k, r in enumerate(sides):
            if not large[k]:
                place[r] = len(starts)
                starts.append(made + k)
                levels.append(level + 1)
                continue
            own = {}
            for f in many:
                order, a, b = stretches[f]
                if f == feature:
                    own[f] = (order, a, at) if k == 0 else (order, at, b)
                else:
                    mine = order.rows[a:b]
                    mine = mine[is_left[mine] == (k == 0)]
                    own[f] = (_Order(mine, x[:, f], w, s), 0, len(mine))
            todo.append((made + k, level + 1, r, own, hist[k]))
        made += 2
    return place, starts, levels, made


def _grow_small(x, y, w, most_levels, orders, values, codes, nodes, gained, place, ids, levels, made):
    """Splits many nodes level by level. All lists of rows go by node, so a node is the same stretch of each. A feature of few values takes
    histograms by node while nodes are large; a list goes by node and value, and a split only regroups it, stably."""
    d = x.shape[1]
    wy, s = w * y, np.zeros(len(y))
    node = place.copy()  # a row's node on the present level
    lists: list[np.ndarray | None] = [None] * d
    for f in range(d):
        if codes[f] is None:
            o = orders[f][node[orders[f]] >= 0]
            lists[f] = o[np.argsort(node[o], kind="stable")]
    rows = next((o for o in lists if o is not None), None)
    if rows is None:
        rows = np.flatnonzero(node >= 0)
        rows = rows[np.argsort(node[rows], kind="stable")]
    while len(ids):
        count = len(ids)
        own = node[rows]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        total, yr = np.add.reduceat(w[rows], start), y[rows]
        mean = np.add.reduceat(wy[rows], start) / total
        s[rows] = w[rows] * (yr - mean[own])  # gains don't depend on where labels begin, but their rounding does
        sums = np.add.reduceat(s[rows], start)
        nodes["value"][ids] = mean
        varied = np.minimum.reduceat(yr, start) < np.maximum.reduceat(yr, start)
        one = np.diff(np.r_[start, len(rows)]) == 1
        nodes["value"][ids[one]] = yr[start[one]]  # no rounding
        best, feature, threshold = np.full(count, -np.inf), np.full(count, -1), np.zeros(count)
        same = own[1:] == own[:-1]
        for f in range(d):
            size = len(values[f])
            if size < 2:
                continue
            if lists[f] is None and count * size <= len(rows):
                key = own * size + codes[f][rows]
                hw, hs = np.bincount(key, w[rows], count * size).reshape(count, size), np.bincount(key, s[rows], count * size).reshape(count, size)
                lw, ls = np.cumsum(hw, 1), np.cumsum(hs, 1)
                ok = (hw > 0) & (lw < total[:, None])
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok, ls * ls / lw + (sums[:, None] - ls) ** 2 / (total[:, None] - lw), -np.inf)
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                kb = np.flatnonzero(top > best)
                best[kb], feature[kb] = top[kb], f
                at = at[kb]
                later = (hw[kb] > 0) & (np.arange(size) > at[:, None])
                threshold[kb] = _between(values[f][at], values[f][later.argmax(1)])
                continue
            if lists[f] is None:
                lists[f] = rows[np.argsort(own * size + codes[f][rows], kind="stable")]
            o = lists[f]
            v = x[o, f]
            can = np.flatnonzero(same & (v[1:] > v[:-1]))
            if not len(can):
                continue
            cw, cs = np.cumsum(w[o]), np.cumsum(s[o])
            k = own[can]
            lw, ls = cw[can] - (cw[start] - w[o[start]])[k], cs[can] - (cs[start] - s[o[start]])[k]
            gain = ls * ls / lw + (sums[k] - ls) ** 2 / (total[k] - lw)
            runs = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            full = np.full(count, -np.inf)
            full[k[runs]] = np.maximum.reduceat(gain, runs)
            hit = np.flatnonzero(gain == full[k])[::-1]
            first = np.full(count, -1)
            first[k[hit]] = can[hit]  # the last one set is the first one in the list
            kb = np.flatnonzero(full > best)
            c = first[kb]
            best[kb], feature[kb] = full[kb], f
            threshold[kb] = _between(v[c], v[c + 1])
        split = (feature >= 0) & varied
        if most_levels is not None:
            split &= levels < most_levels
        np.add.at(gained, feature[split], np.maximum(best - sums**2 / total, 0.0)[split])
        child = np.cumsum(split) * 2 - 2
        nodes["feature"][ids], nodes["threshold"][ids], nodes["left"][ids] = np.where(split, feature, -1), threshold, np.where(split, made + child, -1)
        count = 2 * int(split.sum())
        ids, levels = np.arange(made, made + count), np.repeat(levels[split] + 1, 2)
        made += count
        if not count:
            break
        on = split[own]
        here, own = rows[on], own[on]
        right = np.zeros(len(node), bool)
        right[here] = x[here, feature[own]] > threshold[own]
        goes = right[here]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sizes = np.diff(np.r_[begin, len(own)])
        before = np.cumsum(goes) - goes
        rights = np.add.reduceat(goes.astype(np.int64), begin)
        lefts_end = np.repeat(begin + sizes - rights - before[begin], sizes)  # with the rights so far: where a right row goes
        first = np.repeat(before[begin], sizes)
        i = np.arange(len(own))

        def regroup(o):
            o = o[on]  # noqa: B023
            r = right[o]  # noqa: B023
            so_far = np.cumsum(r) - r
            out = np.empty_like(o)
            out[np.where(r, lefts_end + so_far, i - so_far + first)] = o  # noqa: B023
            return out

        moved = regroup(rows)
        lists = [None if o is None else moved if o is rows else regroup(o) for o in lists]
        rows = moved
        node[here] = child[own] + goes
    return made


def leaf_of(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    todo = np.arange(len(x))
    while len(todo):
        f = tree["feature"][at[todo]]
        todo, f = todo[f >= 0], f[f >= 0]
        k = at[todo]
        at[todo] = tree["left"][k] + (x[todo, f] > tree["threshold"][k])
    return at


def flat(tree: np.ndarray) -> tuple[np.ndarray, ...]:
    """A tree by its parts that split by one feature alone: of each part its feature, where its thresholds begin and end in the sorted
    ones, and what lies between them (a part, or ~ a leaf). A row takes a binary search a part, however deep it is."""
    inner = np.flatnonzero(tree["feature"] >= 0)
    part = np.full(len(tree), -1)
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0), np.zeros(0, np.int64)
    level, parts, features = np.zeros(1, np.int64), 1, [tree["feature"][:1].astype(np.int64)]
    part[0] = 0
    while len(level):
        left = tree["left"][level].astype(np.int64)
        below, above = np.r_[left, left + 1], np.r_[level, level]
        f = tree["feature"][below]
        keep = f >= 0
        below, above, f = below[keep], above[keep], f[keep]
        new = f != tree["feature"][above]
        part[below] = np.where(new, parts + np.cumsum(new) - 1, part[above])
        features.append(f[new].astype(np.int64))
        parts += int(new.sum())
        level = below
    order = inner[np.lexsort((tree["threshold"][inner], part[inner]))]
    rank = np.arange(len(order))
    begin = np.searchsorted(part[order], np.arange(parts + 1))
    gaps = np.empty(len(order) + parts, np.int64)  # a part has one more gap than thresholds
    left = tree["left"][order].astype(np.int64)
    for child, at in ((left, rank + part[order]), (left + 1, rank + part[order] + 1)):
        out = part[child] != part[order]
        gaps[at[out]] = np.where(part[child] >= 0, part[child], ~child)[out]
    return np.concatenate(features), begin, tree["threshold"][order], gaps


def find(parts: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Leaves of rows, as leaf_of's."""
    features, begin, thresholds, gaps = parts
    out = np.zeros(len(x), np.int64)
    if not len(features):
        return out
    at = np.searchsorted(thresholds[: begin[1]], x[:, features[0]], side="left")
    todo, to = np.arange(len(x)), gaps[at]
    while True:
        done = to < 0
        out[todo[done]] = ~to[done]
        todo, to = todo[~done], to[~done]
        if not len(todo):
            return out
        v, low, high = x[todo, features[to]], begin[to], begin[to + 1]
        while True:
            on = low < high
            if not on.any():
                break
            middle = (low + high) // 2
            up = on & (v > thresholds[np.minimum(middle, len(thresholds) - 1)])
            high = np.where(on & ~up, middle, high)
            low = np.where(up, middle + 1, low)
        to = gaps[low + to]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class DeepForest:
    n_estimators: int = 200
    seed: int = 42
    bootstrap: bool = True
    local_rows: int = LOCAL_ROWS
    max_depth: int | None = None  # None: no limit

    def fit(self, df: DataFrame) -> DeepForestModel:
        rows = df.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).cast("double").alias("y"), F.monotonically_increasing_id().alias("id"))
        spread = 2 * df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < spread and df.limit(SPREAD_ROWS + 1).count() > SPREAD_ROWS:
            rows = rows.repartition(spread)  # a small file is one partition, but each of its rows goes to all trees
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n, width = rows.count(), len(rows.first()["x"])
            tops = [_leaf() for _ in range(self.n_estimators)]
            gained = np.zeros((self.n_estimators, width))
            if n > self.local_rows:
                self._grow_tops(rows, n, width, tops, gained)
            subtrees = self._subtrees(rows, tops).persist(StorageLevel.DISK_ONLY)
            size = 0
            for r in subtrees.groupBy("tree").agg(F.sum("size").alias("size"), *(F.sum(F.col("gained")[f]).alias(f"_{f}") for f in range(width))).collect():
                gained[r["tree"]] += [r[f"_{f}"] for f in range(width)]
                size += r["size"]
            small = {(r["tree"], r["leaf"]): np.frombuffer(r["nodes"], _KIND) for r in subtrees.select("tree", "leaf", "nodes").collect()} if size <= BROADCAST_BYTES else None
        finally:
            rows.unpersist()
        if small is not None:
            subtrees.unpersist()
        shares = gained / np.maximum(gained.sum(1, keepdims=True), 1e-300)
        total = shares.mean(0)
        return DeepForestModel(tops, small, None if small is not None else subtrees, (total / max(total.sum(), 1e-300)).tolist(), int(BUNDLE_BYTES * self.n_estimators / max(size, 1)))

    def _weights(self, ids: np.ndarray, tree: int) -> np.ndarray:
        return weights(ids, tree, self.seed) if self.bootstrap else np.ones(len(ids))

    def _grow_tops(self, rows: DataFrame, n: int, width: int, tops: list[np.ndarray], gained: np.ndarray) -> None:
        """Splits nodes of more than local_rows rows, a level a scan."""
        at = [k / BINS for k in range(1, BINS)]
        cuts = rows.agg(*(F.percentile_approx(F.col("x")[f], F.array(*map(F.lit, at)), F.lit(2_000)).alias(f"_{f}") for f in range(width))).first()
        edges = [np.unique(np.array(c, float)) for c in cuts]
        todo, depth = [(t, 0) for t in range(self.n_estimators)], 0
        while todo and (self.max_depth is None or depth < self.max_depth):
            asked: dict[int, list[int]] = {}
            for t, leaf in todo:
                asked.setdefault(t, []).append(leaf)

            def add(batches):
                sums: dict[tuple[int, int], np.ndarray] = {}
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x, y, ids = _matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("id").to_numpy()
                    cells = np.stack([np.searchsorted(e, x[:, f], side="left") + f * (BINS + 1) for f, e in enumerate(edges)], 1)
                    for t, leaves in asked.items():  # noqa: B023
                        w, place = self._weights(ids, t), leaf_of(tops[t], x)
                        for leaf in leaves:
                            m = np.flatnonzero((place == leaf) & (w > 0))
                            if len(m):
                                h = sums.setdefault((t, leaf), np.zeros((width, BINS + 1, 4)))
                                key = cells[m].ravel()
                                for j, v in enumerate((np.ones(len(m)), w[m], w[m] * y[m], w[m] * y[m] ** 2)):
                                    h[:, :, j] += np.bincount(key, np.repeat(v, width), width * (BINS + 1)).reshape(width, -1)
                if sums:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([h.tobytes() for h in sums.values()], pa.binary())], names=["tree", "leaf", "h"])

            def best(pdf: pd.DataFrame) -> pd.DataFrame:
                h = sum(np.frombuffer(b).reshape(width, BINS + 1, 4) for b in pdf["h"])
                c = h.cumsum(1)
                whole = c[:, -1:, :]
                lw, ls, tw, ts = c[:, :-1, 1], c[:, :-1, 2], whole[..., 1], whole[..., 2]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = ls**2 / lw + (ts - ls) ** 2 / (tw - lw) - ts**2 / tw
                gain[(c[:, :-1, 0] == 0) | (c[:, :-1, 0] == whole[..., 0])] = -np.inf
                lesser = np.minimum(c[:, :-1, 0], whole[..., 0] - c[:, :-1, 0])
                even = np.where(8 * lesser >= whole[..., 0], gain, -np.inf)
                gain = even if even.max() > -np.inf else gain
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                mean = ts[0, 0] / tw[0, 0]
                spread = whole[0, 0, 3] - ts[0, 0] * mean
                ok = np.isfinite(gain[f, b]) and spread > 1e-12 * max(whole[0, 0, 3], 1e-300)
                left, all_ = int(c[f, b, 0]), int(whole[0, 0, 0])
                return pd.DataFrame([(pdf["tree"].iloc[0], pdf["leaf"].iloc[0], int(f) if ok else -1, int(b), float(gain[f, b]) if ok else 0.0, left, all_ - left, float(mean))], columns=["tree", "leaf", "feature", "bin", "gain", "left", "right", "value"])

            parts = rows.mapInArrow(add, "tree int, leaf int, h binary")
            found = parts.groupBy("tree", "leaf").applyInPandas(best, "tree int, leaf int, feature int, bin int, gain double, left long, right long, value double").collect()
            todo, depth = [], depth + 1
            for r in sorted(found, key=lambda r: (r["tree"], r["leaf"])):
                t, leaf = r["tree"], r["leaf"]
                if r["feature"] < 0 or r["bin"] >= len(edges[r["feature"]]):
                    continue  # no bin tells these rows apart: they go to one task
                k = len(tops[t])
                tops[t][leaf]["feature"], tops[t][leaf]["threshold"], tops[t][leaf]["left"] = r["feature"], edges[r["feature"]][r["bin"]], k
                tops[t] = np.concatenate([tops[t], _leaf(), _leaf()])
                gained[t, r["feature"]] += r["gain"]
                todo += [(t, k + j) for j, size in enumerate((r["left"], r["right"])) if size > self.local_rows]

    def _subtrees(self, rows: DataFrame, tops: list[np.ndarray]) -> DataFrame:
        def route(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, ids = _matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("id").to_numpy()
                for t, top in enumerate(tops):
                    w = self._weights(ids, t)
                    at = np.flatnonzero(w > 0)
                    place, out = leaf_of(top, x[at]), []
                    for leaf in np.unique(place).tolist():
                        own = at[place == leaf]
                        out.append((t, leaf, x[own].tobytes(), y[own].tobytes(), w[own].tobytes()))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), _GROWN)], schema=_GROWN)

        depth = self.max_depth

        def finish(key, group):
            x, y, w = (np.frombuffer(b"".join(group.column(c).to_pylist())) for c in "xyw")
            nodes, gained = grow(x.reshape(len(y), -1), y, w, depth)
            return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "leaf": pa.array([key[1].as_py()], pa.int32()), "nodes": pa.array([nodes.tobytes()], pa.binary()), "size": pa.array([nodes.nbytes], pa.int64()), "gained": pa.array([gained.tolist()], pa.list_(pa.float64()))})

        routed = rows.mapInArrow(route, "tree int, leaf int, x binary, y binary, w binary")
        parts = min(2 * sum(int((top["feature"] < 0).sum()) for top in tops), 1000)  # more than groups, as each takes long
        return routed.repartition(parts, "tree", "leaf").groupBy("tree", "leaf").applyInArrow(finish, "tree int, leaf int, nodes binary, size long, gained array<double>")


_GROWN = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("w", pa.binary())])
#: Queries of which one task may hold all that lead to some trees, bytes of trees that they meet at a time (a tree may be larger), and
#: rows of which a table of one partition is spread.
QUERIES, BUNDLE_BYTES, SPREAD_ROWS = 250_000, 32_000_000, 8192
_ROUTED = pa.schema([("meets", pa.int32()), ("at", pa.int32()), ("p", pa.binary()), ("q", pa.binary()), ("v", pa.binary())])


_ANSWER = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("s", pa.float64())])


def _leaf() -> np.ndarray:
    leaf = np.zeros(1, _KIND)
    leaf["feature"], leaf["left"] = -1, -1
    return leaf


@dataclass
class DeepForestModel:
    """tops: what was split over all tasks; below each of their leaves a subtree, in `small` or (many) in a table. bundle: how many whole
    trees queries meet at a time; 0 if trees are so large that they meet subtrees."""

    tops: list[np.ndarray]
    small: dict[tuple[int, int], np.ndarray] | None
    subtrees: DataFrame | None
    importances: list[float] = field(default_factory=list)
    bundle: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        tops, small, trees, bundle = self.tops, self.small, len(self.tops), self.bundle
        df = df.drop(PREDICTION)
        x = vector_to_array(FEATURES)
        if small is not None:
            known: dict[tuple[int, int], tuple] = {}

            @F.pandas_udf("double")
            def predict(column: pd.Series) -> pd.Series:
                q = np.array(column.tolist(), float).reshape(len(column), -1)
                total = np.zeros(len(q))
                for t, top in enumerate(tops):
                    place = leaf_of(top, q)
                    for leaf in np.unique(place).tolist():
                        at, tree = np.flatnonzero(place == leaf), small.get((t, leaf))
                        if tree is not None:
                            if (t, leaf) not in known:
                                known[t, leaf] = flat(tree)
                            total[at] += tree["value"][find(known[t, leaf], q[at])]
                return pd.Series(total / trees)

            return df.withColumn(PREDICTION, predict(x))
        queries = df.select(F.xxhash64(x).alias("p"), F.xxhash64(F.lit(1), x).alias("q"), x.alias("x")).dropDuplicates(["p", "q"])

        def route(batches):
            """Rows in blocks: one for each bundle of trees, or for each subtree that some rows of a batch lead to."""
            for batch in batches:
                for low in range(0, batch.num_rows, 4096):
                    part = batch.slice(low, 4096)
                    p, q, v, out = part.column("p").to_numpy(), part.column("q").to_numpy(), _matrix(part.column("x")), []
                    if bundle:
                        out = [(t, 0, p.tobytes(), q.tobytes(), v.tobytes()) for t in range(-(-trees // bundle))]
                    for t, top in enumerate([] if bundle else tops):
                        place = leaf_of(top, v)
                        for leaf in np.unique(place).tolist():
                            at = np.flatnonzero(place == leaf)
                            out.append((t, leaf, p[at].tobytes(), q[at].tobytes(), v[at].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), _ROUTED)], schema=_ROUTED)

        def answer(blocks, grown):
            """Trees are read once for all queries of a slice that lead to them, not once for each block of them."""
            if not grown.num_rows or not blocks.num_rows:
                return _ANSWER.empty_table()
            p, q = (np.frombuffer(b"".join(blocks.column(c).to_pylist()), np.int64) for c in "pq")
            v = np.frombuffer(b"".join(blocks.column("v").to_pylist())).reshape(len(p), -1)
            total, places = np.zeros(len(p)), {}
            for k in range(grown.num_rows):
                t, leaf, nodes = (grown.column(c)[k] for c in ("tree", "leaf", "nodes"))
                t, leaf, nodes = t.as_py(), leaf.as_py(), np.frombuffer(nodes.as_buffer(), _KIND)
                if bundle and t not in places and len(tops[t]) > 1:
                    places[t] = leaf_of(tops[t], v)
                at, parts = np.flatnonzero(places[t] == leaf) if t in places else np.arange(len(p)), flat(nodes)
                for low in range(0, len(at), 16384):
                    some = at[low : low + 16384]
                    total[some] += nodes["value"][find(parts, v[some])]
            return pa.table({"p": p, "q": q, "s": total}, schema=_ANSWER)

        slices = max(1, -(-queries.count() // QUERIES))
        key = ["meets", "at", "slice"]
        packed = queries.mapInArrow(route, "meets int, at int, p binary, q binary, v binary").withColumn("slice", F.pmod(F.xxhash64("p"), F.lit(slices)).cast("int"))
        meets, at = (F.floor(F.col("tree") / bundle).cast("int"), F.lit(0)) if bundle else (F.col("tree"), F.col("leaf"))
        grown = self.subtrees.select("tree", "leaf", meets.alias("meets"), at.alias("at"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "nodes")
        parts = packed.groupBy(*key).cogroup(grown.groupBy(*key)).applyInArrow(answer, "p long, q long, s double")
        found = parts.groupBy("p", "q").agg((F.sum("s") / trees).alias(PREDICTION))
        keyed = df.withColumns({"_p": F.xxhash64(x), "_q": F.xxhash64(F.lit(1), x)})
        return keyed.join(found, (F.col("_p") == found["p"]) & (F.col("_q") == found["q"])).drop("_p", "_q", "p", "q")
