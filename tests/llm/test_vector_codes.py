"""Vector codes against plain Python."""

import hashlib
import math
import random

import pytest

from lathe.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _row string"


def brute(rows, parts=8, entries=16, rounds=6):
    """rows of (vec_id, vector or None, label) -> codes and errors in the order of kept rows, and the codebooks."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    cut = []
    for _, v, _ in kept:
        scaled = [max(-(2**53), min(2**53, math.floor(4096 * x))) for x in v] + [0] * (parts * width - len(v))
        cut.append([tuple(scaled[p * width : (p + 1) * width]) for p in range(parts)])
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2] is None, kept[k][2] or 0, cut[k]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, part: min((dist(part, e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds if kept else 0):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(near(p, c[p])[1], []).append(c[p])
            for j, got in mine.items():
                books[p][j] = tuple(sum(x) // len(got) for x in zip(*got))
    codes = []
    for (i, _, label), c in zip(kept, cut):
        found = [near(p, c[p]) for p in range(parts)]
        codes.append((i, label, "".join(f"{j:02x}" for _, j in found), min(sum(d for d, _ in found), 2**63 - 1)))
    return codes, books


def key(rows):
    return sorted(rows, key=repr)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows], SCHEMA).repartition(3)
    found = V.compress(df, **kw)
    want, books = brute([(i, v, y) for i, v, y in rows], **kw)
    got = [(r["vec_id"], r["label"], r["code"], r["error"]) for r in V.with_label_error(found.rows).collect()]
    assert key(got) == key(want)
    assert found.books == books
    sums = {}
    for _, y, _, e in want:
        sums[y] = min(sums.get(y, 0) + e, 2**63 - 1)
    for r in V.with_label_error(found.rows).collect():
        assert r["label_error"] == sums[r["label"]]
    assert found.digest == hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_same_as_plain_python_with_hot_parts_labels_and_faulty_rows(spark):
    rng = random.Random(5)
    single = lambda x: float(__import__("numpy").float32(x))
    rows = [(k, [single(rng.gauss(0, 0.2)) for _ in range(16)], rng.choice([None, 1, 2])) for k in range(150)]
    rows += [(1000 + k, [0.25] * 16, 7) for k in range(600)]  # a vector and a label that most rows have
    rows += [(3000 + k, [0.5, 0.5] + [single(rng.gauss(0, 1)) for _ in range(14)], k) for k in range(100)]
    rows += [(-5, None, 1), (-4, [float("nan")] * 16, 1), (-3, [None] + [0.0] * 15, 1), (-2, [float("inf")] + [0.0] * 15, 1)]
    rows += [(9, rows[9][1], rows[9][2]), (None, [1.0] * 16, None)]
    check(spark, rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, None)],
        [(1, [], 1), (2, [], None)],
        [(3, [1.0, -1.0, 0.5], 1), (2, [0.25] * 9, 1), (2, [0.25] * 9, 1)],
        [(k, [-0.00001 * k] * 8, None) for k in range(20)],
        [(k, [(-1) ** k * 3e38] * 8, k % 2) for k in range(20)] + [(50, [1e9] * 8, 0)],
    ],
)
def test_edge_cases(spark, rows):
    check(spark, rows)


def test_other_numbers_of_parts_entries_and_rounds(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randrange(-8, 8) / 16 for _ in range(8)], k % 3) for k in range(60)]
    check(spark, rows, parts=4, entries=5, rounds=2)
