import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lathe.llm import common, components, neardup


def plain_groups(ids, linked):
    """Least member of each one's group, by brute force over all pairs."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def plain_simhash(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_fingerprints(seed, n=400):
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        x = rnd.choice(out)
        for bit in rnd.sample(range(64), rnd.randrange(1, 5)):
            x ^= 1 << bit
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("seed,per_slice,per_bucket", [(1, 4_000_000, 4_000_000), (2, 500, 4_000_000), (3, 4_000_000, 60)])
def test_links_connect_what_all_pairs_connect(spark, seed, per_slice, per_bucket):
    fps = near_fingerprints(seed)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(t, x) for x in signed for t in (0, 3)], "t int, f long").repartition(3)
    found = neardup.links(df, per_bucket=per_bucket, per_slice=per_slice).collect()
    pairs = [(r.a, r.b) for r in found if r.t == 0]
    assert sorted(pairs) == sorted((r.a, r.b) for r in found if r.t == 3)
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(1 <= distance(a, b) <= 3 for a, b in pairs)
    direct = {frozenset(p) for p in pairs}
    assert plain_groups(signed, lambda a, b: frozenset((a, b)) in direct) == plain_groups(signed, lambda a, b: distance(a, b) <= 3)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(rnd.randrange(300, 500), rnd.randrange(300, 500)) for _ in range(90)]
    edges += [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = {frozenset(e) for e in edges if None not in e and e[0] != e[1]}
    nodes = sorted(set().union(*real))
    want = plain_groups(nodes, lambda a, b: frozenset((a, b)) in real)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("piece", [200_000, 50, 1])
def test_components_of_pieces_with_hubs(spark, piece):
    """Hubs of more edges than a task's share, paths and random edges, contracted at once or by pieces."""
    rnd = random.Random(6)
    edges = [(20_000 + 3 * i, 9_000 + i % 2) for i in range(900)] + [(8_000, 20_000 + 3 * i) for i in range(0, 900, 7)] + [(i, i + 1) for i in range(40)]
    edges += [(rnd.randrange(300, 900), rnd.randrange(300, 900)) for _ in range(250)] + [(5, 5), (None, 3)]
    rnd.shuffle(edges)
    name = lambda v: None if v is None else bytearray(v.to_bytes(4, "big"))
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges * 2], "a binary, b binary")
    got = sorted((bytes(r.node), bytes(r.root)) for r in components.components(df, piece).collect())
    parent = {}

    def root(v):
        while parent.get(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == sorted((bytes(name(v)), bytes(name(root(v)))) for v in parent if root(v) != v)


def test_components_of_small_graphs_take_few_stages(spark):
    """Each stage and scan costs the driver memory: a long path had taken some hundred stages, with plans of 200 kB."""
    edges = common.durable(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"), "path")
    spark.sparkContext.setJobGroup("few-stages", "components of a path")
    try:
        assert components.components(edges).count() == 60
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few-stages") for s in tracker.getJobInfo(j).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(stages) <= 25


def make_docs():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 6)))
    rows = []
    for i in range(60):
        words = [word() for _ in range(rnd.choice([0, 1, 2, 3, 80, 400]))]
        rows.append((len(rows), " ".join(words)))
        if i % 3 == 0:
            rows.append((len(rows), "\n".join(words).upper().replace("É", "é")))
        if i % 3 == 1 and len(words) > 50:
            words[10] = "changed"
            rows.append((len(rows), " ".join(words)))
    return rows + [(900, None), (901, " \t\x0b\n"), (902, "x y z\x1cw"), (903, "long word " * 30_000), (None, "only this null id")]


def test_query_against_brute_force(spark, tmp_path):
    rows = make_docs()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in neardup.op5_simhash_neardup(spark, str(tmp_path)).collect()}
    fps = {i: plain_simhash(t or "") for i, t in rows if i is not None}
    want = plain_groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert got.pop(None)[1] is None
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_deduplicate_keeps_one_row_and_all_columns(spark):
    rows = [(1, "a b c d", "s", 5), (2, "A B c d", "t", 6), (2, "A B c d", "t", 6), (3, "other text here now", "s", 7), (3, "other text here now", "s", 7), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    out = neardup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    assert neardup.deduplicate(docs.where("doc_id <> 3 and doc_id <> 2")).count() == 2
    assert neardup.deduplicate(docs.limit(0)).count() == 0


def test_deduplicate_tells_rows_of_one_id_apart(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(None, text(k)) for k in range(8)] + [(None, text(0)), (None, text(20)), (1, text(20))]  # 8 texts without an id, one of them twice, and a copy of 1
    rows += [(2, text(20)), (2, text(21)), (3, text(22)), (3, text(23)), (3, text(23)), (4, text(24))]  # 2: a copy and a text of its own
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, norm long").repartition(4)
    out = neardup.deduplicate(docs)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(None, text(k)) for k in range(8)] + [(1, text(20)), (2, text(21)), (3, text(22)), (3, text(23)), (4, text(24))]
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(want, key=key)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def edited_copies(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8)))
    texts = []
    for base in range(25):
        words = [word() for _ in range(rnd.choice([40, 120, 250]))]
        texts.append(" ".join(words))
        for _ in range(rnd.randrange(0, 9)):
            copy = list(words)
            for _ in range(max(1, len(words) * rnd.randrange(1, 6) // 200)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(texts)] + [(990, "a b c"), (991, "A b\nc"), (992, None), (993, "")]


def test_similar_groups_against_all_pairs(spark):
    rows = edited_copies()
    sets, fps = {i: shingles(t) for i, t in rows}, {i: plain_simhash(t or "") for i, t in rows}

    def similar(a, b):
        x, y = sets[a], sets[b]
        return (fps[a] ^ fps[b]).bit_count() <= 3 or (bool(x | y) and len(x & y) / len(x | y) >= 0.8)

    want = plain_groups([i for i, _ in rows], similar)
    got = {r.id: r.component_id for r in neardup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(want[got[i]] == want[i] for i in got)  # no group holds texts that aren't linked
    assert np.mean([got[i] == want[i] for i in got]) > 0.95
    assert sum(v != k for k, v in want.items()) > 40


@pytest.mark.parametrize("block,task_shingles", [(500_000, 8_000_000), (900, 3000)])
def test_pairs_are_verified_before_links_are_thinned(spark, block, task_shingles):
    """Each text's edits spread over it, so A, the least text of most meetings, is unlike the others (0.6 to
    0.75), while two and two of these are alike: no link may be lost because A is not a link of theirs. The same
    for texts of the same words in many orders, two and two of which differ by two swaps."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(8))
    rows, pairs = [], []
    for base in range(4):
        words = [word() for _ in range(220)]
        rows.append((len(rows), " ".join(words)))
        for _ in range(12):
            one = list(words)
            for _ in range(10):
                one[rnd.randrange(len(one))] = word()
            two = list(one)
            two[rnd.randrange(len(two))] = word()
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    words = [word() for _ in range(220)]
    for _ in range(20):
        rnd.shuffle(words)
        two = list(words)
        for k in (50, 150):
            two[k], two[k + 1] = two[k + 1], two[k]
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(two))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r.component_id for r in neardup.similar_groups(docs, block=block, task_shingles=task_shingles).collect()}
    assert all(got[a] == got[b] for a, b in pairs)
    sets = {i: shingles(t) for i, t in rows}
    fps = {i: plain_simhash(t) for i, t in rows}
    similar = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3 or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert got == plain_groups(list(sets), similar)


def test_similarity_is_exact_at_every_size():
    rnd = random.Random(2)
    for n in (6, 50, 2000, 60_000):
        words = [str(rnd.randrange(10**6)) for _ in range(n)]
        other = words[: n // 10 * 9] + [str(rnd.randrange(10**6)) for _ in range(n // 10)]
        a, b = (" ".join(w) for w in (words, other))
        x, y = shingles(a), shingles(b)
        sets = [s.as_py() for s in neardup._signatures([a, b], 5)[2]]
        assert abs(neardup.jaccard(*sets) - len(x & y) / len(x | y)) <= (0.0 if n < 10_000 else 1e-4)
    assert neardup.jaccard(b"", b"") == 0.0


def test_long_texts_are_compared_whole(spark):
    """Two texts of 3,000 words that differ in the middle only, on either side of a similarity of 0.8."""
    words = [f"w{k}" for k in range(3000)]
    near, far = list(words), list(words)
    near[1400:1700] = [f"n{k}" for k in range(300)]  # 2,692 of 3,300
    far[1400:1740] = [f"f{k}" for k in range(340)]  # 2,652 of 3,340
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r.id: r.component_id for r in neardup.similar_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_spread_join_splits_hot_keys(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), "id")
    right = left.select("k").distinct().withColumn("v", F.col("k") * 2)
    out = common.spread_join(left, right, "k", 5000)
    assert out.count() == 5000 and out.where("v = 2 * k").count() == 5000 and sorted(out.columns) == ["id", "k", "v"]
    assert common.spread_join(left.limit(0), right, "k", 0).count() == 0


def test_deduplicate_with_columns_named_like_its_own(spark):
    rows = [(1, "a b c d e f g h", 1), (2, "a b c d e f g h", 2), (3, "other words are here for all to read", 3), (3, "yet another text that shares its id only", 4), (None, None, 5)]
    df = spark.createDataFrame([(*r, *"vwxyz") for r in rows], "doc_id long, text string, n int, _gone string, _shared string, _norm string, _id string, _kept string")
    got = neardup.deduplicate(df)
    assert got.columns == df.columns and sorted(r.n for r in got.collect()) == [1, 3, 4, 5]
