import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lathe.llm import fingerprints as fp


def near(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128


def plain(rows):
    """What the query returns, by plain loops."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    hexed = {t: fp.weighted_simhash(t).hex() for _, t in rows}
    out = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        e = fp.weighted_simhash(edited).hex()
        others = {h for h in hexed.values() if 0 < (int(h, 16) ^ int(hexed[t], 16)).bit_count() <= fp.RADIUS}
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed[t], e, near(hexed[t], e), near(hexed[t], hexed[following]), len(others) if i % 50 == 0 else None)
    return out


def make_rows(n=230):
    rnd = random.Random(3)
    words = ["wörd%d" % k for k in range(300)] + ["😀", "of", "the"] * 20
    rows = []
    for i in range(n):
        k = rnd.choice([0, 1, 2, 3, 40, 200])
        text = rnd.choice(rows)[1] if rows and rnd.random() < 0.2 else " ".join(rnd.choices(words, k=k))
        if text and rnd.random() < 0.2:
            text += " end"
        rows.append((i * 7 if i % 2 else i * 5000, text))
    return list(dict(rows).items()) + [(99_999_950, None), (99_999_951, "long text " * 20_000)]


@pytest.mark.parametrize("buckets", ["1", "4", "13"])
def test_query_against_plain_loops(spark, tmp_path, buckets):
    rows = make_rows()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.n_near) for r in fp.op2_document_fingerprints(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain(rows)


def test_search_finds_all_within_the_radius(spark, monkeypatch):
    rnd = random.Random(8)
    values = [rnd.getrandbits(128) for _ in range(40)]
    for _ in range(300):
        x = rnd.choice(values)
        for b in rnd.sample(range(128), rnd.randrange(1, 9)):
            x ^= 1 << b
        values.append(x)
    df = spark.createDataFrame([(f"{v:032x}",) for v in values + values[:5]], "fp string")
    df = df.withColumn("id", F.xxhash64("fp"))
    ids = {r.fp: r.id for r in df.collect()}
    for radius, flips in ((0, 0), (3, 0), (6, 1), (17, 2)):
        monkeypatch.setattr(fp, "SLICE", 7 if radius == 6 else 20_000)
        monkeypatch.setattr(fp, "_PAIRS", 50 if radius == 3 else 2_000_000)
        rows = fp.within(df, df.limit(200), radius, flips).collect()
        got = {r.fp: (r.n_near, r.n_near_rows) for r in rows}
        for r in rows:
            near = [((v ^ int(r.fp, 16)).bit_count(), ids[f"{v:032x}"]) for v in set(values) if 0 < (v ^ int(r.fp, 16)).bit_count() <= radius]
            assert (r.near_bits, r.near_id) == min(near, default=(None, None))
        distinct = {v: values.count(v) + values[:5].count(v) for v in values}
        for h, found in got.items():
            hits = [v for v in distinct if 0 < (v ^ int(h, 16)).bit_count() <= radius]
            assert found == (len(hits), sum(distinct[v] for v in hits))


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").fillna("", ["text"])
    follow = lambda df: fp.with_next(df, "doc_id", "text", {"t": F.col("text")}, buckets=3)
    got = follow(docs).collect()
    assert sorted(r.t for r in got) == sorted(r.next_t for r in got) == ["", "a", "a", "b", "c"]
    assert [r.next_t for r in got if r.doc_id is None] == [""]
    assert follow(docs.limit(0)).count() == 0
    assert [r.next_t for r in follow(docs.where("doc_id = 5")).collect()] == [""]


def test_weights_and_empty_text():
    assert fp.weighted_simhash(" \n") == bytes(16)
    assert fp.weighted_simhash("a b c d") == fp.weighted_simhash("A  B\nc d")
    rnd = random.Random(1)
    base = [str(rnd.randrange(10**6)) for _ in range(400)]
    other = [str(rnd.randrange(10**6)) for _ in range(400)]
    h = [fp.weighted_simhash(" ".join(w)).hex() for w in (base, base[:300] + other[:100], other)]
    assert near(h[0], h[1]) > 0.7 > 0.65 > near(h[0], h[2])
