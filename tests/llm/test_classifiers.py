import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.llm import labelled, quality_crf, toxicity


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def toxic_corpus(n=500):
    rnd = random.Random(6)
    syllables = ["ta", "re", "on", "li", "mu", "sek", "vo"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randrange(20, 120))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words[rnd.randrange(len(words))] = rnd.choice(["blorg", "Blorgly", "fnord!"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs + [(9000, None), (9001, ""), (9002, "..."), (9003, "ta " * 50_000), (9003, "ta re"), (None, "blorg fnord")], labels + [(9100, 1, None), (None, 1, 1)]


def test_toxicity_held_out_accuracy(spark, tmp_path):
    docs, labels = toxic_corpus()
    write(spark, tmp_path, docs, labels)
    got = toxicity.op3_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id < 9000]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert len({r.score for r in got if r.doc_id in (9000, 9001, 9002)}) == 1


def plain_model(rows, discount=toxicity.DISCOUNT, mix=toxicity.MIX):
    """rows: text, label. The value of a word, computed in plain Python from the definitions."""
    pairs = [set(), set()]
    for text, label in rows:
        words = toxicity.words_of(text)
        pairs[label].update(zip([None, *words], words))
    n = [Counter(w for _, w in p) for p in pairs]
    known = sorted(n[0].keys() | n[1].keys())
    stem = lambda w: w[: toxicity.STEM]
    of = {}
    for w in known:
        of.setdefault(stem(w), []).append(w)
    count = lambda s, c: sum(n[c][w] for w in of[s])
    log = lambda a, b: math.log(a / b) if a > 0 and b > 0 else 0.0
    g = lambda v: math.log1p(mix * math.expm1(min(v, 30)))
    total = [sum(c.values()) for c in n]
    freed = [sum(min(discount, count(s, c)) for s in of) for c in (0, 1)]

    def value(w):
        s = stem(w)
        if s not in of:
            return g(log(freed[1] / total[1], freed[0] / total[0]))
        a = [count(s, c) for c in (0, 1)]
        p = [(max(a[c] - discount, 0) + freed[c] * len(of[s]) / len(known)) / total[c] for c in (0, 1)]
        ratio = log(p[1], p[0])
        if a[0] and a[1]:
            f = [sum(min(discount, n[c][x]) for x in of[s]) for c in (0, 1)]
            q = [(max(n[c][w] - discount, 0) + f[c] / len(of[s])) / a[c] for c in (0, 1)]
            ratio += log(q[1], q[0]) if n[0][w] + n[1][w] else log(f[1] / a[1], f[0] / a[0])
        return g(ratio)

    return value


@pytest.mark.parametrize("entries", [20, 60, 10**6])
def test_toxicity_scores_against_plain_python(spark, entries, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 3000)
    docs, labels = toxic_corpus(200)
    docs += [(20_000, "never seen taresek words blorgs"), (20_001, "ta " * 40)]
    d = spark.createDataFrame([(*r, 1.5) for r in docs], "doc_id long, text string, mean double").repartition(4)
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), entries=entries)
    assert model.buckets == -(-model.nodes.count() // entries)
    truth = {i: t for i, _, t in labels if t is not None}
    parts = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in truth if i is not None], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(4))).collect()}
    value = plain_model([(t, truth[i]) for i, t in docs if i in parts and parts[i] != 0])
    out = toxicity.score(d, model)
    assert out.columns == [*d.columns, "toxicity_score", "toxicity_predicted"]
    got = out.collect()
    assert len(got) == len(docs)
    for r in got:
        words = toxicity.words_of(r.text)
        z = model.intercept + model.slope * (sum(map(value, words)) / max(1, len(words)))
        assert math.isclose(r.toxicity_score, 1 / (1 + math.exp(-z)), abs_tol=1e-6)
    kept = toxicity.without_toxic(d, model)
    assert kept.columns == d.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(repr(tuple(r)[:3]) for r in got if not r.toxicity_predicted)


def test_repeated_passages_are_one_piece_of_evidence(spark):
    rows = spark.createDataFrame([("a b a b a b", 0), ("a b a b a b", 0), ("b x b", 1), (None, 1)], "text string, label_ int")
    assert {r.word: (r.n0, r.n1) for r in toxicity.word_counts(rows, "text").collect()} == {"a": (2, 0), "b": (1, 2), "x": (0, 1)}


def test_toxicity_without_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 3.0)], "doc_id long, text string, n0 double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "toxicity_score", "toxicity_predicted"] and out.first().toxicity_predicted in (0, 1)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_fold_matches_zlib(spark):
    ids = [0, 1, 49, 123456789012, -5]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select(labelled.fold(F.col("i"), 5)).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 5 for i in ids]


@pytest.mark.parametrize("seed", range(3))
def test_forward_backward_and_gradient_by_enumeration(seed):
    rng = np.random.default_rng(seed)
    odds, pairs = rng.normal(size=5), rng.normal(size=4)
    total, good = 0.0, np.zeros(5)
    for labels in product((0, 1), repeat=5):
        weight = np.exp(sum(o for o, y in zip(odds, labels) if y) + sum(pairs[2 * a + b] for a, b in zip(labels, labels[1:])))
        total += weight
        good += weight * np.array(labels)
    assert np.allclose(quality_crf.forward_backward(odds, pairs), good / total)

    x, starts, label = rng.normal(size=(9, 3)), np.array([0, 5, 8]), np.array([1.0, 0.0, 1.0])
    theta = rng.normal(size=7)
    f = lambda t: quality_crf._objective(x, starts, label, t[:3], t[3:], 1e-3)
    slope = f(theta)[1]
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-6
        assert abs((f(theta + step)[0] - f(theta - step)[0]) / 2e-6 - slope[k]) < 1e-5


def test_quality_held_out_accuracy(spark, tmp_path):
    rnd = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        lines = []
        for _ in range(rnd.randrange(1, 8)):
            words = ["".join(rnd.choices("aeinrstlo", k=rnd.randrange(2, 8))) for _ in range(rnd.randrange(3, 15))]
            lines.append(" ".join(w.upper() + "!!" for w in words) if bad and rnd.random() < 0.8 else " ".join(words) + ".")
        if bad:
            lines.append("BUY NOW!! BUY NOW!!")
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    docs += [(9000, None), (9001, "\n \n"), (9002, "word. " * 40_000), (9003, "line\n" * 20_000), (9003, "x"), (None, "some text")]
    write(spark, tmp_path, docs, labels)
    got = quality_crf.op7_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_quality_scores_against_plain_python(spark):
    rnd = random.Random(3)
    docs = []
    for i in range(120):
        line = lambda: " ".join("".join(rnd.choices("aeinrst", k=rnd.randrange(2, 8))) for _ in range(rnd.randrange(1, 12)))
        docs.append((i, "\n".join(line().upper() + "!! #" if i % 3 == 0 else line() + "." for _ in range(rnd.randrange(1, 7)))))
    docs += [(200, None), (201, " \n"), (202, "\n".join(["line of text"] * 500))]
    labels = [(i, int(i % 3 > 0)) for i, _ in docs]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, _quality_x int")
    field = quality_crf.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    for r in quality_crf.score(d, field).collect():
        lines = [x for x in (r.text or "").split("\n") if x.split()]
        rows = [quality_crf.line_features(x.encode(), x.encode().split(), {y.encode() for y in lines[:k]}) for k, x in enumerate(lines)]
        none, n = [0.0] * quality_crf.N_LINE, len(rows)
        odds = [sum(a * b for a, b in zip(rows[k] + (rows[k - 1] if k else none) + (rows[k + 1] if k + 1 < n else none), field.weights)) for k in range(n)]
        emit, step = [(1.0, math.exp(o)) for o in odds], np.exp(field.pairs.reshape(2, 2))
        ahead, back = [], [(1.0, 1.0)]
        for k in range(n):
            now = [emit[k][y] * (sum(ahead[-1][x] * step[x][y] for x in (0, 1)) if k else 1) for y in (0, 1)]
            ahead.append([v / sum(now) for v in now])
        for k in range(n - 1, 0, -1):
            now = [sum(step[x][y] * emit[k][y] * back[0][y] for y in (0, 1)) for x in (0, 1)]
            back.insert(0, [v / sum(now) for v in now])
        good = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, back)] if n else []
        sizes = [sum(len(w.encode()) for w in x.split()) for x in lines]
        p = min(max(sum(g * s for g, s in zip(good, sizes)) / max(1, sum(sizes)), 1e-4), 1 - 1e-4)
        assert math.isclose(r.quality_score, 1 / (1 + math.exp(-field.intercept - field.slope * math.log(p / (1 - p)))), abs_tol=1e-6)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    field = quality_crf.fit(docs, spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    assert quality_crf.score(docs, field).count() == 2
    assert quality_crf.score(docs.limit(0), field).count() == 0
