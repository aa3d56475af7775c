"""The n-gram model against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import xxhash

from lathe.llm import language_model as L
from tests.oracle import DIR


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


class Plain:
    def __init__(self, texts, order):
        self.order = order
        seqs = [[" start", *words_of(t), " end"] for t in texts]
        self.tokens = Counter(w for s in seqs for w in s[1:])
        self.total, self.types = sum(self.tokens.values()), len(self.tokens)
        self.counts = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in seqs for i in range(max(1, order - 1), len(s)))}
        for k in range(order - 1, 0, -1):
            found = Counter(g[1:] for g in self.counts[k + 1])
            if k > 1:
                found.update(tuple(s[:k]) for s in seqs if len(s) >= k)
            self.counts[k] = found
        self.discounts, self.after = {}, {}
        for k, c in self.counts.items():
            self.discounts[k] = L.discounts_of(*(sum(n == j for n in c.values()) for j in (1, 2, 3, 4)))
            after = defaultdict(list)
            for g, n in c.items():
                after[g[:-1]].append(n)
            self.after[k] = after

    def p(self, context, w):
        k = len(context) + 1
        lower = self.p(context[1:], w) if context else 1 / (self.types + 1)
        after = self.after[k].get(tuple(context))
        if not after:
            return lower
        d = lambda n: self.discounts[k][min(n, 3) - 1] if n else 0.0
        n = self.counts[k].get((*context, w), 0)
        return (max(n - d(n), 0) + sum(d(m) for m in after) * lower) / sum(after)

    def score(self, text):
        seq = [" start", *words_of(text), " end"]
        model = sum(math.log10(self.p(seq[max(0, i - self.order + 1) : i], seq[i])) for i in range(1, len(seq)))
        base = sum(math.log10((self.tokens[w] + 0.1) / (self.total + 0.1 * (self.types + 1))) for w in seq[1:])
        return len(seq) - 1, sum(self.tokens[w] > 0 for w in seq[1:]), base, model


def some_texts(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a", "of", "É", "straße", "x" * 300, "cat", "sat", "on", "mat", "ran", "\x1c", " ", "end", "<s>"]
    out = [" ".join(rng.choices(vocabulary, [30, 5, 9, 8, 1, 1, 1, 5, 4, 3, 2, 2, 1, 1, 1, 1], k=rng.randrange(0, 30))) for _ in range(n)]
    return [*out, None, "", " \t\n\x0b\x0c\r", "  the  cat\nSAT ", "the " * 4000, "unknown words only", "the"]


@pytest.mark.parametrize(("order", "bucket"), [(2, 10**6), (2, 700), (3, 10**6), (3, 500), (4, 2000)])
def test_same_as_plain_python(spark, order, bucket, monkeypatch):
    texts = some_texts()
    train = [t for k, t in enumerate(texts) if k % 7]
    df = spark.createDataFrame([(k, t, 5, "y") for k, t in enumerate(texts)], "doc_id long, text string, score int, keys string").repartition(3)
    model = L.fit(df.where("doc_id % 7 != 0"), order=order, bucket=bucket)
    assert (model.buckets > 1) == (bucket < 10**6)
    if bucket < 1000:
        assert len(model.frequent[0])  # contexts are split
    plain = Plain(train, order)
    assert (model.token_count, model.token_types) == (plain.total, plain.types)
    for k, d in plain.discounts.items():
        assert model.discounts[k] == pytest.approx(d)
    got = {r["doc_id"]: r for r in L.score(df, model).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        n, known, base, score = plain.score(t)
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["keys"]) == (n, known, "y")
        assert got[k]["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert got[k]["score"] == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_probabilities_after_a_context_add_up_to_one():
    plain = Plain(some_texts(), 3)
    for context in ((" start",), ("the", "cat"), ("the", "nothing"), ("nothing",)):
        total = sum(plain.p(list(context), w) for w in plain.tokens) + plain.p(list(context), "never seen")
        assert total == pytest.approx(1)


def test_chunks_of_texts_dont_change_scores(spark, monkeypatch):
    texts = some_texts(9, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {r["doc_id"]: r["score"] for r in L.score(df, L.fit(df)).collect()}
    one = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(60)
    got = {r["doc_id"]: r["score"] for r in L.score(one, L.fit(one, bucket=300)).collect()}
    assert got == pytest.approx(want)


def test_tokens_of_slices():
    texts = pa.array([f"Word{k} ÄB\x0b c{'D' * k}" for k in range(200)])
    for a, n in ((0, 200), (37, 100), (199, 1), (200, 0)):
        seq, begins = L.tokens(texts.slice(a, n))
        want = [[xxhash.xxh64_intdigest(w.encode()) for w in words_of(t.as_py())] for t in texts.slice(a, n)]
        assert [seq[b + 1 : e - 1].tolist() for b, e in zip(begins, begins[1:])] == want


def test_no_rows_and_no_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = L.fit(none)
    assert L.score(none, model).count() == 0
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    for r in L.score(df, model).collect():
        assert r["n_known"] == 0 and r["score"] == 0 and r["base_score"] == pytest.approx(0)


def test_large_counts_are_kept_by_place(spark):
    df = spark.createDataFrame([(k, "a a b") for k in range(700)], "doc_id long, text string")
    plain = Plain(["a a b"] * 700, 2)
    row = L.score(df, L.fit(df)).first()
    assert row["base_score"] == pytest.approx(plain.score("a a b")[2])
    assert row["score"] == pytest.approx(plain.score("a a b")[3])


def test_query_against_plain_python_and_held_out_perplexity(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    held = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0}
    plain = Plain([r["text"] for r in rows if r["doc_id"] not in held], 2)
    got = {r["doc_id"]: r for r in L.op12_language_model(spark, DIR).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        n, known, base, score = plain.score(r["text"])
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (r["doc_id"] in held, n, known, plain.total)
        assert g["base_score"] == pytest.approx(base) and g["score"] == pytest.approx(score)
    tokens = sum(got[i]["n_tokens"] for i in held)
    assert sum(got[i]["score"] for i in held) / tokens > sum(got[i]["base_score"] for i in held) / tokens
