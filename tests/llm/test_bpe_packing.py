import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.llm import bpe, packing

PIECES = ["a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "é", "ß", "1", "²", "!", "'s", "'LL", "<|endoftext|>", "😀", "漢字", "́", "\x00", "�"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(14))) for _ in range(1500)]
    return made + ["", "word " * 9000, "ab" * 3000, "=-" * 700, "x" * 255, "x" * 257]


def test_same_ids_and_text_as_the_library(library):
    own = bpe.Encoder(bpe.default_tokenizer())
    quick = packing._library(None)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert quick(t) == own.encode(t)
        assert own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("run", [" ", "\n", "\t ", "a", "word "])
def test_very_long_runs_in_both_encoders(library, run):
    text = "x" + run * (1_000_000 // len(run)) + "y"
    packed = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing._library(None)(text) == packed
    assert bpe.Encoder(bpe.default_tokenizer()).encode(text) == packed


def test_array_and_heap_merge_alike():
    own = bpe.Encoder(bpe.default_tokenizer())
    rnd = random.Random(2)
    for _ in range(200):
        word = "".join(rnd.choice("aeinrst é") for _ in range(rnd.randrange(2, 250))).encode()
        assert own.merged(word) == own.merged_long(word)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    own = bpe.Encoder(bpe.default_tokenizer())
    own.encode(" ".join(f"w{i}x" for i in range(100)))
    assert len(own) <= 10


def test_columns_with_nulls_and_clashing_names(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hello  world", "z"), (3, "hello  world", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = df.withColumn("packed", bpe.encode(F.col("text"))).withColumn("back", bpe.decode(F.col("packed")))
    got = [(r.doc_id, bytes(r.packed), r.back) for r in out.collect()]
    want = library.encode("hello  world", add_special_tokens=False).ids
    assert sorted(got) == sorted([(1, b"", ""), (2, b"", "")] + 2 * [(3, np.array(want, "<u4").tobytes(), "hello  world")])
    assert df.limit(0).select(bpe.encode(F.col("text"))).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_length_once(seed):
    rnd = random.Random(seed)
    counts = Counter(rnd.choice([1, 5, 40, 41, 100, 2048, 2047, 1024, rnd.randrange(1, 2049)]) for _ in range(3000))
    used, ranks = {}, Counter()
    for length, first, number, sequence, offset in packing.plan(counts):
        assert first == ranks[length]
        ranks[length] += number
        for k in range(number):
            used.setdefault(sequence + k, []).append((offset, length))
    assert ranks == counts
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= 1.02 * -(-sum(n * k for n, k in counts.items()) // 2048) + sum(k for n, k in counts.items() if n > 1900) * 0.1 + 2


def test_packed_documents(spark, library):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "sat", "zyx"]) for _ in range(rnd.choice([0, 3, 50, 900, 2047, 2048, 5000])))) for i in range(60)]
    rows += [(100, None), (100, None), (101, "the " * 300)] + [(200 + i, "same text here") for i in range(80)]
    got = packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [0, len(ids)] if len(ids) <= 2048 else [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(want) == sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    empty = packing.packed_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def test_roundtrip_query(spark, tmp_path, library):
    rows = [(1, "abc déf"), (2, None), (3, "<|endoftext|> x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op1_bpe_roundtrip(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
