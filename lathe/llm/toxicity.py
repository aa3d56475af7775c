"""Toxicity by class-conditional Kneser-Ney models of words (operator 3).

Each class has a model of words by three orders: the word itself, its stem (the first STEM characters) and,
lowest, all words. Counts are Kneser-Ney's: a word counts once for each different word it follows, so a
passage that is repeated within a text or over many copies is one piece of evidence. With D discounted,

    p(stem | class) = (max(n(stem) - D, 0) + freed(all) * shared(stem)) / n(all)
    p(word | class, stem) = (max(n(word) - D, 0) + freed(stem) * shared(word | stem)) / n(stem)

where n are the class's counts, freed(h) is what discounting takes from all that follows h in the class, and
shared are shares of distinct words over both classes: the backoff counts that rare expressions of either
class fall back on. A stem that one class never saw says nothing more; a word that neither saw is
as likely as what its stem (or, failing that, all words) leaves over.

A toxic text is ordinary language with some toxic expressions in it. So its words are drawn from the toxic
class with probability MIX and else as in ordinary texts, and a text's score compares the two log-likelihoods,
normalised for length: the mean of log(1 - MIX + MIX * p(word | toxic) / p(word | ordinary)) over its words.
A slope and an intercept, fitted on labelled rows that the counts haven't seen, turn it into a probability.

The model is a table of words and stems that grows with the corpus; nothing is left out of it. It is written as
sorted arrays to files in the shared folder, which workers map into memory: texts are scored where they are, each distinct word of
a chunk of texts is looked up once, and nothing is shuffled.

Fitting takes three quarters of the labelled rows for counts, and of the rest at most `max_calibration` rows.
Preceding words are told apart by 31-bit hashes, words and stems by 64-bit ones.

Edge cases: null text is the empty text, and a text without words has the mean 0; null labels and ids
don't count; without labels of both classes all scores are alike; rows with equal ids each get a row, equal
texts equal scores; extra columns stay, but for the names that begin with `toxicity_`.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import common
from lathe.llm.labelled import fold, logistic, with_labels
from lathe.llm.language_model import Files, _write, local_path

STEM = 6
DISCOUNT = 1.0
MIX = 0.003
#: Entries of the model that one file holds (16 bytes each).
ENTRIES = 1_000_000
MAX_CALIBRATION = 20_000
#: Characters of the texts that are scored together (a longer text goes by itself).
CHUNK_CHARS = 500_000
_WORDS = re.compile(r"[^\W_]+")
_FLUSH = 100_000
_KEYS_KEPT = 50_000


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


class _Hashes(dict):
    """A word's 64-bit hash, or its stem's, as Spark's xxhash64 gives them; starts anew when it holds many."""

    def __init__(self, name):
        self.name = name

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= _KEYS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(self.name(word).encode("utf-8"), 42)
        return value


_WORD_HASH = _Hashes(lambda w: w + ">")
_STEM_HASH = _Hashes(lambda w: "<" + w[:STEM])


def word_counts(labelled: DataFrame, text_col: str) -> DataFrame:
    """word, n0, n1: how many different words each word follows in the rows of either label (column label_)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()

        def flush() -> pa.RecordBatch:
            words, before = zip(*seen) if seen else ((), ())
            out = pa.record_batch([pa.array(words, pa.string()), pa.array(np.array(before, np.uint32).view(np.int32))], ["word", "before"])
            seen.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = words_of(text.as_py())
                if words:
                    # the last bit is the label, the others are the preceding word's
                    h = np.fromiter(map(_WORD_HASH.__getitem__, words), np.uint64, len(words)) >> np.uint64(32)
                    before = (np.r_[np.uint64(0), h[:-1]] & np.uint64(0xFFFFFFFE)) | np.uint64(label)
                    seen.update(zip(words, before.tolist()))
                if len(seen) > _FLUSH:
                    yield flush()
        _WORD_HASH.clear()  # workers live on for other stages
        yield flush()

    found = labelled.select(text_col, "label_").mapInArrow(pairs, "word string, before int").distinct()
    toxic = F.col("before").bitwiseAND(1)
    return found.groupBy("word").agg(F.sum(1 - toxic).alias("n0"), F.sum(toxic).alias("n1"))


def mixed(ratio: Column, mix: float = MIX) -> Column:
    """The log ratio of a word under a toxic text's mixture and ordinary language, from that of the classes."""
    return F.log1p(mix * F.expm1(F.least(ratio, F.lit(30.0))))


@dataclass
class Model:
    """nodes: key, delta of each stem and word: what it adds to `base` and, for words, to its stem."""

    nodes: DataFrame
    base: float
    folder: str  # of the nodes' files
    buckets: int
    slope: float = 0.0
    intercept: float = 0.0


def _ratio(toxic: Column, ordinary: Column) -> Column:
    """log(toxic / ordinary); 0 where either is nothing."""
    return F.when((toxic > 0) & (ordinary > 0), F.log(toxic / ordinary)).otherwise(F.lit(0.0))


def nodes(words: DataFrame, discount: float = DISCOUNT, mix: float = MIX) -> tuple[DataFrame, float]:
    """words: word, n0, n1 (read three times). Returns key, delta, n for each stem and word, and the value of unknown ones."""
    least = lambda c: F.least(F.col(c).cast("double"), F.lit(discount))
    over = lambda c: F.greatest(F.col(c) - discount, F.lit(0.0))
    stem = F.substring("word", 1, STEM)
    stems = words.groupBy(stem.alias("stem")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("types"), F.sum(least("n0")).alias("f0"), F.sum(least("n1")).alias("f1"))
    stems = common.durable(stems, "stems")
    top = stems.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("types").alias("types"), F.sum(least("n0")).alias("f0"), F.sum(least("n1")).alias("f1")).first()
    if not top["n0"] or not top["n1"]:
        return words.sparkSession.createDataFrame([], "key long, delta double, n long"), 0.0
    rest = math.log(top["f1"] / top["n1"] / (top["f0"] / top["n0"])) if top["f0"] and top["f1"] else 0.0
    base = math.log1p(mix * math.expm1(min(rest, 30.0)))
    share = F.col("types") / F.lit(float(top["types"]))
    p0, p1 = ((over(f"n{c}") + top[f"f{c}"] * share) / float(top[f"n{c}"]) for c in (0, 1))
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    left = F.when(both, _ratio(F.col("f1") / F.col("n1"), F.col("f0") / F.col("n0"))).otherwise(F.lit(0.0))
    stems = stems.withColumn("ratio", _ratio(p1, p0)).withColumn("stop", mixed(F.col("ratio") + left, mix))
    above = stems.select(F.col("stem").alias("_stem"), "ratio", "stop", "types", *(F.col(c).alias(f"s_{c}") for c in ("n0", "n1", "f0", "f1")))
    joined = words.join(above, stem == F.col("_stem"))
    q0, q1 = ((over(f"n{c}") + F.col(f"s_f{c}") / F.col("types")) / F.col(f"s_n{c}") for c in (0, 1))
    step = F.when((F.col("s_n0") > 0) & (F.col("s_n1") > 0), _ratio(q1, q0)).otherwise(F.lit(0.0))
    total = (F.col("n0") + F.col("n1")).alias("n")
    of_words = joined.select(F.xxhash64(F.concat("word", F.lit(">"))).alias("key"), (mixed(F.col("ratio") + step, mix) - F.col("stop")).alias("delta"), total)
    of_stems = stems.select(F.xxhash64(F.concat(F.lit("<"), "stem")).alias("key"), (F.col("stop") - base).alias("delta"), total)
    return of_words.unionByName(of_stems), base


def _files(table: DataFrame, entries: int) -> tuple[str, int]:
    """The nodes as files of about `entries` of them, sorted by key, in the shared folder: the folder as workers open it, and
    how many files there are."""
    spark = table.sparkSession
    uri, path = local_path(spark, None)
    os.makedirs(path, exist_ok=True)
    common._written.append((spark, uri))
    buckets = max(1, -(-table.count() // max(1, entries)))

    def write(key, group):
        keys, values = group.column("key").to_numpy().view(np.uint64), group.column("delta").to_numpy()
        order = np.argsort(keys)
        _write(f"{path}/nodes-{key[0].as_py()}", {"keys": keys[order], "deltas": values[order]})
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64())})

    bucket = F.expr(f"cast(shiftrightunsigned(key, 33) % {buckets} as bigint)")
    table.select(bucket.alias("bucket"), "key", "delta").groupBy("bucket").applyInArrow(write, "bucket long").agg(F.count("*")).first()
    return path, buckets


def _deltas(files: Files, buckets: int, keys: np.ndarray) -> np.ndarray:
    """What each key adds (nothing where the model doesn't know it). keys are distinct and in order."""
    out, place = np.zeros(len(keys)), ((keys >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    ordered = place[order]
    edges = [*np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]).tolist(), len(ordered)] if len(ordered) else []
    for a, b in zip(edges, edges[1:]):
        found = files(f"nodes-{ordered[a]}")
        if found and len(found["keys"]):
            asked = keys[order[a:b]]
            at = np.minimum(np.searchsorted(found["keys"], asked), len(found["keys"]) - 1)
            out[order[a:b]] = np.where(found["keys"][at] == asked, found["deltas"][at], 0.0)
    return out


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    chunk, chars = [], 0
    for text in texts:
        text = text.as_py() or ""
        if chunk and chars + len(text) > CHUNK_CHARS:
            yield chunk
            chunk, chars = [], 0
        chunk.append(text)
        chars += len(text)
    if chunk:
        yield chunk


def means(text: Column, model: Model) -> Column:
    """A text's mean log-likelihood ratio a word: workers look up the distinct words and stems of a chunk of texts
    in the model's mapped files."""
    folder, buckets, base = model.folder, model.buckets, model.base

    @F.arrow_udf("double")
    def mean(texts: pa.Array) -> pa.Array:
        files, out = Files(folder, 64), []
        for chunk in _chunks(texts):
            words = [words_of(t) for t in chunk]
            sizes = np.array([len(w) for w in words], np.int64)
            of, total = np.repeat(np.arange(len(chunk)), sizes), sizes * base
            for hashes in (_WORD_HASH, _STEM_HASH):
                keys, back = np.unique(np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(sizes.sum())), return_inverse=True)
                total = total + np.bincount(of, _deltas(files, buckets, keys)[back], len(chunk))
            out.append(total / np.maximum(sizes, 1))
        _WORD_HASH.clear()  # workers live on for other stages
        _STEM_HASH.clear()
        return pa.array(np.concatenate([*out, np.zeros(0)]), pa.float64())

    return mean(text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", train=None, discount: float = DISCOUNT, mix: float = MIX, entries: int = ENTRIES, max_calibration: int = MAX_CALIBRATION) -> Model:
    """train: a condition on the rows to learn from (default: all). A quarter of these, by a hash of
    the id, calibrates; the others are counted."""
    rows = with_labels(docs.select(id_col, text_col), labels, id_col, label)
    if train is not None:
        rows = rows.where(train)
    part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(4))
    table, base = nodes(common.durable(word_counts(rows.where(part != 0), text_col), "words"), discount, mix)
    table = common.durable(table, "nodes")
    model = Model(table.select("key", "delta"), base, *_files(table, entries))
    share = min(1.0, max_calibration / max(1, rows.select(part.alias("p")).where("p = 0").count()))
    drawn = F.pmod(F.xxhash64(F.lit("calibrate"), F.col(id_col)), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = common.durable(rows.where(drawn & (part == 0)).select(F.col(text_col).alias("text"), "label_"), "calibration")
    kept = sample.select(means(F.col("text"), model).alias("mean"), "label_").toArrow()
    weights, model.intercept = logistic(kept.column("mean").to_numpy().reshape(-1, 1), kept.column("label_").to_numpy().astype(float), l2=1e-5)
    model.slope = float(weights[0])
    return model


def _judged(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    found = docs.withColumn("toxicity_mean", means(F.col(text_col), model))
    score = 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * F.col("toxicity_mean"))))
    return found.withColumn("toxicity_score", score).withColumn("toxicity_predicted", (F.col("toxicity_score") >= 0.5).cast("int"))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with toxicity_score (0 to 1) and toxicity_predicted (1 from 0.5 on)."""
    return _judged(docs, model, text_col).select(*docs.columns, "toxicity_score", "toxicity_predicted")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic."""
    return _judged(docs, model, text_col).where("toxicity_predicted = 0").select(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows whose crc32(doc_id) is divisible by 5 are held out of the fit."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs, common.table(spark, sf_dir, "labels"), train=~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxicity_predicted").alias("predicted"))
