"""Scores by an interpolated modified Kneser-Ney n-gram model (operator 12), counted in Spark.

A text's tokens are its words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and one end; a start mark precedes them. The model
of order N estimates a token by its N-1 predecessors. With c the counts of a level, D the discount of a
count (by whether it is 1, 2 or more) and all sums over the tokens that follow a context h,

    p(w | h) = (max(c(hw) - D(c(hw)), 0) + (D1 n1(h) + D2 n2(h) + D3 n3+(h)) * p(w | shorter h)) / c(h)

where c are occurrences at the highest level, and below it how many different words stand before (occurrences
again for n-grams that begin with the start mark, as nothing stands before that). A context that was never seen passes on
p(w | shorter h); below single words lies 1 / (V + 1), for V different tokens and one for all that are unknown.
The three discounts of a level come from how many n-grams have the counts 1, 2, 3 and 4 (Chen and Goodman's
estimates); a level where one of the four is missing uses DEFAULT_DISCOUNTS.

Words and n-grams are 64-bit hashes. Tasks count the distinct n-grams of each chunk of texts and send them, packed, to
buckets by context; a context after which more than a bucket's worth of tokens follow (a frequent last word) is
split over buckets by the next word, and its sums are added up from parts. A bucket becomes one file in the
shared folder: a sorted array of hashes, the counts, and the contexts' sums. Workers map these files into memory and look up
sorted queries, so they hold a chunk of texts and whatever pages the system keeps. Nothing is pruned or capped: the
model grows with the corpus, in more files of equal size. A file is written under another name and renamed, so a
task that is repeated after a loss leaves the same file.

Defined results: null texts are empty; an empty text has one token, the end. Null ids belong to the training rows. Repeated
rows count each time. Columns of the input named as one of the results are replaced. Without training
tokens every token is unknown.
"""

from __future__ import annotations

import json
import math
import mmap
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm import common
from lathe.llm.common import durable, partitions, shared_dir, table
from lathe.llm.labelled import fold

ORDER = 2
#: Tokens of the training texts for each bucket, about.
BUCKET = 2_000_000
#: Bytes of text that a worker counts or scores at a time (at least one text).
CHUNK = 8_000_000
#: Fixed values where counts of counts leave a discount open.
DEFAULT_DISCOUNTS = (0.5, 1.0, 1.5)
SMOOTHING = 0.1

START = np.uint64(0x9E6C63D0876A9A47)
END = np.uint64(0xD1B54A32D192ED03)
SEED = np.uint64(0x2545F4914F6CDD1D)


# ---- hashes -----------------------------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context's hash and one more word."""
    return _mixed(context * np.uint64(0x9E3779B97F4A7C15) + word)


def _keys(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of n-grams and of their contexts, from a column of word hashes for each place."""
    key = np.full(len(columns[0]), SEED)
    for column in columns:
        context, key = key, _extended(key, column)
    return key, context


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _word_hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    one_by_one = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return one_by_one[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of start mark, words and end of each text, one after another, and where each text begins (and the last ends)."""
    own = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")  # ascii_lower misreads slices
    split = pc.ascii_split_whitespace(pc.ascii_lower(own))
    bounds = split.offsets.to_numpy()
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.r_[0, np.cumsum(full)]
    bounds = before[bounds - bounds[0]]
    places = np.arange(len(texts) + 1)
    begins = bounds + 2 * places
    out = np.empty(begins[-1], np.uint64)
    inner = np.ones(len(out), bool)
    out[begins[:-1]], out[begins[1:] - 1] = START, END
    inner[begins[:-1]] = inner[begins[1:] - 1] = False
    out[inner] = _word_hashes(words.filter(pa.array(full)))
    return out, begins


def _chunks(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have about CHUNK bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // CHUNK
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def _grams(seq: np.ndarray, begins: np.ndarray, size: int, order: int) -> list[np.ndarray]:
    """The columns of n-grams of a size: all of the order's own, or else those that begin with a start mark."""
    if size == order:
        place = np.arange(len(seq)) - np.repeat(begins[:-1], np.diff(begins))
        last = np.flatnonzero(place >= max(1, size - 1))
    else:
        last = begins[:-1] + size - 1
        last = last[last < begins[1:]]
    return [seq[last - (size - 1) + m] for m in range(size)]


# ---- packed n-grams that tasks exchange -------------------------------------------------------------------


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, a place of each, and the sums of values over equal ones."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), list(values)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[starts], order[starts], [np.add.reduceat(v[order], starts) for v in values]


def _least(values: np.ndarray) -> np.ndarray:
    """Counts as the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def _pack(columns: list[np.ndarray], *counts: np.ndarray) -> bytes:
    """Columns of hashes as their distinct values and places, with byte planes apart, and counts; compressed."""
    parts: list[bytes] = []
    for column in columns:
        distinct, place = np.unique(column, return_inverse=True)
        steps = np.diff(distinct, prepend=np.uint64(0))
        place = _least(place)
        parts += [steps.view(np.uint8).reshape(-1, 8).T.tobytes(), place.dtype.str.encode(), place.tobytes()]
    for c in map(_least, counts):
        parts += [c.dtype.str.encode(), c.tobytes()]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(blob: bytes, columns: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    at, parts = 8 * (n + 1), []
    for s in sizes.tolist():
        parts.append(data[at : at + s])
        at += s
    cols = []
    for k in range(columns):
        planes, kind, place = parts[3 * k : 3 * k + 3]
        distinct = np.cumsum(np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel())
        cols.append(distinct[np.frombuffer(place, kind.decode())])
    rest = parts[3 * columns :]
    return cols, [np.frombuffer(rest[k + 1], rest[k].decode()).astype(np.int64) for k in range(0, len(rest), 2)]


def _joined(blobs: Iterable[bytes], columns: int, counts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    got = [_unpack(b, columns) for b in blobs]
    cat = lambda arrays, kind: np.concatenate([*arrays, np.zeros(0, kind)])
    return [cat([g[0][k] for g in got], np.uint64) for k in range(columns)], [cat([g[1][k] for g in got], np.int64) for k in range(counts)]


_ROW = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("blob", pa.binary()), ("facts", pa.list_(pa.int64()))])
_ROW_DDL = "kind string, bucket long, blob binary, facts array<long>"


def _rows(kind: str, buckets: np.ndarray, columns: list[np.ndarray], *counts: np.ndarray) -> list[tuple]:
    """A row for each bucket with its packed n-grams."""
    order = np.argsort(buckets, kind="stable")
    ordered = buckets[order]
    edges = [*np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]).tolist(), len(ordered)] if len(ordered) else []
    return [(kind, int(ordered[a]), _pack([c[order[a:b]] for c in columns], *(c[order[a:b]] for c in counts)), []) for a, b in zip(edges, edges[1:])]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROW)], schema=_ROW)


# ---- the model and its files ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """folder: where workers open the files. frequent: hashes (in order) and numbers of buckets of the words
    after which contexts are split. discounts: by level, for counts of 1, 2 and more. token_count, token_types: of the
    training tokens. lowest: of all words, the sum and the numbers of n-grams by count 1, 2 and more."""

    folder: str
    order: int
    buckets: int
    frequent: tuple[np.ndarray, np.ndarray]
    token_count: int
    token_types: int
    discounts: dict[int, tuple[float, float, float]]
    lowest: tuple[int, int, int, int]


def _write(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another behind a head that names them. The file appears whole or not at all."""
    at, spec = 0, {}
    for name, a in arrays.items():
        spec[name] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(spec).encode()
    head += b" " * (-len(head) % 8)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(own, path)


class Files:
    """Mapped files, the latest `most` of them; a file that isn't there has no entries."""

    def __init__(self, folder: str, most: int = 512):
        self.folder, self.most, self.open = folder, most, OrderedDict()

    def __call__(self, name: str) -> dict[str, np.ndarray]:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        path, out = f"{self.folder}/{name}", {}
        if os.path.exists(path):
            with open(path, "rb") as f:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            size = int.from_bytes(data[:8], "little")
            for k, (kind, at, n) in json.loads(data[8 : 8 + size]).items():
                out[k] = np.frombuffer(data, kind, n, 8 + size + at)
        self.open[name] = out
        while len(self.open) > self.most:
            self.open.popitem(last=False)
        return out


def _byte_counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, those of 255 and more by their places."""
    large = np.flatnonzero(counts >= 255)
    return {"n": np.minimum(counts, 255).astype(np.uint8), "at": _least(large), "large": _least(counts[large])}


def _looked_up(f: dict[str, np.ndarray], keys: np.ndarray, names: tuple[str, ...], values: list[np.ndarray], out: list[np.ndarray], rows: np.ndarray) -> None:
    found = f[names[0]]
    if not len(found):
        return
    at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    hit = np.flatnonzero(found[at] == keys)
    for v, o in zip(values, out):
        o[rows[hit]] = v[at[hit]]


def _counts(files: Files, kind: str, buckets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The counts of keys, which lie in the files `kind`-bucket; 0 for those that aren't there."""
    out = np.zeros(len(keys), np.int64)
    order = np.lexsort((keys, buckets))
    ordered = buckets[order]
    edges = [*np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]).tolist(), len(ordered)] if len(ordered) else []
    for a, b in zip(edges, edges[1:]):
        f = files(f"{kind}-{ordered[a]}")
        if not f or not len(f["keys"]):
            continue
        q = keys[order[a:b]]
        at = np.minimum(np.searchsorted(f["keys"], q), len(f["keys"]) - 1)
        hit = f["keys"][at] == q
        n = f["n"][at].astype(np.int64)
        large = hit & (n == 255)
        if large.any():
            n[large] = f["large"][np.searchsorted(f["at"], at[large])]
        out[order[a:b]] = np.where(hit, n, 0)
    return out


def _sums(files: Files, kind: str, buckets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The four sums of contexts (all, n-grams with counts 1, 2 and more) in a row each; zeros for contexts never seen."""
    out = np.zeros((4, len(keys)), np.int64)
    order = np.lexsort((keys, buckets))
    ordered = buckets[order]
    edges = [*np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]).tolist(), len(ordered)] if len(ordered) else []
    for a, b in zip(edges, edges[1:]):
        f = files(f"{kind}-{ordered[a]}")
        if f and len(f["contexts"]):
            rows = order[a:b]
            _looked_up(f, keys[rows], ("contexts",), [f["all"], f["ones"], f["twos"], f["more"]], list(out), rows)
    return out


def _ways(frequent: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> np.ndarray:
    """Over how many buckets a context that ends with a word is split."""
    hashes, ways = frequent
    if not len(hashes):
        return np.ones(len(words), np.int64)
    at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
    return np.where(hashes[at] == words, ways[at], 1)


def _places(columns: list[np.ndarray], keys: np.ndarray, contexts: np.ndarray, frequent, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of n-grams, and whether their context is split. A single word's context is empty: it goes by itself."""
    if len(columns) == 1:
        return _bucket(keys, buckets), np.ones(len(keys), bool)
    ways = _ways(frequent, columns[-2])
    salt = np.where(ways > 1, (columns[-1] >> np.uint64(20)) % ways.astype(np.uint64), np.uint64(0)).astype(np.uint64)
    return _bucket(np.where(ways > 1, _extended(contexts, salt), contexts), buckets), ways > 1


def local_path(spark: SparkSession, folder: str | None) -> tuple[str, str]:
    """A new folder as Spark and as workers name it. Workers map files, so it must be a mounted one."""
    base = (folder or shared_dir(spark)).rstrip("/")
    found = urlparse(base)
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if found.scheme not in ("", "file") or (not found.scheme and not default.startswith("file:")):
        raise ValueError(f"workers map the model's files: give a mounted shared folder (folder=), not {base}")
    name = f"corpus-language-model-{uuid.uuid4().hex}"
    return f"{base}/{name}", f"{found.path}/{name}"


# ---- counting ---------------------------------------------------------------------------------------------


def fit(docs: DataFrame, *, order: int = ORDER, text_col: str = "text", bucket: int = BUCKET, folder: str | None = None) -> Model:
    """The model of all of docs' texts. folder: a mounted folder that all machines share, where spark.checkpoint.dir isn't one."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    uri, path = local_path(spark, folder)
    os.makedirs(path, exist_ok=True)
    common._written.append((spark, uri))
    texts = docs.select(F.col(text_col).alias("text"))

    def count_words(batches):
        for chunk in _chunks(batches, "text"):
            seq, begins = tokens(chunk.column("text"))
            keep = np.ones(len(seq), bool)
            keep[begins[:-1]] = False
            words, n = np.unique(seq[keep], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    words = durable(texts.mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, types = words.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    buckets = max(1, -(-total // bucket))
    limit = max(bucket, total // 10_000)  # so at most 10,000 words come to the driver
    rows = words.where(F.col("n") > limit).collect()
    rows = [(np.int64(r["word"]).view(np.uint64), min(buckets, -(-r["n"] // limit))) for r in rows]
    starts = docs.count()  # as often as a start mark precedes a first word
    if starts > limit:
        rows.append((START, min(buckets, -(-starts // limit))))
    rows.sort()
    frequent = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)

    def write_words(key, group):
        keys = group.column("word").to_numpy().view(np.uint64)
        by = np.argsort(keys)
        _write(f"{path}/words-{key[0].as_py()}", {"keys": keys[by], **_byte_counts(group.column("n").to_numpy()[by])})
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64())})

    bucket_of_word = F.expr(f"cast(shiftrightunsigned(word, 33) % {buckets} as bigint)")
    words.groupBy(bucket_of_word.alias("bucket")).applyInArrow(write_words, "bucket long").agg(F.count("*")).first()

    def counter(size: int):
        def count(batches):
            for chunk in _chunks(batches, "text"):
                columns = _grams(*tokens(chunk.column("text")), size, order)
                keys, _ = _keys(columns)
                _, at, (n,) = _summed(keys, np.ones(len(keys), np.int64))
                columns = [c[at] for c in columns]
                place, _ = _places(columns, *_keys(columns), frequent, buckets)
                if found := _rows("grams", place, columns, n):
                    yield _batch(found)

        return count

    def merger(size: int):
        def merge(key, group):
            b = key[0].as_py()
            columns, (n,) = _joined(group.column("blob").to_pylist(), size, 1)
            keys, at, (n,) = _summed(_keys(columns)[0], n)
            columns = [c[at] for c in columns]
            _, contexts = _keys(columns)
            _, split = _places(columns, keys, contexts, frequent, buckets)
            arrays = {"keys": keys, **_byte_counts(n)}
            facts = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int(n.sum()), int((n > 2).sum())]
            out = [("facts", b, b"", facts)]
            if size > 1:
                parts = [n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64)]
                whole, _, sums = _summed(contexts[~split], *(p[~split] for p in parts))
                arrays |= {"contexts": whole, **dict(zip(("all", "ones", "twos", "more"), map(_least, sums)))}
                some, _, sums = _summed(contexts[split], *(p[split] for p in parts))
                out += _rows("contexts", _bucket(some, buckets), [some], *sums)
                shorter = columns[1:]
                lower, at, (before,) = _summed(_keys(shorter)[0], np.ones(len(keys), np.int64))
                shorter = [c[at] for c in shorter]
                place, _ = _places(shorter, *_keys(shorter), frequent, buckets)
                out += _rows("grams", place, shorter, before)
            _write(f"{path}/grams{size}-{b}", arrays)
            return pa.Table.from_batches([_batch(out)])

        return merge

    def write_contexts(size: int):
        def write(key, group):
            (contexts,), sums = _joined(group.column("blob").to_pylist(), 1, 4)
            contexts, _, sums = _summed(contexts, *sums)
            _write(f"{path}/split{size}-{key[0].as_py()}", {"contexts": contexts, **dict(zip(("all", "ones", "twos", "more"), map(_least, sums)))})
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64())})

        return write

    discounts, lowest, higher = {}, (0, 0, 0, 0), None
    for size in range(order, 0, -1):
        grams = None
        if size == order or size > 1:
            grams = texts.mapInArrow(counter(size), _ROW_DDL)
        if higher is not None:
            more = higher.where("kind = 'grams'")
            grams = more if grams is None else grams.unionByName(more)
        merged = durable(grams.groupBy("bucket").applyInArrow(merger(size), _ROW_DDL), f"grams{size}")
        facts = merged.where("kind = 'facts'").agg(*(F.coalesce(F.sum(F.col("facts")[k]), F.lit(0)) for k in range(6))).first()
        discounts[size] = discounts_of(*facts[:4])
        if size > 1:
            merged.where("kind = 'contexts'").groupBy("bucket").applyInArrow(write_contexts(size), "bucket long").agg(F.count("*")).first()
        else:
            lowest = (facts[4], facts[0], facts[1], facts[5])
        higher = merged
    return Model(path, order, buckets, frequent, total, types, discounts, lowest)


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts of counts 1, 2 and more, kept within 0 and the count."""
    if not (n1 and n2 and n3 and n4):
        return DEFAULT_DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


# ---- scoring ----------------------------------------------------------------------------------------------


def _log10_probabilities(model: Model, files: Files, seq: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of each token (start marks have none)."""
    place = np.arange(len(seq)) - np.repeat(begins[:-1], np.diff(begins))
    at = np.flatnonzero(place > 0)
    place = place[at]
    unknown = 1.0 / (model.token_types + 1)
    p = np.full(len(at), unknown)
    for size in range(1, model.order + 1):
        can = np.flatnonzero(place >= size - 1)
        ends = at[can]
        columns = [seq[ends - (size - 1) + m] for m in range(size)]
        _, first, back = np.unique(_keys(columns)[0], return_index=True, return_inverse=True)
        columns = [c[first] for c in columns]
        keys, contexts = _keys(columns)
        where, split = _places(columns, keys, contexts, model.frequent, model.buckets)
        n = _counts(files, f"grams{size}", where, keys)
        if size == 1:
            sums = np.repeat(np.array(model.lowest, np.int64)[:, None], len(keys), 1)
        else:
            sums = np.zeros((4, len(keys)), np.int64)
            for rows, kind, buckets in ((np.flatnonzero(~split), "grams", where), (np.flatnonzero(split), "split", _bucket(contexts, model.buckets))):
                distinct, one, many = np.unique(contexts[rows], return_index=True, return_inverse=True)
                sums[:, rows] = _sums(files, f"{kind}{size}", buckets[rows][one], distinct)[:, many]
        d1, d2, d3 = model.discounts[size]
        kept = n - np.select([n <= 0, n == 1, n == 2], [0.0, d1, d2], d3)
        left = d1 * sums[1] + d2 * sums[2] + d3 * sums[3]
        seen = sums[0] > 0
        total = np.where(seen, sums[0], 1)
        own, passed = np.where(seen, kept / total, 0.0)[back], np.where(seen, left / total, 1.0)[back]
        p[can] = own + passed * p[can]
    return np.log10(p)


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, n_known (tokens that training texts have), base_score (log10 of smoothed
    frequencies, summed) and score (log10 of the model's probability of the text)."""
    results = ("n_tokens", "n_known", "base_score", "score")
    kept = docs.drop(*(c for c in results if c != text_col))

    def scored(batches):
        files = Files(model.folder)
        below = math.log10(model.token_count + SMOOTHING * (model.token_types + 1))
        for chunk in _chunks(batches, text_col):
            seq, begins = tokens(chunk.column(text_col))
            inner = np.ones(len(seq), bool)
            inner[begins[:-1]] = False
            words, back = np.unique(seq[inner], return_inverse=True)
            key = _bucket(words, model.buckets)
            c = _counts(files, "words", key, words)
            edges = begins[:-1] - np.arange(len(begins) - 1)
            add = lambda v: np.add.reduceat(v, edges)
            found = [np.diff(begins) - 1, add((c > 0).astype(np.int64)[back]), add((np.log10(c + SMOOTHING) - below)[back]), add(_log10_probabilities(model, files, seq, begins))]
            columns = {n: chunk.column(n) for n in chunk.schema.names}
            columns |= {"n_tokens": pa.array(found[0], pa.int64()), "n_known": pa.array(found[1], pa.int64()), "base_score": pa.array(found[2], pa.float64()), "score": pa.array(found[3], pa.float64())}
            yield pa.RecordBatch.from_pydict(columns)

    schema = T.StructType([*kept.schema.fields])
    for name in results:
        schema = schema.add(name, "long" if name.startswith("n_") else "double")
    return kept.mapInArrow(scored, schema)


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows whose crc32(doc_id) is divisible by 10 are held out of the counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), 10) == 0, F.lit(False))
    model = fit(docs.where(~held))
    scored = score(docs.withColumn("held_out", held), model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.token_count).cast("long").alias("train_tokens"), "base_score", "score", perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"))
