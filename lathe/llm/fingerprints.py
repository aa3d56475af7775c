"""Document fingerprints: weighted SimHash and a Hamming search over permuted block tables (operator 2).

Fingerprint: terms are shingles of three words (fewer words: all of them); a term that occurs n times
weighs 1 + ln n; each term's 128-bit hash votes for and against every bit with its weight, and a bit
is set if the votes for it exceed half of the weight. Texts without words have fingerprint zero.

Search: the bits are cut into blocks, and for each block there is a table of the fingerprints with that block
moved to the front, as the key of an equi-join. A query looks up its own block and all blocks that differ from
it in at most FLIPS bits. With more than radius / (FLIPS + 1) blocks, two fingerprints at most `radius`
bits apart differ in at most FLIPS bits of some block, so all are found. A pair that meets in several tables
counts in the first of them only, and is verified by its distance. Equal fingerprints are one entry of the
tables with a count, so copies make no pairs. Blocks that very many fingerprints share are cut into slices,
to each of which their queries go; matches are counted in the tasks, so no pair becomes a row.

Edge cases: null text is the empty text; rows with equal ids are ordered by a hash of their texts;
null ids come last; with one row, it is its own next document; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm import common

BITS = 128
WORDS = BITS // 64
SHINGLE = 3
RADIUS = 17
FLIPS = 2
#: Entries of one block's key that a task gets, at least, before the key is cut into slices; entries of a bucket, about.
SLICE = 20_000
BUCKET = 1_000_000
_PAIRS = 2_000_000
_WORDS_KEPT = 100_000


class _WordHash(dict):
    """Word to a 64-bit hash; starts anew when it holds many words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


WORD_HASH = _WordHash()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weighted_simhash(text: str, shingle: int = SHINGLE) -> bytes:
    """The 16 bytes of a text's fingerprint."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return bytes(BITS // 8)
    h = np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))
    if len(h) <= shingle:
        terms = np.zeros(1, np.uint64)
        for x in h:
            terms = mixed(terms * np.uint64(3) + x)
    else:
        terms = np.zeros(len(h) - shingle + 1, np.uint64)
        for k in range(shingle):
            terms = mixed(terms * np.uint64(3) + h[k : len(h) - shingle + 1 + k])
    terms, times = np.unique(terms, return_counts=True)
    votes = np.zeros(BITS)
    for at in range(0, len(terms), 1 << 14):
        votes += _bits(terms[at : at + (1 << 14)]).sum(axis=0, dtype=np.int64)
    often = times > 1
    if often.any():
        votes += np.log(times[often]) @ _bits(terms[often])
    half = (len(terms) + np.log(times[often]).sum()) / 2
    return np.packbits(votes > half).tobytes()


def _bits(terms: np.ndarray) -> np.ndarray:
    both = np.stack([terms, mixed(terms + np.uint64(0x9E3779B97F4A7C15))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of each whole text, binary of 16 bytes."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([weighted_simhash(t.as_py() or "", shingle) for t in texts], pa.binary())

    return of(text)


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints in hexadecimal digits."""
    parts = [F.bit_count(_word(a, k).bitwiseXOR(_word(b, k))) for k in range(WORDS)]
    return sum(parts[1:], parts[0])


def _word(digits: Column, k: int) -> Column:
    """64 bits of hexadecimal digits as a long that holds the same bits."""
    high, low = (F.conv(F.substring(digits, at, 8), 16, 10).cast("long") for at in (16 * k + 1, 16 * k + 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits, 0 to 1."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def _blocks(radius: int, flips: int) -> list[list[int]]:
    """Masks of the blocks, a signed long for each word."""
    out = []
    for block in np.array_split(np.arange(BITS), radius // (flips + 1) + 1):
        words = [sum(1 << (63 - (int(b) - 64 * k)) for b in block if 64 * k <= b < 64 * k + 64) for k in range(WORDS)]
        out.append([m - (1 << 64) if m >> 63 else m for m in words])
    return out


def _flipped(mask: list[int], flips: int) -> list[list[int]]:
    """All ways to flip at most `flips` bits of a block, a signed long for each word."""
    bits = [(k, b) for k in range(WORDS) for b in range(64) if mask[k] >> b & 1]
    out = []
    for chosen in (c for n in range(flips + 1) for c in combinations(bits, n)):
        words = [sum(1 << b for j, b in chosen if j == k) for k in range(WORDS)]
        out.append([m - (1 << 64) if m >> 63 else m for m in words])
    return out


def within(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, flips: int = FLIPS) -> DataFrame:
    """fps: fp (hexadecimal digits) and, optionally, id (long). queries: fp. Returns fp, n_near, n_near_rows,
    near_bits, near_id for each distinct query: how many other distinct fingerprints of fps are within
    `radius`, their rows, and the distance and least id of the nearest (null where there is none)."""
    spark, blocks = fps.sparkSession, _blocks(radius, flips)
    words = [f"w{k}" for k in range(WORDS)]
    tag = F.min("id") if "id" in fps.columns else F.lit(None).cast("long")
    entries = fps.groupBy("fp").agg(F.count("*").alias("copies"), tag.alias("id"))
    asked = queries.select("fp").distinct()
    of = lambda df, *more: df.select(*(_word(F.col("fp"), k).alias(w) for k, w in enumerate(words)), *more)

    masks = np.array(blocks, np.int64).view(np.uint64)
    flipped = [np.array(_flipped(block, flips), np.int64).view(np.uint64) for block in blocks]

    def keyed(df: DataFrame, ways: list[np.ndarray]) -> DataFrame:
        """df's rows for each table and each way to flip bits of its block, with the key of the block."""
        names = [*df.columns, "t", "key"]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    own = np.stack([part.column(w).to_numpy(zero_copy_only=False) for w in words]).view(np.uint64)
                    for t, flips_ in enumerate(ways):
                        key = np.full((len(flips_), part.num_rows), t + 1, np.uint64)
                        for k in range(WORDS):
                            key = mixed(key * np.uint64(3) + ((own[k][None] ^ flips_[:, k : k + 1]) & masks[t][k]))
                        again = pa.array(np.tile(np.arange(part.num_rows), len(flips_)))
                        columns = [c.take(again) for c in part.columns] + [pa.array(np.full(key.size, t, np.int32)), pa.array(key.view(np.int64).ravel())]
                        yield pa.record_batch(columns, names)

        return df.mapInArrow(rows, T.StructType([*df.schema.fields, T.StructField("t", T.IntegerType()), T.StructField("key", T.LongType())]))

    tables = keyed(of(entries, "copies", "id"), [np.zeros((1, WORDS), np.uint64)] * len(blocks))
    probes = keyed(of(asked), flipped)
    n = entries.count() * len(blocks)
    limit = max(SLICE, n // (8 * common.partitions(spark)))
    hot = tables.groupBy(F.col("key").alias("_hot")).agg(F.ceil(F.count("*") / limit).cast("int").alias("_ways")).where("_ways > 1")
    ways = F.coalesce("_ways", F.lit(1))
    tables = tables.join(F.broadcast(hot), F.col("key") == F.col("_hot"), "left").withColumn("slice", F.pmod(F.xxhash64(*words), ways))
    probes = probes.join(F.broadcast(hot), F.col("key") == F.col("_hot"), "left").withColumn("slice", F.explode(F.sequence(F.lit(0), ways - 1)))
    buckets = max(common.partitions(spark), n // BUCKET + 1)
    placed = lambda df, *cols: df.withColumn("key", F.xxhash64("key", F.col("slice").cast("long"))).select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key", "t", *words, *cols)
    schema = ", ".join(f"{w} long" for w in words) + ", n long, copies long, bits int, id long"
    met = placed(probes).groupBy("bucket").cogroup(placed(tables, "copies", "id").groupBy("bucket")).applyInArrow(lambda a, b: _matches(a, b, blocks, radius, flips), schema)
    nearest = F.min(F.struct("bits", "id"))
    near = met.groupBy(*words).agg(F.sum("n").alias("n_near"), F.sum("copies").alias("n_near_rows"), nearest.alias("nearest"))
    zero = F.lit(0).cast("long")
    own = of(asked, "fp").join(near, words, "left")
    return own.select("fp", F.coalesce("n_near", zero).alias("n_near"), F.coalesce("n_near_rows", zero).alias("n_near_rows"), F.col("nearest.bits").alias("near_bits"), F.col("nearest.id").alias("near_id"))


def _matches(probes: pa.Table, tables: pa.Table, blocks: list[list[int]], radius: int, flips: int) -> pa.Table:
    """For each query of a bucket that has a match there: how many, and the nearest."""
    words = [f"w{k}" for k in range(WORDS)]
    columns = lambda t, names: [t.column(c).to_numpy(zero_copy_only=False) for c in names]
    key, *own = columns(tables, ["key", *words])
    copies, ids = tables.column("copies").to_numpy(), tables.column("id").to_pylist()
    order = np.argsort(key, kind="stable")
    key, own, copies = key[order], [w[order] for w in own], copies[order]
    ids = np.array([np.iinfo(np.int64).max if ids[k] is None else ids[k] for k in order], np.int64)
    asked, table, *query = columns(probes, ["key", "t", *words])
    low, high = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
    hit = np.flatnonzero(high > low)
    masks = np.array(blocks, np.int64)
    found = []
    while len(hit):
        take = max(1, int(np.searchsorted(np.cumsum((high - low)[hit]), _PAIRS, "right")))
        part, hit = hit[:take], hit[take:]
        size = (high - low)[part]
        at = np.repeat(low[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
        who = np.repeat(part, size)
        apart = [q[who] ^ w[at] for q, w in zip(query, own)]
        bits = sum(np.bitwise_count(x.view(np.uint64)).astype(np.int32) for x in apart)
        ok = (bits > 0) & (bits <= radius)
        who, at, bits, apart = who[ok], at[ok], bits[ok], [x[ok] for x in apart]
        first = np.ones(len(who), bool)
        for t in range(len(blocks)):
            differ = sum(np.bitwise_count((x & masks[t][k]).view(np.uint64)).astype(np.int32) for k, x in enumerate(apart))
            first &= ~((differ <= flips) & (t < table[who]))
        who, at, bits = who[first], at[first], bits[first]
        found.append(np.stack([*(q[who] for q in query), copies[at], bits, ids[at]], axis=1))
    rows = np.concatenate(found) if found else np.empty((0, WORDS + 3), np.int64)
    rows = rows[np.lexsort(tuple(rows[:, k] for k in (WORDS + 2, WORDS + 1, *range(WORDS))))]
    starts = np.flatnonzero(np.r_[True, (np.diff(rows[:, :WORDS], axis=0) != 0).any(axis=1)]) if len(rows) else np.empty(0, np.int64)
    out = {w: rows[starts, k] for k, w in enumerate(words)}
    out["n"] = np.diff(np.r_[starts, len(rows)])
    out["copies"] = np.add.reduceat(rows[:, WORDS], starts) if len(starts) else np.empty(0, np.int64)
    out["bits"] = rows[starts, WORDS + 1].astype(np.int32)
    out["id"] = pa.array(rows[starts, WORDS + 2], mask=rows[starts, WORDS + 2] == np.iinfo(np.int64).max)
    return pa.table({k: pa.array(v) for k, v in out.items()})


def with_next(docs: DataFrame, id_col: str, tie_on: str, derive: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """id_col, and derive's columns with `next_<name>`: their values in the next row by descending id
    (after the last row: the first). Rows go to buckets of neighbouring ids, and each bucket also gets the
    first row of the next one, so that no task sees more than its bucket. Only derive's columns, worked
    out once a row, are moved. Rows with equal ids are ordered by a hash of the column tie_on."""
    spark = docs.sparkSession
    n = buckets or 4 * max(1, common.partitions(spark))  # several to a partition even out
    bounds = sorted(set(docs.select(F.col(id_col).cast("double").alias("i")).approxQuantile("i", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    keyed = docs.withColumn("_bucket", -_position(F.col(id_col).cast("double"), bounds)).withColumn("_tie", F.xxhash64(tie_on))
    top = F.max(F.struct(F.col(id_col).isNotNull().alias("there"), F.col(id_col).alias("id"), F.col("_tie").alias("tie")))
    heads = sorted((r["_bucket"], r["top"]["id"], r["top"]["tie"]) for r in keyed.groupBy("_bucket").agg(top.alias("top")).collect())
    before = {b: heads[k - 1][0] for k, (b, _, _) in enumerate(heads)}
    marks = spark.createDataFrame([(b, i, t, before[b]) for b, i, t in heads], f"_b long, _i {docs.schema[id_col].dataType.simpleString()}, _t long, _goes long")
    head = keyed.join(F.broadcast(marks), (F.col("_bucket") == F.col("_b")) & F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_tie") == F.col("_t")))
    head = head.dropDuplicates(["_bucket"]).withColumn("_bucket", F.col("_goes")).drop("_b", "_i", "_t", "_goes").withColumn("_guest", F.lit(True))
    rows = keyed.withColumn("_guest", F.lit(False)).unionByName(head).withColumns(derive).select(id_col, *derive, "_bucket", "_tie", "_guest")
    order = Window.partitionBy("_bucket").orderBy(F.col("_guest"), F.col(id_col).desc_nulls_last(), F.col("_tie").desc())
    out = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in derive))
    return out.where(~F.col("_guest")).drop("_bucket", "_tie", "_guest")


def _position(x: Column, bounds: list[float]) -> Column:
    """How many bounds are below x (0 for null): looked up in about the root of their number of steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda row: F.size(F.filter(row, lambda b: b < x))
    coarse = below(F.array(*(F.lit(r[-1]) for r in rows)))
    fine = F.array(*(F.array(*map(F.lit, r)) for r in rows), F.array().cast("array<double>"))
    return F.coalesce(coarse * step + below(F.element_at(fine, coarse + 1)), F.lit(0)).cast("long")


def packed(text: Column, shingle: int = SHINGLE) -> Column:
    """struct<fp, packed>: a text's fingerprint, and the text compressed (texts travel so when their
    documents are shuffled, in about two thirds of what Spark's own compression takes)."""

    @F.arrow_udf("fp binary, packed binary")
    def of(texts: pa.Array) -> pa.Array:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        plain = [t.as_py() or "" for t in texts]
        fps = [weighted_simhash(t, shingle) for t in plain]
        return pa.StructArray.from_arrays([pa.array(fps, pa.binary()), pa.array([pack(t.encode("utf-8")) for t in plain], pa.binary())], ["fp", "packed"])

    return of(text)


def spliced(own: Column, following: Column, shingle: int = SHINGLE) -> Column:
    """struct<text, fp>: a packed text whose last third is replaced by the beginning of another (as many
    characters or all it has), and its fingerprint."""

    @F.arrow_udf("text string, fp binary")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress
        texts = []
        for x, y in zip(a, b):
            mine, other = plain(x.as_py()).decode("utf-8"), plain(y.as_py()).decode("utf-8")
            cut = len(mine) // 3
            texts.append(mine[: len(mine) - cut] + other[:cut])
        fps = [weighted_simhash(t, shingle) for t in texts]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(fps, pa.binary())], ["text", "fp"])

    return of(own, following)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and for ids divisible by 50 how many
    other fingerprints of the table are within RADIUS bits, and the distance and id of the nearest of them
    (n_near, near_bits, near_id; null for the rest)."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(docs, "doc_id", "text", {"n": F.length("text").cast("long"), "r": packed(F.col("text"))})
    both = both.select("doc_id", "n", F.col("r.fp").alias("fp"), F.col("next_r.fp").alias("next_fp"), spliced(F.col("r.packed"), F.col("next_r.packed")).alias("e"))
    edited = F.unhex(F.sha2(F.col("e.text").cast("binary"), 256))
    both = common.durable(both.select("doc_id", "n", "fp", "next_fp", edited.alias("sha"), F.col("e.fp").alias("edited_fp")), "edited")
    digits = lambda c: F.lower(F.hex(c))
    both = both.withColumns({c: digits(c) for c in ("fp", "next_fp", "edited_fp")})
    chosen = F.coalesce(F.pmod("doc_id", F.lit(50)) == 0, F.lit(False))
    asked = both.where(chosen)
    near = within(both.select("fp", F.col("doc_id").cast("long").alias("id")), asked.select("fp")).select(F.col("fp").alias("_fp"), "n_near", "near_bits", "near_id")
    none = {"n_near": F.lit(None).cast("long"), "near_bits": F.lit(None).cast("int"), "near_id": F.lit(None).cast("long")}
    found = asked.join(near, asked["fp"] == near["_fp"], "left").drop("_fp").unionByName(both.where(~chosen).withColumns(none))
    return found.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        digits("sha").alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
        "near_bits",
        "near_id",
    )
