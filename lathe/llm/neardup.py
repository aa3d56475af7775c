"""SimHash near-duplicate groups by meet-in-the-middle ball hashing (operator 5).

Fingerprint: ASCII letters lower-cased, words between ASCII white space, shingles of three words
(fewer words: all of them), XXH64 of each with seed 42; a bit is set if over half of the hashes set it.

Ball hashing: two fingerprints at most 3 bits apart meet at a third one between them. Flipping a bit
changes the parity of a fingerprint's number of ones, so it is enough that fingerprints of even
parity emit themselves and all variants with two bits flipped, those of odd parity all variants
with one bit flipped (a pair 3 apart has one of each parity; pairs 2 apart meet half way; pairs 1
apart at the even one). All variants have even parity and are shuffled on a hash of the variant.

The hash is linear over bits, so the variants of a fingerprint that fall into a bucket follow from
the fingerprint and the bucket: the shuffle carries the fingerprint once for each bucket that gets
some of its variants, and the bucket's task expands them. There are about four buckets to a core or,
when a bucket would get more than `per_bucket` fingerprints, as many more as that takes. A bucket's
variants are matched in slices by further bits of the hash, so memory is bounded too.

Where odd fingerprints share a variant, all fingerprints that meet there belong together, so each is
linked to one of them only; every link is verified by its distance, and of a bucket's links those
that close a circle are left out. Links become groups in `components`. Equal fingerprints are one
node throughout, so copies never make pairs.

Three of 64 bits are a strict radius. `deduplicate` therefore also finds texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more, verified on the whole sets (of 32-bit hashes, of which one
in some thousand falls on another in texts of a million shingles). Texts meet where the MinHashes of one of BANDS bands agree:
pairs of similarity 0.8 do in 99.8 of a hundred cases. No pair that meets is left out before it is verified,
unless verified links connect it already: each meeting is first checked against its least text; where that
leaves a meeting in several groups, every text outside the largest is checked against all others, in blocks
of bounded size, and only then links that close a circle are left out.

Edge cases: null text is the empty text; texts without words have fingerprint zero and link like any
other; rows with a null id get their group's id (null if no member has one); repeated rows each give
a row; extra columns are ignored by `near_duplicates` and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm import common
from lathe.llm.components import components

RADIUS = 3
SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 5
#: Shingles (4 bytes each) of either side that one block of a meeting compares, and that one task gets, about.
#: A text counts for OVERHEAD shingles more than it has.
BLOCK = 500_000
TASK_SHINGLES = 2_000_000
OVERHEAD = 64
#: Ids of dropped documents, up to this number (about 32 MB), are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Fingerprints that one bucket's task holds at most, about (8 bytes each).
PER_BUCKET = 4_000_000
#: Variants that one bucket's task matches at a time, about.
PER_SLICE = 4_000_000
_MAX_HASH_BITS = 30


def simhash(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint as an unsigned number."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: ASCII only, for both
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hash_of(b" ".join(words), 42)]
    else:
        hashes = [hash_of(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(shingle)))]
    votes, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of each whole text, as a signed long of the same bits."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_py() or "", shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Bit masks of the variants: none and two bits for even fingerprints, one bit for odd ones.
_EVEN = np.array([0] + [1 << a | 1 << b for a, b in combinations(range(64), 2)], dtype=np.uint64)
_ODD = np.array([1 << a for a in range(64)], dtype=np.uint64)


def _tables() -> np.ndarray:
    """For each of the 8 bytes of a fingerprint and each value: its part of the linear hash."""
    columns = np.random.default_rng(7).integers(0, 1 << _MAX_HASH_BITS, 64, dtype=np.uint64)
    out = np.zeros((8, 256), np.uint64)
    for byte in range(8):
        for bit in range(8):
            has = (np.arange(256) >> bit & 1).astype(bool)
            out[byte, has] ^= columns[8 * byte + bit]
    return out


_TABLES = _tables()


def _hash(x: np.ndarray) -> np.ndarray:
    parts = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(x), np.uint64)
    for byte in range(8):
        out ^= _TABLES[byte][parts[:, byte]]
    return out


def _odd(x: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(x) & 1).astype(bool)


def _emit(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(table, fingerprint) to (table, bucket, packed fingerprints with variants in that bucket)."""
    low = np.uint64((1 << bits) - 1)
    steps = {odd: np.unique(_hash(masks) & low) for odd, masks in ((False, _EVEN), (True, _ODD))}
    for batch in batches:
        tables, values = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for t in np.unique(tables).tolist():
            own = values[tables == t].view(np.uint64)
            for odd, deltas in steps.items():
                fps = own[_odd(own) == odd]
                home = _hash(fps) & low
                order = np.argsort(home, kind="stable")
                fps, home = fps[order], home[order]
                starts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if len(home) else []
                for a, b in zip(starts, [*starts[1:], len(home)]):
                    packed, buckets = fps[a:b].tobytes(), home[a] ^ deltas
                    for at in range(0, len(buckets), 512):
                        part = buckets[at : at + 512].astype(np.int64)
                        yield pa.record_batch([pa.array([t] * len(part), pa.int32()), pa.array(part), pa.array([packed] * len(part), pa.binary())], ["t", "bucket", "fps"])


def _links(table: pa.Table, bits: int, radius: int, per_slice: int) -> pa.Table:
    """The links that the variants of one bucket give, as few as keep its groups together."""
    fps = np.unique(np.frombuffer(b"".join(table.column("fps").to_pylist()), dtype=np.uint64))
    bucket = np.uint64(table.column("bucket")[0].as_py())
    more = 0
    while (len(_EVEN) * len(fps) >> (min(bits, 11) + more)) > per_slice and bits + more < _MAX_HASH_BITS:
        more += 1
    low = np.uint64((1 << (bits + more)) - 1)
    sides = {}
    for odd, masks in ((False, _EVEN), (True, _ODD)):
        own = fps[_odd(fps) == odd]
        key = _hash(own) & low
        order = np.argsort(key, kind="stable")
        sides[odd] = own[order], key[order], masks, _hash(masks) & low
    even = fps[~_odd(fps)]  # sorted; the variants without a flip
    found: list[np.ndarray] = []
    for k in range(1 << more):
        place = bucket | np.uint64(k << bits)
        (ev, ef), (ov, of) = (_variants(*sides[odd], place) for odd in (False, True))
        own, first, which = np.unique(ov, return_index=True, return_inverse=True)
        rep = of[first] if len(first) else of
        found.append(_checked(of, rep[which] if len(of) else of, radius))
        for keys, ends in ((own, rep), (even, even)):
            at, hit = _look_up(ev, keys)
            found.append(_checked(ef[hit], ends[at], radius))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.uint64)
    pairs = _forest(pairs).view(np.int64)
    return pa.table({"t": pa.array([table.column("t")[0].as_py()] * len(pairs), pa.int32()), "a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _variants(fps: np.ndarray, key: np.ndarray, masks: np.ndarray, steps: np.ndarray, place: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """All variants that hash to `place`, and the fingerprints that they come from."""
    want = place ^ steps
    a, b = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
    size = b - a
    masks, a, size = masks[size > 0], a[size > 0], size[size > 0]
    at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
    source = fps[at]
    return source ^ np.repeat(masks, size), source


def _look_up(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys is sorted. Positions in keys and in values of the values that are keys."""
    if not len(keys) or not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = max(10, int(len(keys)).bit_length() + 4)
    spread = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size)
    flags = np.zeros(1 << size, bool)
    flags[spread(keys)] = True
    maybe = np.flatnonzero(flags[spread(values)])
    at = np.minimum(np.searchsorted(keys, values[maybe]), len(keys) - 1)
    same = keys[at] == values[maybe]
    return at[same], maybe[same]


def _checked(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    near = (a != b) & (np.bitwise_count(a ^ b) <= radius)
    a, b = a[near], b[near]
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Of a bucket's links, as many as connect what all of them connect."""
    if len(pairs) < 2:
        return pairs
    nodes, ends = np.unique(pairs, return_inverse=True)
    parent = list(range(len(nodes)))
    kept = []
    for k, (x, y) in enumerate(ends.reshape(-1, 2).tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return pairs[kept]


def _bucket_bits(spark: SparkSession) -> int:
    """For about four buckets to a core, from 16 to 512: each bucket costs 8 bytes a fingerprint."""
    return min(9, max(4, (4 * spark.sparkContext.defaultParallelism - 1).bit_length()))


def links(fps: DataFrame, radius: int = RADIUS, per_bucket: int = PER_BUCKET, per_slice: int = PER_SLICE) -> DataFrame:
    """fps: t (int) and f, the distinct signed 64-bit fingerprints of each table t; read twice. Returns
    t, a, b: links among the fingerprints of a table at most `radius` bits apart, which connect the same
    groups as all such pairs do."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the balls emitted here reach {RADIUS} bits")
    most = fps.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    bits = _bucket_bits(fps.sparkSession)
    while bits < _MAX_HASH_BITS and most * min(len(_EVEN), 1 << bits) >> bits > per_bucket:
        bits += 1
    sent = fps.select("t", "f").mapInArrow(lambda it: _emit(it, bits), "t int, bucket long, fps binary")
    return sent.groupBy("t", "bucket").applyInArrow(lambda g: _links(g, bits, radius, per_slice), "t int, a long, b long").distinct()


def grouped(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps: id and fp, for all documents. Returns fp, component_id for each distinct fp: the least id
    among the documents whose fingerprints are linked with it, directly or through others."""
    nodes = common.durable(fps.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    roots = components(links(nodes.select(F.lit(0).alias("t"), F.col("fp").alias("f")), radius).select("a", "b"))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return common.spread_join(labelled, least, "label", nodes.count()).select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row for each document: id, fp (signed long) and component_id."""
    fps = common.durable(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")), "document-fingerprints")
    return common.spread_join(fps, grouped(fps, radius), "fp", fps.count()).select("id", "fp", "component_id")


_SIGNATURE = "norm binary, fp long, grams binary, bands array<long>"
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(text: Column, shingle: int = SHINGLE) -> Column:
    """norm: a 128-bit hash of the text's words; fp: its SimHash; grams: its shingles' distinct 32-bit hashes,
    sorted and packed; bands: hashes of BAND_ROWS MinHashes of its shingles each (null under `shingle` words)."""

    @F.arrow_udf(_SIGNATURE)
    def of(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_signatures([t.as_py() or "" for t in texts], shingle), ["norm", "fp", "grams", "bands"])

    return of(text)


def text_norm(text: Column) -> Column:
    """`norm` of `signature` alone."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([_norm((t.as_py() or "").encode("utf-8").lower().split()) for t in texts], pa.binary())

    return of(text)


def _norm(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


def _signatures(texts: list[str], shingle: int) -> list[pa.Array]:
    from lathe.llm.fingerprints import WORD_HASH, mixed

    norms, fps, packed, bands = [], [], [], []
    for text in texts:
        words = text.encode("utf-8").lower().split()
        norms.append(_norm(words))
        fps.append(simhash(text))
        if len(words) < shingle:
            packed.append(b"")
            bands.append(None)
            continue
        h = np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))
        grams = np.zeros(len(h) - shingle + 1, np.uint64)
        for k in range(shingle):
            grams = mixed(grams * np.uint64(3) + h[k : len(h) - shingle + 1 + k])
        packed.append(np.unique((grams >> np.uint64(32)).astype("<u4")).tobytes())
        bands.append(_bands(np.unique(grams)))
    WORD_HASH.clear()  # workers live on for other stages
    return [pa.array(norms, pa.binary()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(packed, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]


def _bands(grams: np.ndarray) -> np.ndarray:
    """The bands' keys; a MinHash is the least product of a shingle's hash with one of the odd factors."""
    from lathe.llm.fingerprints import mixed

    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 1 << 12):
        least = np.minimum(least, (_FACTORS[:, None] * grams[None, at : at + (1 << 12)]).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        keys = mixed(keys * np.uint64(3) + least[k::BAND_ROWS])
    return keys.view(np.int64)


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two packed sets; 0 if both are empty."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


@F.arrow_udf(T.DoubleType())
def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([jaccard(x.as_py(), y.as_py()) for x, y in zip(a, b)], pa.float64())


def _same_prints(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes: norm and fp of each text. Returns a, b: links between texts whose fingerprints are equal or
    within the radius, as few as keep groups together: equal ones to the least text, and the least ones
    among each other. (To meet is to be linked here, so nothing is left to verify.)"""
    heads = common.durable(nodes.groupBy("fp").agg(F.min("norm").alias("head")), "heads")
    near = links(heads.select(F.lit(0).alias("t"), F.col("fp").alias("f")), radius).select("a", "b")
    same = nodes.join(heads, "fp").where("norm <> head").select(F.col("norm").alias("a"), F.col("head").alias("b"))
    one, two = (heads.select(F.col("fp").alias(f"f{k}"), F.col("head").alias(f"h{k}")) for k in (1, 2))
    across = near.join(one, F.col("a") == F.col("f1")).join(two, F.col("b") == F.col("f2"))
    return same.unionByName(across.select(F.col("h1").alias("a"), F.col("h2").alias("b")))


def _met(nodes: DataFrame) -> DataFrame:
    """g, norm, size, n, head: the texts of each meeting of n texts, two or more, whose keys of a band agree, and
    the least of them. Meetings of the same texts in several bands count once."""
    keys = nodes.where("bands is not null").select("norm", "size", F.explode("bands").alias("g"))
    groups = keys.groupBy("g").agg(F.count("*").alias("n"), F.min("norm").alias("head"), F.expr("bit_xor(xxhash64(norm))").alias("texts")).where("n > 1")
    groups = common.durable(groups.groupBy("n", "head", "texts").agg(F.min("g").alias("g")).select("g", "n", "head"), "meetings")
    return common.durable(keys.join(groups, "g"), "met")


def _compared(met: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float, block: int, task_shingles: int) -> DataFrame:
    """a, b: verified links between texts of one meeting that have different labels (norm, label), as many
    as connect what all such links connect. Those outside a meeting's largest label are compared
    with all of it, a block of the one with a block of the other at a time."""
    rows = common.durable(met.where("n > 2").select("g", "norm", "size").join(labels, "norm"), "labelled")
    weight = F.col("size") + OVERHEAD
    parts = rows.groupBy("g", "label").agg(F.sum(weight).alias("c"))
    groups = parts.groupBy("g").agg(F.max(F.struct("c", "label")).alias("most"), F.count("*").alias("labels"), F.sum("c").alias("all"))
    groups = groups.where("labels > 1").select("g", F.col("most.label").alias("main"), F.ceil(F.col("all") / block).alias("wide"), F.ceil((F.col("all") - F.col("most.c")) / block).alias("tall"))
    open_ = rows.join(groups, "g").select("g", "norm", "size", "label", "main", "wide", "tall")
    spot = lambda n: F.pmod(F.xxhash64("norm"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = open_.withColumn("x", spot("wide")).withColumn("y", upto("tall")).withColumn("odd", F.lit(False))
    others = open_.where("label <> main").withColumn("y", spot("tall")).withColumn("x", upto("wide")).withColumn("odd", F.lit(True))
    sent = common.durable(every.unionByName(others).select("g", "x", "y", "odd", "norm", "size", "label"), "blocks")
    tasks = max(common.partitions(met.sparkSession), (sent.agg(F.sum(weight)).first()[0] or 0) // task_shingles + 1)
    sent = sent.drop("size").join(sets.withColumnRenamed("norm", "_n"), F.col("norm") == F.col("_n")).drop("_n")
    sent = sent.withColumn("task", F.pmod(F.xxhash64("g", "x", "y"), F.lit(tasks)))
    return sent.groupBy("task").applyInArrow(lambda t: _block_links(t, similarity), "a binary, b binary")


def _block_links(table: pa.Table, similarity: float) -> pa.Table:
    """The verified links of the blocks of one task."""
    table = table.sort_by([("g", "ascending"), ("x", "ascending"), ("y", "ascending")])
    g, x, y, odd = (table.column(c).to_numpy(zero_copy_only=False) for c in ("g", "x", "y", "odd"))
    norms, labels, packed = (table.column(c).to_pylist() for c in ("norm", "label", "grams"))
    cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
    parent: dict[bytes, bytes] = {}
    found: list[tuple[bytes, bytes]] = []

    def root(v: bytes) -> bytes:
        while (up := parent.get(v, v)) != v:
            parent[v] = parent.get(up, up)
            v = up
        return v

    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)]):
        all_, few = ([k for k in range(start, end) if odd[k] == side] for side in (False, True))
        if not all_ or not few:
            continue
        sets = [np.frombuffer(packed[k], "<u4") for k in all_]
        size = np.array([len(v) for v in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for k in few:
            own = np.frombuffer(packed[k], "<u4")
            low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            span = high - low
            at = np.repeat(low - np.cumsum(span) + span, span) + np.arange(span.sum())
            common_ = np.bincount(owner[at], minlength=len(sets))
            # a similarity needs that share of the union in common, and the union has at least the larger set
            for j in np.flatnonzero(common_ >= similarity * np.maximum(size, len(own)) - 1e-9).tolist():
                p, q = root(labels[k]), root(labels[all_[j]])
                if p != q and jaccard(packed[k], packed[all_[j]]) >= similarity:
                    parent[max(p, q)] = min(p, q)
                    found.append((norms[k], norms[all_[j]]))
    return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY, block: int = BLOCK, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """A row for each document: id, norm (a hash of its words), label (the group's) and component_id, the least
    id of its group. Links: fingerprints within the radius, or five-word shingles of at least this similarity."""
    base = docs.select(F.col(id_col).alias("id"), signature(F.col(text_col)).alias("s")).select("id", "s.*")
    base = common.durable(base, "signatures")
    nodes = common.durable(base.groupBy("norm").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first(F.octet_length("grams") / 4).cast("long").alias("size")), "texts")
    met = _met(nodes)
    wanted = met.select("norm").distinct().join(nodes.select("norm", "least"), "norm")
    wanted = wanted.select(F.col("norm").alias("_n"), F.col("least").alias("_l"))
    sets = base.select("id", "norm", "grams").join(wanted, (F.col("norm") == F.col("_n")) & F.col("id").eqNullSafe(F.col("_l"))).select("norm", "grams").dropDuplicates(["norm"])
    sets = common.durable(sets, "shingles")
    pairs = common.durable(met.where("norm <> head").select(F.col("norm").alias("a"), F.col("head").alias("b")).distinct(), "candidates")
    one, two = (sets.select(F.col("norm").alias(f"n{k}"), F.col("grams").alias(f"s{k}")) for k in (1, 2))
    both = pairs.join(one, F.col("a") == F.col("n1")).join(two, F.col("b") == F.col("n2"))
    verified = both.where(_jaccard("s1", "s2") >= similarity).select("a", "b")
    first = components(_same_prints(nodes.select("norm", "fp"), radius).unionByName(verified))
    labels = wanted.select(F.col("_n").alias("norm")).join(first, F.col("norm") == F.col("node"), "left").select("norm", F.coalesce("root", "norm").alias("label"))
    more = _compared(met, labels, sets, similarity, block, task_shingles)
    roots = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    labelled = nodes.select("norm", "least").join(roots, F.col("norm") == F.col("node"), "left").select("norm", "least", F.coalesce("root", "norm").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    rows = nodes.count()
    of_texts = common.durable(common.spread_join(labelled, least, "label", rows).select("norm", "label", "component_id"), "groups")
    return common.spread_join(base.select("id", "norm"), of_texts, "norm", rows).select("id", "norm", "label", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each group of `similar_groups`: the one with the least id (ids
    before none), then the least hash of its words; of rows that repeat both, one stays. Rows are told apart by
    id and words, so rows that share an id, or have none, go only with their own group."""
    found = similar_groups(docs, id_col, text_col, radius, similarity).select("id", "norm", "label").groupBy("id", "norm", "label").agg(F.count("*").alias("rows"))
    found = common.durable(found, "found")
    who = F.struct(F.col("id").isNull().alias("none"), "id", "norm")
    best = found.groupBy("label").agg(F.min(who).alias("best"))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("norm") == F.col("best.norm"))
    verdicts = common.durable(common.spread_join(found, best, "label", found.count()).select("id", "norm", "rows", stays.alias("stays")), "verdicts")
    ids = common.durable(verdicts.groupBy("id").agg(F.sum("rows").alias("rows"), F.max("stays").alias("stays")), "ids")

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    # helper columns begin with more underscores than any of docs
    own = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))
    gone, sharing, norm, one, kept_norm = (own + c for c in ("gone", "shared", "norm", "id", "kept"))
    dropped = ids.where("not stays").select(F.col("id").alias(gone))
    shared = ids.where("stays and rows > 1").select(F.col("id").alias(sharing))
    out = docs.join(sized(dropped), docs[id_col].eqNullSafe(F.col(gone)), "left_anti")
    if not shared.limit(1).count():
        return out
    # ids of several rows of which some stay: these rows are looked up by their words, too
    shared = sized(shared)
    by_id = docs[id_col].eqNullSafe(F.col(sharing))
    kept = verdicts.where("stays").select(F.col("id").alias(one), F.col("norm").alias(kept_norm))
    several = docs.join(shared, by_id, "left_semi").withColumn(norm, text_norm(F.col(text_col)))
    several = several.join(kept, (F.col(norm) == F.col(kept_norm)) & F.col(id_col).eqNullSafe(F.col(one)), "left_semi")
    return out.join(shared, by_id, "left_anti").unionByName(several.dropDuplicates([id_col, norm]).drop(norm))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
