"""Vector code compression (operator 13): product quantization by weighted Lloyd rounds over distinct parts.

Components become integers floor(SCALE * x), and each vector is cut into PARTS equal consecutive parts. Equal
parts of a position are one row with a weight, so a vector that a third of the table holds costs what
any other does. A round assigns every distinct part to the nearest entry of its position's codebook and moves
each entry to floor(sum / count) of its parts, weighted; all of this is integer arithmetic, so neither the order
of rows nor their partitions change a result. A codebook has `entries` entries a position, whatever the table's size:
only these reach the driver. At the end codes and errors are joined back to the vectors by part; parts that more
vectors share than an even task has rows are split by salts.

Defined results: rows whose vector is null or holds null, NaN or infinite components are left out. Vectors of
unequal length count as padded with zeros, to the longest length and to a multiple of PARTS; an empty
vector is all zeros. Fewer kept rows than `entries`: the codebooks have only as many. Null ids
come last in the order of ids, equal ids are ordered by label and vector. Repeated rows each get a row. Scaled components are held at
+-2^53, beyond which doubles skip integers. Errors are held at the largest long. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import durable, partitions, spread_join, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
MOST = 2**53
LONG = 2**63 - 1

#: For each position, the entries in order, each a tuple of integers.
Books = list[list[tuple[int, ...]]]


@dataclass
class Codes:
    """rows: the kept rows' columns, `code` (hex, two digits a position) and `error`."""

    rows: DataFrame
    books: Books

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for book in self.books for entry in book for c in entry).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, good), F.lit(False))


def integer_parts(vector: Column, width: int, parts: int = PARTS, scale: int = SCALE) -> Column:
    """The parts (arrays of long) of a vector of doubles, padded to parts * width components."""
    scaled = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("long"))
    padded = F.concat(scaled, F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size(scaled)))
    return F.array(*(F.slice(padded, k * width + 1, width) for k in range(parts)))


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries: 64-bit integers where they can't overflow, else Python's."""
    top = max((int(np.abs(a).max()) if a.size else 0) for a in (x, book))
    kind = np.int64 if 4 * top * top * max(1, x.shape[1]) < LONG else object
    x, book = x.astype(kind), book.astype(kind)
    out = np.zeros((len(x), len(book)), kind)
    for d in range(x.shape[1]):
        out += (x[:, d, None] - book[None, :, d]) ** 2
    return out


def _assigned(batch: pa.RecordBatch, books: Books, width: int):
    """For each position in a batch of (position, part, ...): its rows, their integers, nearest entry and distance."""
    position = batch.column("position").to_numpy(zero_copy_only=False)
    parts = batch.column("part")
    flat = parts.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(position), width)
    for p in np.unique(position):
        at = np.flatnonzero(position == p)
        for low in range(0, len(at), 65_536):
            rows = at[low : low + 65_536]
            d = _distances(flat[rows], np.array(books[p], np.int64).reshape(len(books[p]), width))
            best = np.argmin(d, axis=1) if d.dtype != object else np.array([min(range(len(r)), key=lambda j, r=r: (r[j], j)) for r in d.tolist()], np.int64)
            yield int(p), rows, flat[rows], best, d[np.arange(len(rows)), best]


def _round(distinct: DataFrame, books: Books, width: int) -> Books:
    """One weighted Lloyd round: a task sends a row for each entry it uses, the driver gets one for each entry."""

    def sums(batches):
        for batch in batches:
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            found: dict[tuple[int, int], tuple[int, list[int]]] = {}
            for p, rows, x, best, _ in _assigned(batch, books, width):
                for j in np.unique(best):
                    mine = best == j
                    w, v = weight[rows[mine]], x[mine]
                    safe = not v.size or int(np.abs(v).max()) * int(w.sum()) < LONG
                    total = (v * w[:, None]).sum(0).tolist() if safe else [sum(a * b for a, b in zip(c, w.tolist())) for c in v.T.tolist()]
                    n, old = found.get((p, int(j)), (0, [0] * width))
                    found[p, int(j)] = n + int(w.sum()), [a + b for a, b in zip(old, total)]
            if found:
                keys = list(found)
                yield pa.RecordBatch.from_pydict(
                    {
                        "position": pa.array([k[0] for k in keys], pa.int32()),
                        "entry": pa.array([k[1] for k in keys], pa.int32()),
                        "n": pa.array([found[k][0] for k in keys], pa.int64()),
                        "sums": pa.array([[str(s) for s in found[k][1]] for k in keys], pa.list_(pa.string())),
                    }
                )

    partial = distinct.mapInArrow(sums, "position int, entry int, n long, sums array<string>")
    dims = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"_{d}") for d in range(width)]
    moved = [list(book) for book in books]
    for row in partial.groupBy("position", "entry").agg(F.sum("n").alias("n"), *dims).collect():
        moved[row["position"]][row["entry"]] = tuple(int(row[f"_{d}"]) // row["n"] for d in range(width))
    return moved


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all usable vectors. rows has id_col, label_col (only these two; other columns are left out), code, error."""
    kept = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).cast("array<double>").alias("_x"))
    longest = kept.agg(F.max(F.size("_x"))).first()[0] or 0
    width = -(-longest // parts)
    cut = kept.select("_id", "_label", integer_parts(F.col("_x"), width, parts, scale).alias("_parts"))

    first = cut.orderBy(F.asc_nulls_last("_id"), F.asc_nulls_last("_label"), "_parts").limit(entries).collect()  # `entries` rows
    books: Books = [[tuple(r["_parts"][p]) for r in first] for p in range(parts)]
    exploded = cut.withColumn("_row", F.monotonically_increasing_id()).select("_row", "_id", "_label", F.posexplode("_parts").alias("position", "part"))
    distinct = durable(exploded.groupBy("position", "part").agg(F.count("*").alias("weight")), "parts")
    if first:
        for _ in range(rounds):
            books = _round(distinct, books, width)

    def assign(batches):
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), [0] * batch.num_rows
            for _, rows, _, best, d in _assigned(batch, books, width):
                code[rows] = best
                for r, e in zip(rows.tolist(), d.tolist()):
                    error[r] = min(int(e), LONG)
            yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("part"), batch.column("weight"), pa.array(code), pa.array(error, pa.int64())], names=["position", "part", "weight", "entry", "error"])

    codes = distinct.mapInArrow(assign, "position int, part array<long>, weight long, entry int, error long")
    # Parts that more rows share than an even task has: at most `parts` times as many as tasks.
    rows = distinct.agg(F.sum("weight")).first()[0] or 0
    limit = max(256, rows // partitions(vectors.sparkSession))
    hot = distinct.where(F.col("weight") > limit).select("position", "part", F.ceil(F.col("weight") / limit).cast("int").alias("_ways"))
    ways = F.coalesce("_ways", F.lit(1))
    left = exploded.join(F.broadcast(hot), ["position", "part"], "left").withColumn("_salt", F.pmod(F.xxhash64("_row"), ways).cast("int")).drop("_ways")
    right = codes.withColumn("_ways", F.when(F.col("weight") > limit, F.ceil(F.col("weight") / limit)).otherwise(1).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1))).drop("_ways", "weight")
    joined = left.join(right, ["position", "part", "_salt"])
    total = F.aggregate("_found", F.lit(0).cast("decimal(38,0)"), lambda a, f: (a + f["error"]).cast("decimal(38,0)"))
    by_row = joined.groupBy("_row").agg(F.first("_id").alias(id_col), F.first("_label").alias(label_col), F.array_sort(F.collect_list(F.struct("position", "entry", "error"))).alias("_found"))
    code = F.array_join(F.transform("_found", lambda f: F.lpad(F.lower(F.hex(f["entry"])), 2, "0")), "")
    return Codes(by_row.select(id_col, label_col, code.alias("code"), F.least(total, F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("error")), books)


def with_label_error(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """rows with `label_error`: the error summed over equal labels, nulls together. A label that very many
    rows have is split by salts."""
    keyed = durable(rows.withColumn("_key", F.to_json(F.struct(F.col(label_col).alias("l")))), "codes")
    long = F.lit(LONG).cast("decimal(38,0)")
    sums = keyed.groupBy("_key").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), long).cast("long").alias("label_error"))
    return spread_join(keyed, sums, "_key", keyed.count()).drop("_key")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of `embeddings`."""
    found = compress(table(spark, sf_dir, "embeddings"))
    rows = with_label_error(found.rows)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(found.digest).alias("codebooks_sha256"))


def _sql() -> str:
    dist = "list_sum(list_transform(list_zip(a.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cut AS (SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS part FROM kept, (SELECT unnest(range({PARTS})) AS p))",
        "weighted AS (SELECT p, part, count(*) AS w FROM cut GROUP BY p, part)",
        f"book0 AS (SELECT p, j, part FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j FROM cut) WHERE j < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"near{k} AS (SELECT a.p, a.part, a.w, min(({dist}) * {ENTRIES} + b.j) AS best FROM weighted a JOIN book{k} b ON a.p = b.p GROUP BY a.p, a.part, a.w)")
        if k < ROUNDS:
            steps.append(f"dim{k} AS (SELECT p, best % {ENTRIES} AS j, unnest(range(len(part))) AS d, unnest(part) AS x, w FROM near{k})")
            steps.append(f"sum{k} AS (SELECT p, j, d, CAST(sum(x * w) AS HUGEINT) AS s, CAST(sum(w) AS HUGEINT) AS n FROM dim{k} GROUP BY p, j, d)")
            steps.append(f"moved{k} AS (SELECT p, j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS part FROM sum{k} GROUP BY p, j)")
            steps.append(f"book{k + 1} AS (SELECT b.p, b.j, coalesce(m.part, b.part) AS part FROM book{k} b LEFT JOIN moved{k} m ON b.p = m.p AND b.j = m.j)")
    last = f"near{ROUNDS}"
    steps.append(
        f"""coded AS (SELECT c.vec_id, c.label, string_agg(format('{{:02x}}', CAST(n.best % {ENTRIES} AS BIGINT)), '' ORDER BY c.p) AS code, CAST(sum(n.best // {ENTRIES}) AS BIGINT) AS error
  FROM cut c JOIN {last} n ON c.p = n.p AND c.part = n.part GROUP BY c.vec_id, c.label)"""
    )
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"


ORACLE_SQL = _sql()
