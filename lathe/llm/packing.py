"""Best-fit packing of documents into training sequences (operator 10).

Method: only the histogram of piece lengths (at most `capacity` numbers, whatever the input)
goes to the driver. Best-fit decreasing runs over these counts: equal lengths that meet equal gaps
are placed in one step, so a plan is a list of runs, "the n_th to m_th pieces of this length go to
sequences s, s+1, ... at this offset". Each piece then takes its slot by a join on its rank within
its length. Ranks are counted within (length, salt) and shifted by the counts of lower salts, so a
length that a third of all pieces share is spread over many tasks.

A plan has a row for each run. A run uses up a length or a kind of gap, so its size depends on the
capacity and not on the number of pieces; it is a local table that Spark may broadcast.

Edge cases: null text is the empty text (one token, the end mark); a document of any length is cut
into full pieces after a first one that may be shorter; repeated rows are packed each on its own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import bpe, common

CAPACITY = 2048
END_ID = 0


@functools.lru_cache(maxsize=2)
def _library(path: str | None):
    """A function from text to packed ids, by a tokenizer library over the vocabulary of `path`. Texts that
    the library can't split (a run of some hundred thousand blanks) are encoded by `bpe`, with the same ids."""
    import tiktoken

    own = bpe.encoder(path)
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    special = own.special
    coder = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=own.ids, special_tokens=special)
    marks = set(special)

    def code(text: str) -> bytes:
        try:
            return np.asarray(coder.encode(text, allowed_special=marks), dtype="<u4").tobytes()
        except ValueError:  # its pattern engine gives up on very long runs of blanks
            return own.encode(text)

    return code


def token_ids(text: Column, tokenizer: str | None = None) -> Column:
    """Ids of whole texts, packed as little-endian unsigned 32-bit integers; empty for null."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        code = _library(tokenizer)
        return pa.array([code(t.as_py() or "") for t in texts], pa.binary())

    return ids(text)


def cut(docs: DataFrame, ids: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: docs' columns but ids, then piece, start, length and piece_ids.
    Documents of at most `capacity` ids stay whole; of longer ones the first piece takes the rest."""
    n = bpe.count_ids(F.col(ids))
    rest = n % capacity
    first = F.when(n <= capacity, n).when(rest == 0, F.lit(capacity)).otherwise(rest)
    keep = [c for c in docs.columns if c != ids]
    pieces = docs.select(*keep, ids, n.alias("_n"), first.cast("long").alias("_first")).select(
        *keep, ids, "_first", F.explode(F.sequence(F.lit(0), F.ceil((F.col("_n") - F.col("_first")) / capacity).cast("int"))).alias("piece")
    )
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("_first") + (F.col("piece") - 1) * capacity).cast("long")
    length = F.when(F.col("piece") == 0, F.col("_first")).otherwise(F.lit(capacity)).cast("long")
    return pieces.select(*keep, "piece", start.alias("start"), length.alias("length"), F.col(ids).substr((start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("piece_ids"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Returns runs (length, first rank, number, first sequence, offset): pieces of that length with
    ranks from `first rank` on go to as many consecutive sequences, each at `offset`."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted sizes of the gaps that open sequences have
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap: ranges (first sequence, number)
    new = 0

    def put(gap: int, first: int, number: int) -> None:
        if gap and gap not in open_at:
            insort(gaps, gap)
            open_at[gap] = []
        if gap:
            open_at[gap].append((first, number))

    for length in sorted((n for n, k in counts.items() if k and n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                per = capacity // length  # new sequences take as many of this length as fit
                full, more = divmod(left, per)
                for number, each in ((full, per), (1, more)):
                    if number and each:
                        for k in range(each):
                            runs.append((length, rank, number, new, k * length))
                            rank += number
                        put(capacity - each * length, new, number)
                        new += number
                left = 0
            else:
                gap = gaps[at]
                first, number = open_at[gap].pop()
                if not open_at[gap]:
                    del open_at[gap], gaps[at]
                used = min(number, left)
                runs.append((length, rank, used, first, capacity - gap))
                put(gap - length, first, used)
                if used < number:
                    put(gap, first + used, number - used)
                rank, left = rank + used, left - used
    return runs


def pack(pieces: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset. keys: columns that spread the pieces over salts (by default as
    many as shuffle partitions, at least 256).
    pieces is read three times, so hand in a written table (see `common.durable`)."""
    spark = pieces.sparkSession
    salts = salts or max(256, common.partitions(spark))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    counts = salted.groupBy(F.col(length).alias("_length"), "_salt").count()
    histogram = {r["_length"]: r["n"] for r in counts.groupBy("_length").agg(F.sum("count").alias("n")).collect()}
    if any(n is None or n < 0 or n > capacity for n in histogram):
        raise ValueError(f"piece lengths must be from 0 to {capacity}")
    runs = plan(histogram, capacity)
    # an Arrow table: rows from a list would go through Python workers of another kind, with a daemon of their own that stays
    columns = np.array(runs or [(0, 0, 0, 0, 0)], np.int64).T
    slots = spark.createDataFrame(pa.table({c: pa.array(v) for c, v in zip(("_length", "_first", "_number", "_sequence", "_offset"), columns)}))
    slots = slots.where("_number > 0").groupBy("_length").agg(F.sort_array(F.collect_list(F.struct("_first", "_sequence", "_offset"))).alias("_runs"))
    offsets = common.running_offsets(counts, ["_length"], "_salt", "count", "_before").drop("count")
    from pyspark.sql import Window

    order = [F.col(c) for c in keys]
    ranked = salted.withColumn("_in", F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*order)))
    placed = (
        ranked.join(offsets.withColumnRenamed("_length", "_l").withColumnRenamed("_salt", "_s"), (F.col(length) == F.col("_l")) & (F.col("_salt") == F.col("_s")))
        .withColumn("_rank", F.col("_in") - 1 + F.col("_before"))
        .join(F.broadcast(slots), F.col(length) == F.col("_length"))
    )
    placed = placed.withColumn("_run", _last_at_or_below(F.col("_runs"), F.col("_rank")))
    return placed.select(*pieces.columns, (F.col("_run._sequence") + F.col("_rank") - F.col("_run._first")).alias("sequence_id"), F.col("_run._offset").alias("offset"))


def _last_at_or_below(runs: Column, rank: Column) -> Column:
    """The last run whose first rank is at most `rank`; runs are sorted by it."""
    return F.element_at(F.filter(runs, lambda r: r["_first"] <= rank), -1)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens; a row for each piece."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed_documents(docs)


def packed_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """docs: doc_id and text. The rows of `op10_best_fit_packing`."""
    end = F.lit(END_ID.to_bytes(4, "little"))
    coded = docs.select("doc_id", token_ids(F.col("text"), tokenizer).alias("ids")).select("doc_id", F.concat("ids", end).alias("ids"))
    pieces = cut(coded, "ids").select("doc_id", "piece", "start", "length", F.crc32("piece_ids").alias("ids_crc32"))
    pieces = common.durable(pieces, "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"])
