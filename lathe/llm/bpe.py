"""Byte-level BPE encoding and decoding (operator 1).

Method: each short word keeps a contiguous array of part boundaries and an array with the merge
rank of each adjacent pair of parts. The rank array is scanned for its minimum, the boundary
between the two parts is deleted, and the ranks of the neighbouring pairs are looked up anew,
until no pair has a rank. Words repeat, so each task keeps the ids of words it has met, in a
cache of bounded size. Words of more than SHORT bytes (a page of symbols without a space) take
the same merges through a heap, as scanning them again and again would be quadratic.

Inputs and edge cases: null text is the empty text and has no ids; any length is encoded whole;
rows are independent, so repeated rows, empty tables and extra columns need no care.
"""

from __future__ import annotations

import functools
import heapq
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import common

#: Words of at most so many bytes use the contiguous rank array.
SHORT = 256
#: Words that a task's cache holds before it starts anew (about 90 MB).
CACHE_WORDS = 400_000
_NONE = 1 << 30


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary, on this machine or on an executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes are themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Maps a pre-split word to its ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        as_byte = _bytes_of_chars()
        raw = lambda token: bytes(as_byte[c] for c in token)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.ranks = {raw(a + b): r for r, (a, b) in enumerate(pairs)}
        self.left = [len(raw(a)) for a, _ in pairs]  # a rank holds for this split of its bytes only
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in self.ids.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = bytes(as_byte[c] for c in t if c in as_byte)
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall

    def __missing__(self, word: str) -> bytes:
        data = word.encode("utf-8")
        parts = self.merged(data) if len(data) <= SHORT else self.merged_long(data)
        packed = struct.pack(f"<{len(parts)}I", *map(self.ids.__getitem__, parts))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = packed
        return packed

    def rank(self, data: bytes, start: int, middle: int, end: int) -> int:
        r = self.ranks.get(data[start:end], _NONE)
        return r if r == _NONE or self.left[r] == middle - start else _NONE

    def merged(self, data: bytes) -> list[bytes]:
        """The parts of a short word, by the contiguous rank array."""
        get, left = self.ranks.get, self.left
        bounds = list(range(len(data) + 1))
        ranks = [r if (r := get(data[i : i + 2], _NONE)) == _NONE or left[r] == 1 else _NONE for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            a, b = bounds[i], bounds[i + 1]
            if i < len(ranks):
                r = get(data[a : bounds[i + 2]], _NONE)
                ranks[i] = r if r == _NONE or left[r] == b - a else _NONE
            if i:
                before = bounds[i - 1]
                r = get(data[before:b], _NONE)
                ranks[i - 1] = r if r == _NONE or left[r] == a - before else _NONE
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]

    def merged_long(self, data: bytes) -> list[bytes]:
        """The parts of a long word: the same merges in the same order, the least rank from a heap."""
        n = len(data)
        after, before = list(range(1, n + 2)), list(range(-1, n))  # neighbouring boundaries
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := self.rank(data, i, i + 1, i + 2)) != _NONE]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if gone[i] or gone[j] or gone[k] or after[i] != j or after[j] != k:
                continue
            gone[j], after[i], before[k] = 1, k, i
            if k < n and (r := self.rank(data, i, k, after[k])) != _NONE:
                heapq.heappush(heap, (r, i, k, after[k]))
            if i > 0 and (r := self.rank(data, before[i], i, k)) != _NONE:
                heapq.heappush(heap, (r, before[i], i, k))
        bounds = [i for i in range(n + 1) if not gone[i]]
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, text: str) -> bytes:
        if self.cut is None:
            return b"".join(map(self.__getitem__, self.words(text)))
        out = []
        for k, piece in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(self.special[piece].to_bytes(4, "little"))
            elif piece:
                out += map(self.__getitem__, self.words(piece))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    """One for each Python worker and vocabulary."""
    return Encoder(path or default_tokenizer())


def encode(text: Column, tokenizer: str | None = None) -> Column:
    """Ids of each whole text: binary, little-endian unsigned 32-bit integers; empty for null.
    tokenizer: path of the vocabulary file on every executor (default: the installed public one)."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        e = encoder(tokenizer)
        return pa.array([e.encode(t.as_py() or "") for t in texts], pa.binary())

    return ids(text)


def decode(ids: Column, tokenizer: str | None = None) -> Column:
    """The text of packed ids; bytes that aren't UTF-8 become U+FFFD; null ids give null."""

    @F.arrow_udf("string")
    def texts(packed: pa.Array) -> pa.Array:
        e = encoder(tokenizer)
        return pa.array([None if (p := x.as_py()) is None else e.decode(p) for x in packed], pa.string())

    return texts(ids)


def roundtrip(text: Column, tokenizer: str | None = None) -> Column:
    """struct<ids, decoded>: what `encode` gives and what `decode` makes of it, in one pass (Spark
    would encode twice if a query asks for both ids and the text decoded from them)."""

    @F.arrow_udf("ids binary, decoded string")
    def both(texts: pa.Array) -> pa.Array:
        e = encoder(tokenizer)
        ids = [e.encode(t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(e.decode, ids), pa.string())], ["ids", "decoded"])

    return both(text)


def count_ids(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes all documents; one row each with its number of ids and two digests."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.select("doc_id", roundtrip(F.col("text")).alias("r")).select("doc_id", "r.ids", "r.decoded")
    return both.select(
        "doc_id",
        count_ids(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
