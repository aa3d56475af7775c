"""Repair of the structure of conversations by cheapest edits (operator 11).

Roles must read `(s?(ua)+)?` by their initials. Each row is kept (0), given the role user or assistant (1) or deleted
(2), and empty rows of user or assistant are inserted anywhere (5); a row that isn't deleted although it is
truncated costs 5 more, blank and duplicate rows have to go. Nodes are (rows consumed, state of the pattern), so
edits are arcs of a graph without circles. Forward minimum costs f from the start and backward ones g to the end
tell which arcs lie on a cheapest path: those with f + cost + g equal to the whole cost. Along these tight arcs, a set of
nodes goes from the start: at each step the least letter that any of its nodes offers is taken, and all nodes that
offer it move. That spells the ASCII-least of all cheapest audits without listing them.

Rows are sorted over range partitions by conversation and turn, so a conversation of any length is spread over tasks, and
packed into runs of at most RUN rows. A conversation that one run holds is repaired in that run's row. Others
are joined from runs by what composes: costs as min-plus products of matrices (states by states), and steps as maps of
states; products are taken first within a partition, then over partitions, so no group is larger than a
partition's runs or the number of partitions. Duplicates across runs are found by an aggregate
over digests. Only the hash of a repaired conversation, which is sequential by nature, reads all its text in one task, as a stream.

Defined results: null roles and texts are one space; null turns sort first and stay null; null ids are one
conversation. Of equal turns, rows go by role (32 characters), text (64 characters) and a hash of both, so results don't depend on
the order of rows in the table; repeated rows are duplicates. A conversation that loses all rows, or has none, gets zeros, an empty audit
and the hash of nothing. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import durable, partitions, table

RUN = 512
BLANKS = " \t\n\x0b\x0c\r"
INF = 10**15
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTERS = "DIKR"  # in ASCII order

# States of the pattern: nothing yet, after s, after u, after a. It may end in the first and the last.
STATES = 4
ENDS = (0, 3)
#: What user or assistant leads to, from each state: a user but after a user.
NEXT = (2, 2, 3, 2)
_INITIALS = {"s": 0, "u": 1, "a": 2}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
FINE, CUT, GONE = 0, 1, 2  # faults, as far as edits depend on them


def _takes(initial: int) -> list[tuple[int, int]]:
    """(state, next state) where a role with this initial can stand."""
    return {0: [(0, 1)], 1: [(0, 2), (1, 2), (3, 2)], 2: [(2, 3)]}.get(initial, [])


_INSERTS = [(s, NEXT[s], INSERT) for s in range(STATES)]


@functools.cache
def _arcs(code: int) -> dict[str, list[tuple[int, int, int]]]:
    """Arcs (state, next state, cost) that consume a row, by letter. code: initial * 3 + fault."""
    initial, fault = divmod(code, 3)
    arcs = {"D": [(s, s, DELETE) for s in range(STATES)], "K": [], "R": []}
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        arcs["K"] = [(s, t, KEEP + more) for s, t in _takes(initial)]
        arcs["R"] = [(s, NEXT[s], REROLE + more) for s in range(STATES)]
    return arcs


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(1), INF)


@functools.cache
def _closure() -> np.ndarray:
    """Cheapest inserts between states at one place."""
    m = np.full((STATES, STATES), INF, np.int64)
    np.fill_diagonal(m, 0)
    for s, t, c in _INSERTS:
        m[s, t] = min(m[s, t], c)
    return _product(_product(m, m), m)


@functools.cache
def _step(code: int) -> np.ndarray:
    """Cheapest ways over a place's inserts and its row."""
    m = np.full((STATES, STATES), INF, np.int64)
    for arcs in _arcs(code).values():
        for s, t, c in arcs:
            m[s, t] = min(m[s, t], c)
    return _product(_closure(), m)


def transfer(codes: bytes) -> np.ndarray:
    out = np.full((STATES, STATES), INF, np.int64)
    np.fill_diagonal(out, 0)
    for code in codes:
        out = _product(out, _step(code))
    return out


def first_costs() -> np.ndarray:
    return np.array([0] + [INF] * (STATES - 1), np.int64)


def last_costs() -> np.ndarray:
    """Costs from each state to an end, behind the last row."""
    return _closure()[:, list(ENDS)].min(1)


def _forward(f: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.minimum((f[:, None] + m).min(0), INF)


def _backward(m: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.minimum((m + g[None]).min(1), INF)


class Tight:
    """The tight arcs of a stretch of rows. f: costs to the states before it (without inserts there); g: costs
    from those behind it; cost: that of the whole conversation. last: whether the conversation ends here."""

    def __init__(self, codes: bytes, f: np.ndarray, g: np.ndarray, cost: int, last: bool):
        self.codes, self.cost, self.last = codes, cost, last
        to = [_forward(f, _closure())]
        for code in codes:
            to.append(_forward(_forward(f, _step(code)), _closure()))
            f = _forward(f, _step(code))
        back = [g]
        for code in reversed(codes):
            back.append(_backward(_step(code), back[-1]))
        self.to, self.back = [x.tolist() for x in to], [x.tolist() for x in reversed(back)]

    def walk(self, nodes: int) -> tuple[str, int]:
        """The least letters from a set of states (a bit each) before the stretch, and the set behind it."""
        at, letters = 0, []
        while True:
            end = at == len(self.codes)
            if end and not (self.last and not any(nodes >> s & 1 for s in ENDS)):
                return "".join(letters), nodes
            arcs = {"I": _INSERTS} if end else {**_arcs(self.codes[at]), "I": _INSERTS}
            for letter in LETTERS:
                after = at if letter == "I" else at + 1
                moved = 0
                for s, t, c in arcs.get(letter, ()):
                    if nodes >> s & 1 and self.to[at][s] + c + self.back[after][t] == self.cost:
                        moved |= 1 << t
                if moved:
                    break
            else:
                return "", 0  # no cheapest path leads over these states
            letters.append(letter)
            nodes, at = moved, after


@functools.lru_cache(100_000)
def audit_of(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    f, g = first_costs(), last_costs()
    to = f
    for code in codes:
        to = _forward(to, _step(code))
    cost = int((to + g).min())
    return cost, Tight(codes, f, g, cost, True).walk(1)[0]


# ---- rows -------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text, gone: rows after damage; dropped ones stay as `gone`."""
    conv, turn = F.col(conv_col), F.col(turn_col).cast("long")
    name = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), F.pmod(F.crc32(name.cast("binary")), F.lit(20)).alias("_h"))
    h = F.col("_h")
    text = F.when(h == 1, "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(h == 4, "user").otherwise(F.col("role"))
    copies = F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (h == 0).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")


def undamaged(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = F.lit(" ")
    return conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"), F.lit(False).alias("gone"))


def runs_of(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text, gone) packed in order: conv_id, run (a number in the order of runs), whole
    (this is all of the conversation), and arrays turns, roles, texts of the rows that aren't gone."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("_role"), F.asc("_text"), F.asc("_tie"), F.asc("_spread")]
    keyed = rows.withColumns({"_role": F.left("role", F.lit(32)), "_text": F.left("text", F.lit(64)), "_tie": F.xxhash64("role", "text"), "_spread": F.monotonically_increasing_id()})
    placed = keyed.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", F.monotonically_increasing_id().alias("_at"))

    def packed(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id")
            codes = conv.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            sizes = np.diff(np.r_[first, n])
            starts = np.concatenate([np.arange(a, a + s, RUN) for a, s in zip(first.tolist(), sizes.tolist())])
            owner = np.repeat(np.arange(len(first)), -(-sizes // RUN))
            whole = (sizes <= RUN)[owner] & (owner > 0) & (owner < len(first) - 1)
            there = ~batch.column("gone").to_numpy(zero_copy_only=False)
            before = np.r_[0, np.cumsum(there)]
            offsets = pa.array(before[np.r_[starts, n]], pa.int32())
            kept = batch.filter(pa.array(there))
            listed = lambda c: pa.ListArray.from_arrays(offsets, kept.column(c))
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([conv.take(at), batch.column("_at").take(at), pa.array(whole), listed("turn"), listed("role"), listed("text")], names=["conv_id", "run", "whole", "turns", "roles", "texts"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return placed.mapInArrow(packed, f"conv_id {kind}, run long, whole boolean, turns array<long>, roles array<string>, texts array<string>")


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _firsts(roles: list[str], texts: list[str]) -> list[bool]:
    seen: set[tuple[str, str]] = set()
    out = []
    for row in zip(roles, texts):
        out.append(row not in seen)
        seen.add(row)
    return out


def coded(roles: list[str], texts: list[str], first: list[bool]) -> tuple[bytes, list[int]]:
    """A code for each row, and how many rows are blank, duplicate and truncated."""
    codes, faults = bytearray(), [0, 0, 0]
    for role, text, new in zip(roles, texts, first):
        end = text.rstrip(BLANKS)[-1:]
        if not end or not new:
            faults[0 if not end else 1] += 1
            fault = GONE
        elif end not in ".!?":
            faults[2] += 1
            fault = CUT
        else:
            fault = FINE
        codes.append(_INITIALS.get(role[:1], 3) * 3 + fault)
    return bytes(codes), faults


def repaired(letters: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """The lines `role:text` that letters make of rows, from a state of the pattern on, and the state behind them."""
    lines, at = [], 0
    for letter in letters:
        if letter != "D":
            given = "assistant" if state == 2 else "user"
            role = roles[at] if letter == "K" else given
            lines.append(f"{role}:{'' if letter == 'I' else texts[at]}")
            state = 1 if letter == "K" and role[:1] == "s" else NEXT[state]
        if letter != "I":
            at += 1
    return lines, state


# ---- what composes ----------------------------------------------------------------------------------------

#: Places of a summary: the matrix of costs, first and last initial (-1: no rows), adjacent pairs that are illegal, blank,
#: duplicate and truncated rows, whether any row has a turn, least and greatest turn, different turns.
_FIRST, _LAST, _ILLEGAL, _BLANK, _HAS, _LOW, _HIGH, _TURNS = 16, 17, 18, 19, 22, 23, 24, 25


def summary(codes: bytes, faults: list[int], turns: list[int | None], matrix: np.ndarray | None = None) -> list[int]:
    initials = [c // 3 for c in codes]
    illegal = sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))
    known = [t for t in turns if t is not None]
    span = [1, known[0], known[-1], len(set(known))] if known else [0, 0, 0, 0]
    m = [0] * 16 if matrix is None else matrix.ravel().tolist()
    return [*m, *((initials[0], initials[-1]) if initials else (-1, -1)), illegal, *faults, *span]


def composed(a: list[int], b: list[int]) -> list[int]:
    """The summary of two neighbouring stretches of rows."""
    out = _product(np.array(a[:16]).reshape(4, 4), np.array(b[:16]).reshape(4, 4)).ravel().tolist()
    if a[_FIRST] < 0 or b[_FIRST] < 0:
        out += (b if a[_FIRST] < 0 else a)[_FIRST : _LAST + 1]
    else:
        out += [a[_FIRST], b[_LAST]]
    meet = a[_LAST] >= 0 and b[_FIRST] >= 0 and (a[_LAST], b[_FIRST]) not in _LEGAL
    out += [a[_ILLEGAL] + b[_ILLEGAL] + meet] + [x + y for x, y in zip(a[_BLANK:_HAS], b[_BLANK:_HAS])]
    if a[_HAS] and b[_HAS]:
        return [*out, 1, a[_LOW], b[_HIGH], a[_TURNS] + b[_TURNS] - (a[_HIGH] == b[_LOW])]
    return out + (a if a[_HAS] else b)[_HAS:]


def _counts(s: list[int]) -> tuple[int, ...]:
    """gaps, blank, duplicate, truncated, illegal of a summary."""
    gaps = s[_HIGH] - s[_LOW] + 1 - s[_TURNS] if s[_HAS] else 0
    return gaps, *s[_BLANK:_HAS], s[_ILLEGAL]


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_RESULT = [*_COUNTS, "cost", "audit", "repaired_sha256"]


def _whole(batches):
    """Conversations that lie in one run."""
    for batch in batches:
        out: list[list] = [[] for _ in _RESULT]
        for turns, roles, texts in zip(batch.column("turns").to_pylist(), batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
            codes, faults = coded(roles, texts, _firsts(roles, texts))
            cost, audit = audit_of(codes)
            lines, _ = repaired(audit, 0, roles, texts)
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            for column, value in zip(out, (*_counts(summary(codes, faults, turns)), cost, audit, digest)):
                column.append(value)
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, k) for v, k in zip(out, kinds))], names=["conv_id", *_RESULT])


def _spread(runs: DataFrame) -> DataFrame:
    """Conversations of several runs. A conversation's key is its id as text, so that null ids are a key like any other."""
    runs = runs.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))).withColumn("part", F.shiftright("run", 33))

    def digests(batches):
        for batch in batches:
            found = [(k, run, i, _digest(r, t)) for k, run, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("key", "run", "roles", "texts"))) for i, (r, t, new) in enumerate(zip(roles, texts, _firsts(roles, texts))) if new]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.binary()))], names=["key", "run", "at", "digest"])

    seen = runs.select("key", "run", "roles", "texts").mapInArrow(digests, "key string, run long, at int, digest binary")
    first = seen.groupBy("key", "digest").agg(F.min(F.struct("run", "at")).alias("f")).groupBy(F.col("f.run").alias("run")).agg(F.collect_list("f.at").alias("new"))

    def summaries(batches):
        for batch in batches:
            codes_, sums = [], []
            for turns, roles, texts, new in zip(*(batch.column(c).to_pylist() for c in ("turns", "roles", "texts", "new"))):
                fresh = set(new or ())
                codes, faults = coded(roles, texts, [i in fresh for i in range(len(roles))])
                codes_.append(codes)
                sums.append(summary(codes, faults, turns, transfer(codes)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "part", "run")), pa.array(codes_, pa.binary()), pa.array(sums, pa.list_(pa.int64()))], names=["key", "part", "run", "codes", "sums"])

    summed = durable(runs.join(first, "run", "left").select("key", "part", "run", "turns", "roles", "texts", "new").mapInArrow(summaries, "key string, part long, run long, codes binary, sums array<long>"), "summaries")
    matrix = lambda s: np.array(s[:16], np.int64).reshape(4, 4)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "part": [pdf["part"].iloc[0]], "sums": [functools.reduce(composed, [list(s) for s in pdf["sums"]])]})

    def costs(order: str):
        """f before and g behind each row of a group, from those of the whole (at the ends: of a conversation)."""

        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order).reset_index(drop=True)
            has = "f" in pdf
            f = np.array(pdf["f"].iloc[0], np.int64) if has else first_costs()
            g = np.array(pdf["g"].iloc[0], np.int64) if has else last_costs()
            ms, fs, gs = [matrix(s) for s in pdf["sums"]], [], []
            for m in ms:
                fs.append(f)
                f = _forward(f, m)
            for m in reversed(ms):
                gs.append(g)
                g = _backward(m, g)
            gs.reverse()
            pdf["f"], pdf["g"] = [x.tolist() for x in fs], [x.tolist() for x in gs]
            if not has:
                pdf["cost"] = min(int((f + last_costs()).min()), INF)
                pdf["final"] = [k == len(pdf) - 1 for k in range(len(pdf))]
                return pdf[["key", "part", "f", "g", "cost", "final"]]
            runs_final = [bool(pdf["final"].iloc[0]) and k == len(pdf) - 1 for k in range(len(pdf))]
            maps = []
            for codes, a, b, cost, last in zip(pdf["codes"], fs, gs, pdf["cost"], runs_final):
                tight = Tight(bytes(codes), a, b, int(cost), last)
                maps.append([tight.walk(nodes)[1] for nodes in range(1 << STATES)])
            pdf["final"], pdf["map"] = runs_final, maps
            return pdf[["key", "part", "run", "codes", "f", "g", "cost", "final", "map"]]

        return of

    parts = summed.groupBy("key", "part").applyInPandas(fold, "key string, part long, sums array<long>")
    parts = durable(parts, "parts")
    by_part = parts.groupBy("key").applyInPandas(costs("part"), "key string, part long, f array<long>, g array<long>, cost long, final boolean")
    mapped = durable(summed.join(by_part, ["key", "part"]).groupBy("key", "part").applyInPandas(costs("run"), "key string, part long, run long, codes binary, f array<long>, g array<long>, cost long, final boolean, map array<long>"), "maps")

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = list(range(1 << STATES))
        for m in pdf.sort_values("run")["map"]:
            nodes = [m[x] for x in nodes]
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "part": [pdf["part"].iloc[0]], "map": [nodes]})

    def starts(order: str):
        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order).reset_index(drop=True)
            nodes, out = int(pdf["nodes"].iloc[0]) if "nodes" in pdf else 1, []
            for m in pdf["map"]:
                out.append(nodes)
                nodes = int(m[nodes])
            return pdf[["key", order]].assign(nodes=out)

        return of

    by_part = mapped.groupBy("key", "part").applyInPandas(chained, "key string, part long, map array<long>").groupBy("key").applyInPandas(starts("part"), "key string, part long, nodes long")
    by_run = mapped.select("key", "part", "run", "map").join(by_part, ["key", "part"]).groupBy("key", "part").applyInPandas(starts("run"), "key string, run long, nodes long").select("run", "nodes")

    def pieces(batches):
        for batch in batches:
            out = []
            for codes, f, g, cost, last, nodes, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("codes", "f", "g", "cost", "final", "nodes", "roles", "texts"))):
                letters, _ = Tight(codes, np.array(f), np.array(g), cost, last).walk(nodes)
                # A letter leads from one state to one other, so a set that begins with one state keeps one.
                lines, _ = repaired(letters, nodes.bit_length() - 1, roles, texts)
                out.append((letters, "\n".join(lines).encode() if lines else None))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "run", "cost")), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], names=["key", "run", "cost", "audit", "block"])

    joined = runs.select("run", "roles", "texts").join(mapped.drop("part", "map"), "run").join(by_run, "run")
    done = joined.mapInArrow(pieces, "key string, run long, cost long, audit string, block binary")

    def hashed(batches):
        key, cost, audit, digest, blocks = None, 0, [], hashlib.sha256(), 0
        row = lambda: pa.RecordBatch.from_pydict({"key": [key], "cost": pa.array([cost], pa.int64()), "audit": ["".join(audit)], "repaired_sha256": [digest.hexdigest()]})
        for batch in batches:
            for k, c, letters, block in zip(*(batch.column(x).to_pylist() for x in ("key", "cost", "audit", "block"))):
                if k != key:
                    if key is not None:
                        yield row()
                    key, audit, digest, blocks = k, [], hashlib.sha256(), 0
                cost = c
                audit.append(letters)
                if block is not None:
                    digest.update((b"\n" if blocks else b"") + block)
                    blocks += 1
        if key is not None:
            yield row()

    n = partitions(runs.sparkSession)
    texts = done.repartition(n, "key").sortWithinPartitions("key", "run").mapInArrow(hashed, "key string, cost long, audit string, repaired_sha256 string")

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        s = functools.reduce(composed, [list(x) for x in pdf.sort_values("part")["sums"]])
        return pd.DataFrame([[pdf["key"].iloc[0], *_counts(s)]], columns=["key", *_COUNTS])

    counts = parts.groupBy("key").applyInPandas(totals, "key string, " + ", ".join(f"{c} long" for c in _COUNTS))
    ids = runs.groupBy("key").agg(F.first("conv_id", ignorenulls=True).alias("conv_id"))
    return ids.join(counts, "key").join(texts, "key").select("conv_id", *_RESULT)


def repair(conversations: DataFrame, *, damage: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    damage: whether rows are damaged first, as the query's contract says."""
    rows = (damaged if damage else undamaged)(conversations, conv_col, turn_col, role_col, text_col)
    runs = durable(runs_of(rows), "runs")
    kind = runs.schema["conv_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in [*_COUNTS, "cost"])
    whole = runs.where("whole").select("conv_id", "turns", "roles", "texts").mapInArrow(_whole, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")
    return whole.unionByName(_spread(runs.where("not whole")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired text of every conversation of `conversations`, after damage."""
    return repair(table(spark, sf_dir, "conversations"), damage=True)
