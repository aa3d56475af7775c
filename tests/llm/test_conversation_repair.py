"""Repaired conversations against plain Python that keeps the least string of every node."""

import hashlib
import random
import re
import zlib

import pytest

from lathe.llm import conversation_repair as C
from tests.oracle import DIR

WS = "\x20\x09-\x0d"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(name.encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def plain(rows):
    """What is expected of one conversation's rows after damage, in order."""
    seen, faults, codes = set(), [0, 0, 0], []
    for _, _, role, text in rows:
        last = re.sub(f"[{WS}]+$", "", text)[-1:]
        kind = "blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"
        seen.add((role, text))
        if kind:
            faults[["blank", "duplicate", "truncated"].index(kind)] += 1
        codes.append((role[:1], kind))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {}
    for p in range(len(rows), -1, -1):
        now = {}
        for state in step:
            found = [(0, "")] if p == len(rows) and state in ("", "a") else []
            if p < len(rows):
                initial, kind = codes[p]
                after = lambda s: best[p + 1].get(s)  # noqa: B023, E731
                options = [("D", 2, state)]
                if kind not in ("blank", "duplicate"):
                    more = 5 if kind == "truncated" else 0
                    if initial in step[state]:
                        options.append(("K", more, step[state][initial]))
                    options += [("R", 1 + more, step[state][r]) for r in "ua" if r in step[state]]
                found += [(c + after(s)[0], letter + after(s)[1]) for letter, c, s in options if after(s)]
            if found:
                now[state] = min(found)
        for _ in range(4):
            for state in step:
                for r in "ua":
                    if r in step[state] and step[state][r] in now:
                        c, s = now[step[state][r]]
                        now[state] = min(now.get(state, (10**9, "")), (c + 5, "I" + s))
        best[p] = now
    cost, audit = best[0][""]
    lines, at, state = [], 0, ""
    for letter in audit:
        if letter == "I":
            state = next(r for r in "ua" if r in step[state])
            lines.append({"u": "user:", "a": "assistant:"}[state])
            continue
        _, _, role, text = rows[at]
        at += 1
        if letter == "D":
            continue
        if letter == "R":
            role = {"u": "user", "a": "assistant"}[next(r for r in "ua" if r in step[state])]
        state = step[state][role[0]]
        lines.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows, damaged=True):
    after = damage(rows) if damaged else [(c, t, *(" " if v is None else v for v in (r, x))) for c, t, r, x in rows]
    order = sorted(after, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    return {conv: plain([r for r in order if r[0] == conv]) for conv in {r[0] for r in rows}}


def got(df, **kw):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = C.repair(df, **kw).collect()
    out = {r["conv_id"]: tuple(r[c] for c in columns) for r in rows}
    assert len(out) == len(rows)
    return out


def some_rows(rng, conversations, longest=12):
    rows = []
    for conv in conversations:
        for turn in range(rng.randrange(0, 4), rng.randrange(1, longest)):
            role = rng.choices(["user", "assistant", "system", "tool", "User", "ustinov", "", None, "s"], [20, 20, 4, 2, 1, 1, 1, 1, 1])[0]
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", "It is so. \n\t", " \x0b", "", None, "é", "x." * 50, f"Line {turn}.", f"{rng.random()}?"])
            rows.append((conv, rng.choice([turn, turn, turn, turn, None]) if conv != 5 else None, role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("batch", [10_000, 7])
def test_same_as_plain_python(spark, batch):
    rng = random.Random(batch)
    rows = some_rows(rng, [*range(60), None]) + some_rows(rng, [1000], 3000)
    # of equal turns that are null, order is by role and text
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": C.F.lit("x"), "gone": C.F.lit(True)})
        assert got(df, damage=True) == expected(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_long_conversations_are_solved_from_their_parts(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "tool", "system"]), rng.choice(["A.", "B", f"{t}.", f"{t}.", f"{t}!"])) for t in range(2500)]
    rows += [(2, t, "tool", f"{t}") for t in range(1200)] + [(3, t, "user", "Same.") for t in range(1300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df) == expected(rows, damaged=False)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, 0, "system", "Be kind.")],
        [(1, 0, "user", "Hi.")],
        [(1, 0, "assistant", "Hi."), (1, 1, "user", "Hi.")],
        [(1, 0, "user", "cut"), (1, 1, "assistant", "Done.")],
        [(1, None, None, None), (None, None, None, None)],
        [(1, 5, "user", "Hi."), (1, 5, "user", "Hi."), (1, 9, "assistant", "Ho.")],
    ],
)
def test_edge_cases(spark, rows):
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows, damaged=False)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = C.op11_conversation_repair(spark, DIR).collect()
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r[c] for c in columns) for r in found} == expected(rows)
    assert any(r["cost"] for r in found) and len(found) == len({r[0] for r in rows})
