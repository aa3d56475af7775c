import json
import random
import re

from lathe.llm import chat, common, licenses


def plain_licenses(text):
    """Sections whose shingles a window has to 80 %, by going through all windows."""
    words = licenses.words_of_template(text or "")
    out = {}
    for section, name, t, c, grams in licenses.sections():
        _, width, step = licenses.CLASSES[c]
        best = None
        for w in range(len(words) // step + 1):
            at = [(k, " ".join(words[k : k + 3])) for k in range(w * step, min(w * step + width, len(words)) - 2)]
            have = [(k, g) for k, g in at if g in grams]
            share = len({g for _, g in have}) / len(grams)
            if share >= 0.8 and (best is None or (-share, have[0][0]) < best):
                best = (-share, have[0][0])
        if best:
            out[section] = (name, t, round(-best[0], 6), best[1])
    return out


def license_rows():
    rnd = random.Random(3)
    noise = lambda n: " ".join(rnd.choice(["the", "license", "of", "you", "may", "under", "version", "thé", "x1"]) for _ in range(n))
    rows = []
    for k, (_, text) in enumerate(licenses.TEMPLATES * 4):
        words = text.split()
        if k % 4 == 1:
            words[rnd.randrange(len(words))] = "changed"
        if k % 4 == 2:
            words = words[: len(words) // 2]
        rows.append((k, noise(rnd.randrange(60)) + "\n" + " ".join(words).upper() + " -- " + noise(rnd.randrange(60))))
    rows += [(500, " ".join(t for _, t in licenses.TEMPLATES)), (501, None), (502, ""), (503, "w " * 50_000 + "Released under the MIT License."), (504, "MIT License")]
    return rows


def test_license_query_against_all_windows(spark, tmp_path):
    rows = license_rows()
    extra = [(600, "Released under the MIT License"), (600, "Released under the MIT License"), (None, "Licensed under CC BY-NC 4.0!")]
    df = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, section string")
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op4_license_scan(spark, str(tmp_path)).collect()
    want = [(i, s, *v) for i, t in rows + [extra[0], extra[2]] for s, v in plain_licenses(t).items()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.section, r.license, r.template, r.containment, r.first_word) for r in got), key=key) == sorted(want, key=key)
    assert len(want) > 60
    assert licenses.scan(df.limit(0)).count() == 0


def test_sections_fit_their_windows():
    for _, _, _, c, grams in licenses.sections():
        most, width, step = licenses.CLASSES[c]
        assert most <= width - step + 1 and 1 <= len(grams) <= most - 2


def call(i, name, arguments, **more):
    return {"id": i, "name": name, "arguments": arguments, **more}


def test_tool_calls_are_linked_ordered_and_validated(spark):
    calls = [
        call("c", "calculate", {"expression": "1+1"}, depends_on=["b"]),
        call("b", "search", {"query": "é \"x\"", "limit": 3}, depends_on=["a", "unknown"]),
        call("a", "get_weather", {"days": 2, "city": "Oslo"}),
    ]
    rows = [
        (1, 0, "user", "hello\n\"you\""),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "early"})),
        (1, 2, "assistant", json.dumps({"content": "wait", "tool_calls": calls})),
        (1, 3, "tool", json.dumps({"content": "late", "tool_call_id": "b"})),
        (1, 4, "tool", json.dumps({"content": "lost", "tool_call_id": "zz"})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("x", "search", {"query": 5}, depends_on=["y"]), call("y", "search", {"query": "q", "more": 1}, depends_on=["x"]), call("w", "nope", {}), call("v", "search", None)]})),
        (2, 1, "tool", None),
        (None, 0, "user", "{not json"),
        (None, 1, "assistant", "{\"a\": 1}"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int").repartition(3)
    got = sorted(chat.formatted(df).collect(), key=lambda r: (r.conv or 0, r.position))
    view = [(r.conv, r.position, r.turn, r.role, r.n_calls, r.n_linked, r.n_valid) for r in got]
    assert view == [
        (None, 0, 0, "user", 0, 0, 0),
        (None, 1, 1, "assistant", 0, 0, 0),
        (1, 0, 0, "user", 0, 0, 0),
        (1, 1, 2, "assistant", 3, 2, 3),
        (1, 2, 1, "tool", 0, 1, 0),
        (1, 3, 3, "tool", 0, 1, 0),
        (1, 4, 4, "tool", 0, 0, 0),
        (2, 0, 0, "assistant", 4, 0, 0),
        (2, 1, 1, "tool", 0, 0, 0),
    ]
    message = json.loads(got[3].message)
    assert [c["id"] for c in message["tool_calls"]] == ["a", "b", "c"] and message["content"] == "wait"
    assert message["tool_calls"][1]["arguments"] == {"query": "é \"x\"", "limit": 3}
    for r in got:
        value = json.loads(r.message)
        assert json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.message
    assert json.loads(got[0].message) == {"role": "user", "content": "{not json"}


def test_first_of_several_calls_and_results_is_linked(spark):
    result = lambda text, **more: json.dumps({"tool_call_id": "1", "content": text, **more})
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [call("1", "calculate", {"expression": "1"}), call("1", "calculate", {"expression": "2"})]})),
        (1, 1, "assistant", json.dumps({"tool_calls": [call("1", "calculate", {"expression": "3"})], "note": {"z": [1, None], "b": "é'\\"}, "at": None})),
        (1, 2, "tool", result("one", note="kept", aaa=1.5)),
        (1, 3, "tool", result("two")),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.formatted(df).collect(), key=lambda r: r.position)
    assert [(r.turn, r.n_calls, r.n_linked) for r in got] == [(0, 2, 1), (1, 1, 0), (2, 0, 1), (3, 0, 0)]
    messages = [json.loads(r.message) for r in got]
    assert messages[1]["note"] == {"z": [1, None], "b": "é'\\"} and messages[1]["at"] is None
    assert messages[2] == {"aaa": 1.5, "content": "one", "note": "kept", "role": "tool", "tool_call_id": "1"}
    for r, m in zip(got, messages):
        assert json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.message


def test_levels_of_long_chains_and_cycles(spark):
    rows = [(1, f"c{k}", [f"c{k - 1}"] if k else None) for k in range(6)] + [(1, "x", ["y", "c0"]), (1, "y", ["x"]), (1, "behind", ["x"]), (None, "n", ["c0"]), (2, "c1", ["c0", "c1"])]
    df = spark.createDataFrame(rows, "conv long, id string, depends_on array<string>")
    got = {(r.conv, r.id): r.level for r in chat.levels(df).collect()}
    assert got == {**{(1, f"c{k}"): k for k in range(6)}, (1, "x"): None, (1, "y"): None, (1, "behind"): None, (None, "n"): 0, (2, "c1"): None}


def test_messages_that_share_a_conversation(spark):
    rnd = random.Random(1)
    rows = [(7, rnd.randrange(50), "user", f"t{rnd.randrange(20)}") for _ in range(3000)] + [(k % 90, k, "user", "x") for k in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = chat.formatted(df).collect()
    for conv in {r[0] for r in rows}:
        mine = sorted(((r.position, r.turn, json.loads(r.message)["content"]) for r in got if r.conv == conv))
        assert [m[1:] for m in mine] == sorted((t, x) for c, t, _, x in rows if c == conv)
        assert [m[0] for m in mine] == list(range(len(mine)))
    assert chat.formatted(df.limit(0)).count() == 0


def test_ranked_is_stable_for_nulls(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, 2), (None, 1), (1, None), (1, 5)], "k long, v long")
    got = sorted(((r.k or 0, r.at, r.v) for r in common.ranked(df, ["k"], [F.col("v")], "at").collect()), key=lambda r: r[:2])
    assert got == [(0, 0, 1), (0, 1, 2), (1, 0, None), (1, 1, 5)]


def test_plans_have_no_python(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for query in (licenses.op4_license_scan, chat.op9_chat_format):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|ArrowEval|CartesianProduct", plan)
