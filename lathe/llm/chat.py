"""Chat formatting with tool-call linking (operator 9). DataFrame functions only.

Messages: a row each, with conversation, turn, role and text. An assistant's text that is a JSON object
with `tool_calls` holds calls (id, name, arguments, and optionally depends_on: ids of calls whose
results it needs); a tool's text that is a JSON object with `tool_call_id` is a result. Calls and results meet
in a hash join on (conversation, id). Calls get their level in the order of dependencies round by
round: a call is ready when all that it depends on are, and its level is one more than theirs; calls
that never become ready are in a cycle or depend on one. Messages are ordered by turn; a result comes
no earlier than its call, and calls of a turn by level. Arguments are validated against the schemas of
the tools, and each message is serialised as canonical JSON: sorted keys, no blanks.

Positions within a conversation come from sums over sorted range partitions (`common.ranked`), so a
conversation with a third of all messages is spread over many tasks.

Edge cases: null text has no content; text that isn't such JSON is content as it is; calls without an
id or name and results without a call are marked unlinked; of several calls or results of an id only the
first is linked (by turn, then by text; messages that repeat alike share it); other fields of a message's
JSON stay, sorted in; null conversations are one conversation; rows that repeat are
messages each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import common

#: Tool: parameter: (type, required). Types as in JSON schemas.
Tools = dict[str, dict[str, tuple[str, bool]]]
TOOLS: Tools = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "get_weather": {"city": ("string", True), "days": ("integer", False)},
    "calculate": {"expression": ("string", True)},
}
#: What `schema_of_variant` says of a value of each type begins with one of these.
_KINDS = {
    "string": ("STRING",),
    "integer": ("BIGINT", "INT", "SMALLINT", "TINYINT"),
    "number": ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}
#: Fields with a place of their own in the output.
_PLACED = ("content", "role", "tool_call_id", "tool_calls")
_CALL = "array<struct<id:string,name:string,arguments:variant,depends_on:array<string>>>"


def parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """_conv, _turn, _role, _text, _calls (array; null if none), _result (a result's call id), _content, and
    _more: key and value (as JSON) of all other fields of a message that holds calls or a result."""
    looks = F.trim(F.col(text)).startswith("{")
    rows = messages.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text"), F.when(looks, F.try_parse_json(text)).alias("_v"))
    calls = F.when(F.col("_role") == "assistant", F.try_variant_get("_v", "$.tool_calls", _CALL))
    result = F.when(F.col("_role") == "tool", F.try_variant_get("_v", "$.tool_call_id", "string"))
    rows = rows.select("_conv", "_turn", "_role", "_text", "_v", F.when(F.size(calls) > 0, calls).alias("_calls"), result.alias("_result"))
    special = F.col("_calls").isNotNull() | F.col("_result").isNotNull()
    content = F.when(special, F.try_variant_get("_v", "$.content", "string")).otherwise(F.col("_text"))
    fields = F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>"))
    more = F.transform(F.filter(fields, lambda e: ~e["key"].isin(*_PLACED)), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value")))
    return rows.withColumns({"_content": content, "_more": F.when(special, more)}).drop("_v")


def valid_arguments(name: Column, arguments: Column, tools: Tools) -> Column:
    """Whether a call names a tool and its arguments have all required parameters, no unknown ones, and the right types."""
    as_text = F.to_json(arguments)
    keys = F.when(as_text.startswith("{"), F.json_object_keys(as_text))
    out = F.lit(False)
    for tool, parameters in tools.items():
        ok = keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, parameters)).cast("array<string>"))) == 0)
        for p, (kind, required) in parameters.items():
            value = F.try_variant_get(arguments, f"$['{p}']", "variant")
            said = F.schema_of_variant(value)
            right = F.coalesce(sum((said.startswith(k).cast("int") for k in _KINDS[kind]), F.lit(0)) > 0, F.lit(False))
            ok = ok & (right if required else (right | ~F.array_contains(keys, p)))
        out = F.when(name == tool, F.coalesce(ok, F.lit(False))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def levels(calls: DataFrame) -> DataFrame:
    """calls: conv, id (each pair once), depends_on. Returns conv, id, level: 0 for calls that depend on nothing,
    else one more than the highest level they depend on; null in or behind a cycle. Unknown ids don't count.

    A round for each level: dependencies on calls that have just become ready go, and calls that have none left
    are ready next. Each round writes only the dependencies that remain and the calls that are ready."""
    names = calls.select(F.col("conv").alias("_c"), F.col("id").alias("_i"))
    needs = calls.select("conv", "id", F.explode("depends_on").alias("need")).distinct()
    edges = common.durable(needs.join(names, needs["conv"].eqNullSafe(names["_c"]) & (needs["need"] == names["_i"])).select("conv", "id", "need"), "needs")
    known = calls.select("conv", "id")
    fresh = _null_safe(known, edges.select("conv", "id").distinct(), "left_anti")
    done = [fresh.withColumn("level", F.lit(0))]
    while edges.limit(1).count():
        ready = fresh.select(F.col("conv").alias("_c"), F.col("id").alias("_i"))
        left = common.durable(edges.join(ready, edges["conv"].eqNullSafe(ready["_c"]) & (edges["need"] == ready["_i"]), "left_anti"), "needs")
        fresh = common.durable(_null_safe(edges.select("conv", "id").distinct(), left.select("conv", "id").distinct(), "left_anti"), "ready")
        if not fresh.limit(1).count():
            break
        done.append(fresh.withColumn("level", F.lit(len(done))))
        edges = left
    return _null_safe(known, reduce(DataFrame.unionByName, done), "left")


def _null_safe(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """a joined with b on conv (null-safe) and id."""
    other = b.withColumnsRenamed({"conv": "_c", "id": "_i"})
    out = a.join(other, a["conv"].eqNullSafe(other["_c"]) & (a["id"] == other["_i"]), how)
    return out if how == "left_anti" else out.drop("_c", "_i")


def formatted(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tools: Tools | None = None) -> DataFrame:
    """A row for each message: conv, turn, position (from 0), role, message (canonical JSON), n_calls, n_linked, n_valid.
    For a result, n_linked is 1 if its call is known. Unlinked calls and results keep their place by turn."""
    tools = TOOLS if tools is None else tools
    rows = parsed(messages, conv, turn, role, text).withColumn("_key", F.xxhash64("_conv", "_turn", "_role", "_text"))
    special = common.durable(rows.where(F.col("_calls").isNotNull() | F.col("_result").isNotNull()).dropDuplicates(["_key"]), "tool-messages")
    calls = special.where("_calls is not null").select(F.col("_conv").alias("conv"), F.col("_turn").alias("turn"), F.col("_text").alias("text"), "_key", F.posexplode("_calls").alias("k", "c")).select("conv", "turn", "text", "_key", "k", "c.*")
    results = special.where("_result is not null").groupBy(F.col("_conv").alias("_rc"), F.col("_result").alias("_rid")).agg(F.min(F.struct("_turn", "_text")).alias("_first_result"))
    place = F.struct("turn", "text", "k")
    whole = calls.where("id is not null and name is not null")
    whole = common.durable(whole.groupBy("conv", "id").agg(F.min_by("depends_on", place).alias("depends_on"), F.min(place).alias("_first_call")), "calls")
    firsts = whole.select(F.col("conv").alias("_fc"), F.col("id").alias("_fid"), "_first_call")
    level = levels(whole.select("conv", "id", "depends_on")).withColumnsRenamed({"conv": "_lc", "id": "_lid"})
    checked = calls.join(level, calls["conv"].eqNullSafe(F.col("_lc")) & (calls["id"] == F.col("_lid")), "left")
    checked = checked.join(results, checked["conv"].eqNullSafe(F.col("_rc")) & (checked["id"] == F.col("_rid")), "left")
    checked = checked.join(firsts, checked["conv"].eqNullSafe(F.col("_fc")) & (checked["id"] == F.col("_fid")), "left")
    linked = F.col("_first_result").isNotNull() & F.coalesce(place.eqNullSafe(F.col("_first_call")), F.lit(False))
    checked = checked.withColumn("valid", valid_arguments(F.col("name"), F.col("arguments"), tools)).withColumn("linked", linked)
    text_of = F.struct(F.coalesce("level", F.lit(2**30)).alias("level"), "k", F.to_json("arguments").alias("arguments"), "id", "name", "linked", "valid")
    per_message = checked.groupBy(F.col("_key").alias("_ck")).agg(F.sort_array(F.collect_list(text_of)).alias("_sorted"))
    owner = whole.select(F.col("conv").alias("_oc"), F.col("id").alias("_oid"), F.col("_first_call.turn").alias("_call_turn"), F.lit(True).alias("_known"))
    extra = special.select("_key", "_conv", "_turn", "_text", "_result").join(per_message, F.col("_key") == F.col("_ck"), "left")
    extra = extra.join(owner, F.col("_conv").eqNullSafe(F.col("_oc")) & (F.col("_result") == F.col("_oid")), "left")
    extra = extra.join(results, F.col("_conv").eqNullSafe(F.col("_rc")) & (F.col("_result") == F.col("_rid")), "left")
    answers = F.coalesce(F.col("_known") & F.struct("_turn", "_text").eqNullSafe(F.col("_first_result")), F.lit(False))
    extra = extra.select(F.col("_key").alias("_xk"), "_sorted", "_call_turn", answers.alias("_answers"))
    placed = rows.drop("_calls").join(extra, F.col("_key") == F.col("_xk"), "left").drop("_xk", "_key")
    late = F.greatest(F.col("_turn"), F.coalesce("_call_turn", F.col("_turn")))
    is_result = F.col("_result").isNotNull()
    one = F.transform("_sorted", lambda c: F.concat(F.lit('{"arguments":'), F.coalesce(c["arguments"], F.lit("null")), F.lit(',"id":'), _quoted(c["id"]), F.lit(',"name":'), _quoted(c["name"]), F.lit("}")))
    calls_text = F.when(F.col("_sorted").isNotNull(), F.concat(F.lit("["), F.array_join(one, ","), F.lit("]")))
    placed_fields = {"content": _quoted(F.col("_content")), "role": _quoted(F.col("_role")), "tool_call_id": _quoted(F.col("_result")), "tool_calls": calls_text}
    given = {"content": F.col("_content"), "role": F.col("_role"), "tool_call_id": F.col("_result"), "tool_calls": calls_text}
    pairs = F.array_compact(F.array(*(F.when(given[k].isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in placed_fields.items())))
    pairs = F.when(F.size("_more") > 0, F.sort_array(F.concat(pairs, F.col("_more")))).otherwise(pairs)
    message = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(_quoted(p["key"]), F.lit(":"), p["value"])), ","), F.lit("}"))
    how_many = lambda part: F.coalesce(F.size(F.filter("_sorted", lambda c: c[part])), F.lit(0))
    linked = F.when(is_result, F.col("_answers").cast("int")).otherwise(F.when(F.col("_sorted").isNull(), 0).otherwise(how_many("linked")))
    out = placed.select(
        F.col("_conv").alias("conv"),
        F.col("_turn").alias("turn"),
        late.alias("_late"),
        is_result.alias("_is_result"),
        F.col("_role").alias("role"),
        F.col("_text").alias("_text"),
        message.alias("message"),
        F.when(F.col("_sorted").isNull(), 0).otherwise(F.size("_sorted")).cast("long").alias("n_calls"),
        linked.cast("long").alias("n_linked"),
        F.when(F.col("_sorted").isNull(), 0).otherwise(how_many("valid")).cast("long").alias("n_valid"),
    )
    out = common.ranked(out, ["conv"], [F.col("_late"), F.col("_is_result"), F.col("turn"), F.col("role"), F.col("_text")], "position")
    return out.select("conv", "turn", "position", "role", "message", "n_calls", "n_linked", "n_valid")


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(text.alias("s")))
    return F.when(text.isNull(), F.lit("null")).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of all conversations, in order, as canonical JSON."""
    return formatted(common.table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


#: The tables have no tool calls; without them, order and serialisation remain.
ORACLE_SQL = """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position, role,
  CASE WHEN text IS NULL THEN json_object('role', role) ELSE json_object('content', text, 'role', role) END::VARCHAR AS message,
  0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_valid
FROM conversations
"""
