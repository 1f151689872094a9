"""Tool-call linking for chat formatting.

Calls and results meet in a hash join on their identifier. A call may name calls that have to come before it; its step
is the length of the longest chain of such calls before it. In each round calls whose predecessors are settled settle,
and a predecessor that waits for one call only is passed over (pointer jumping), so that chains take rounds that grow with
the logarithm of their length, other graphs at most as many as their longest chain; no conversation is gathered in one
task however long it is. (step, pos) is a topological order of a conversation's calls. Arguments are checked against a
schema for each tool, and call and result are serialised as canonical JSON: keys sorted, no spaces, characters as they are.

Defined cases: of calls with the same identifier the first counts (by pos, ties by name and arguments); of results
likewise (by pos, ties by content); a call without a result is not linked, a result without a call gives no row; named
calls that are missing count as none; calls on a cycle, and those that wait for one, get step -1; arguments that are
null or no JSON are not valid, nor are NaN, infinities and arguments nested too deep to be read, and are null in the text; calls without an identifier give no row; very long texts are serialised whole; columns
that are not named here are not looked at; an empty table gives an empty result.

Of plain conversations every turn is in the result: see format_conversations.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.util import materialize, small_batches

#: Above the length of any chain; what goes round a cycle stays at it.
MOST_STEPS = 1 << 40

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def schema_error(value, schema: dict, at: str = "$") -> str | None:
    """The first violation of a schema (type, enum, properties, required, additionalProperties, items, minimum, maximum, minLength)."""
    kinds = schema.get("type")
    whole = isinstance(value, float) and value.is_integer()  # 1.0 is an integer to a schema
    if kinds and not any((isinstance(value, TYPES[k]) or k == "integer" and whole) and not (k in ("integer", "number") and isinstance(value, bool)) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not {kinds}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the listed"
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        return f"{at}: too short"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{at}: out of range"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if error := schema_error(value[name], known[name], f"{at}.{name}"):
                    return error
            elif schema.get("additionalProperties") is False:
                return f"{at}.{name}: not known"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if error := schema_error(x, schema["items"], f"{at}[{i}]"):
                return error
    return None


def canonical(value) -> str:
    """JSON with sorted keys, without spaces; a number too large for a double has no form in JSON and raises."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def steps(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, step): the longest chain of calls before it; -1 on or behind a cycle. calls: distinct conv_id, call_id, with after (an identifier, or an array of them)."""
    after = F.col("after") if calls.schema["after"].dataType.typeName() == "array" else F.array("after")
    known = calls.select("conv_id", F.col("call_id").alias("up"))
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct(after)).alias("up")).join(known, ["conv_id", "up"], "left_semi")
    edges = edges.groupBy("conv_id", "call_id").agg(F.collect_list(F.struct("up", F.lit(1).cast("bigint").alias("w"))).alias("ups"))
    nothing = F.expr("cast(array() as array<struct<up:string,w:bigint>>)")
    now = calls.select("conv_id", "call_id").join(edges, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.lit(0).cast("bigint").alias("base"), F.coalesce("ups", nothing).alias("ups"))
    now = materialize(now, "steps")
    waiting, before = now.filter("size(ups) > 0").count(), None
    while waiting and waiting != before:  # some call settles in each round, unless all that wait do so for a cycle
        open_ = now.select("conv_id", "call_id", F.explode("ups").alias("e")).select("conv_id", "call_id", "e.*")
        beyond = now.select("conv_id", F.col("call_id").alias("up"), F.col("base").alias("there"), F.col("ups").alias("next"))
        alone = F.col("next")[0]
        further = F.when(F.size("next") == 0, nothing).when(F.size("next") == 1, F.array(F.struct(alone["up"].alias("up"), F.least(F.col("w") + alone["w"], F.lit(MOST_STEPS)).alias("w")))).otherwise(F.array(F.struct("up", "w")))
        found = open_.join(beyond, ["conv_id", "up"]).groupBy("conv_id", "call_id").agg(F.max(F.least(F.col("there") + F.col("w"), F.lit(MOST_STEPS))).alias("more"), F.flatten(F.collect_list(further)).alias("left"))
        now = now.join(found, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.greatest("base", F.coalesce("more", F.lit(0))).alias("base"), F.coalesce("left", nothing).alias("ups"))
        now = materialize(now, "steps")
        before, waiting = waiting, now.filter("size(ups) > 0").count()
    return now.select("conv_id", "call_id", F.when(F.size("ups") == 0, F.col("base")).otherwise(-1).alias("step"))


def _first(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of the rows with one identifier that with the smallest pos."""
    rows = rows.filter("conv_id is not null and call_id is not null")
    return rows.groupBy("conv_id", "call_id").agg(F.min(F.struct("pos", *columns)).alias("x")).select("conv_id", "call_id", "x.*")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: conv_id, call_id, pos, name, arguments (JSON), after (an identifier, or an array of them); results: conv_id, call_id, pos, content.

    Per call: conv_id, step, pos, call_id, name, linked, valid, error, json.
    """
    small_batches(calls.sparkSession)
    calls = materialize(_first(calls, ["name", "arguments", "after"]), "calls")
    results = _first(results, ["content"]).select("conv_id", "call_id", "content", F.lit(True).alias("linked"))
    linked = calls.join(results, ["conv_id", "call_id"], "left").join(steps(calls), ["conv_id", "call_id"])
    rows = linked.select("conv_id", "step", "pos", "call_id", "name", F.coalesce("linked", F.lit(False)).alias("linked"), "arguments", "content")
    shown = "conv_id bigint, step bigint, pos bigint, call_id string, name string, linked boolean, valid boolean, error string, json string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, texts = [], []
            for step, call, name, given, content in zip(*(batch.column(c).to_pylist() for c in ("step", "call_id", "name", "arguments", "content"))):
                shown_call = {"id": call, "name": name, "result": content, "step": step}
                try:
                    arguments = json.loads(given, parse_constant=_no_number)
                    error = schema_error(arguments, schemas[name]) if name in schemas else "no such tool"
                    text = canonical({"arguments": arguments, **shown_call})
                except (TypeError, ValueError, RecursionError) as e:
                    error = "arguments are too deep" if isinstance(e, RecursionError) else "arguments are no JSON"
                    text = canonical({"arguments": None, **shown_call})
                errors.append(error)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([e is None for e in errors]), pa.array(errors, pa.string()), pa.array(texts, pa.string())], [f.split(" ")[0] for f in shown.split(", ")])

    typed = rows.select(F.col("conv_id").cast("bigint"), "step", F.col("pos").cast("bigint"), "call_id", "name", "linked", "arguments", "content")
    return typed.mapInArrow(run, shown)


#: The one tool of plain conversations: a user's turn asks for a reply.
REPLY = {"reply": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}}, "required": ["text"], "additionalProperties": False}}


def format_conversations(turns: DataFrame) -> DataFrame:
    """Plain conversations: calls with their results as in link_calls, and all other turns as messages (call_id, name and step null).

    Turn t of a user calls `reply`, after the user's turn t - 2; the assistant's turn t + 1 is its result. Every other turn is
    a message with its own row: of the system or any other role, of the assistant without a user's turn right before it,
    without a role, a number or a conversation. A message is valid if it has a role and a text.
    """
    name = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    turns = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    placed = "conv_id is not null and turn is not null"
    calls = turns.filter(f"role = 'user' and {placed}").select("conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").alias("pos"), F.lit("reply").alias("name"), F.to_json(F.struct("text")).alias("arguments"), name(F.col("turn") - 2).alias("after"))
    results = turns.filter(f"role = 'assistant' and {placed}").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    alone = results.join(calls.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select("conv_id", "pos", F.lit("assistant").alias("role"), F.col("content").alias("text"))
    others = turns.filter(f"not coalesce(role in ('user', 'assistant') and {placed}, false)").select("conv_id", F.col("turn").alias("pos"), "role", "text")
    return link_calls(calls, results, REPLY).unionByName(_messages(alone.unionByName(others)), allowMissingColumns=True)


def _messages(rows: DataFrame) -> DataFrame:
    """conv_id, pos, linked, valid, json of plain messages; rows: conv_id, pos, role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [canonical({"content": text, "role": role}) for role, text in zip(*(batch.column(c).to_pylist() for c in ("role", "text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string())], ["conv_id", "pos", "linked", "valid", "json"])

    valid = F.col("role").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0)
    rows = rows.select("conv_id", "pos", F.lit(False).alias("linked"), valid.alias("valid"), "role", "text")
    return rows.mapInArrow(run, "conv_id bigint, pos bigint, linked boolean, valid boolean, json string")
