"""Chat formatting: tool calls linked with their results, ordered, validated, as canonical JSON.

A call is a row (conv_id, turn, call_id, name, arguments: JSON text, after: ids of calls that it
needs); a result is a row (call_id, turn, content). They are joined by id. The level of a call is
the length of the longest chain of calls that it needs: chains are passed by doubling pointers, so
rounds of joins grow with the logarithm of a chain, and calls that need several others are settled
round by round among themselves. A conversation of any length is spread over all tasks. Arguments are
validated against the JSON schema of the call's name, and each linked call is serialised as canonical
JSON: sorted keys, no spaces, no escapes but those that JSON needs.

Defined results: ids in ``after`` that no call has are reported and otherwise ignored; calls that
need themselves, directly or not, have no level; of several results with one id the least (turn,
content) counts; calls with repeated ids all stay and need what any of them does; arguments that are
no JSON object, or that hold NaN or infinite numbers, or nest deeper than a parser goes, are invalid
and are serialised as a string; lone surrogates are kept as JSON escapes; a null id links with
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import table
from assetloom.sources.scratch import stored

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def parsed(text: str | None):
    """The value of a JSON text, None for null and for all that is no JSON."""
    try:
        value = json.loads(text or "", parse_constant=_no_number)
        canonical(value)  # what is parsed may still be too deep to be written
    except (ValueError, RecursionError):
        return None
    return value


def is_a(value, kind: str) -> bool:
    """Whether a value is of a schema's type."""
    return isinstance(value, TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema: type (one or several), enum, required, properties,
    additionalProperties, items, minimum, maximum, minLength, maxLength."""
    kinds = schema.get("type") or []
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(is_a(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = [f"{at}: not one of enum"] if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        out += [e for i, x in enumerate(value) for e in violations(x, schema["items"], f"{at}[{i}]")]
    elif isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: too small"] * (value < schema.get("minimum", value)) + [f"{at}: too large"] * (value > schema.get("maximum", value))
    return out


def chain_ends(single: DataFrame) -> DataFrame:
    """(call_id, to, far) of ``single`` (call_id, to), where each call needs one other: the first call on
    its chain that isn't in ``single``, and how far it is. Chains without end are left out.

    Each round doubles the steps of the calls that haven't arrived.
    """
    now = stored(single.select("call_id", "to", F.lit(1).cast("long").alias("far")))
    most, steps, parts = now.count(), 1, []
    inner = stored(now.select(F.col("call_id").alias("to")))
    while True:
        parts.append(stored(now.join(inner, "to", "left_anti").select("call_id", "to", "far")))
        now = stored(now.join(inner, "to", "left_semi").select("call_id", "to", "far"))
        if steps > most or now.isEmpty():  # who walks longer than all calls are many goes round
            return reduce(DataFrame.union, parts)
        ahead = reduce(DataFrame.union, parts, now).select(F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"))
        now = stored(now.join(ahead, "to").select("call_id", F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far")))
        steps *= 2


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of the calls that need no chain without end."""
    ids = stored(calls.filter("call_id is not null").select("call_id").distinct())
    needs = calls.filter("call_id is not null").select("call_id", F.explode("after").alias("to")).distinct()
    needs = stored(needs.join(ids.select(F.col("call_id").alias("to")), "to", "left_semi").select("call_id", "to"))
    many = needs.groupBy("call_id").agg(F.count("*").alias("n"))
    ends = chain_ends(needs.join(many.filter("n = 1"), "call_id", "left_semi"))
    done = stored(ids.join(many, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level")))
    joints = stored(needs.join(many.filter("n > 1"), "call_id", "left_semi"))
    # where each need of a joint leads: to a joint or a call without needs
    led = joints.join(ends.select(F.col("call_id").alias("to"), F.col("to").alias("_end"), "far"), "to", "left")
    open_ = stored(led.select("call_id", F.coalesce("_end", "to").alias("to"), F.coalesce("far", F.lit(0)).alias("far")))
    while not open_.isEmpty():
        seen = open_.join(done.select(F.col("call_id").alias("to"), "level"), "to", "left")
        ready = seen.groupBy("call_id").agg(F.count("*").alias("n"), F.count("level").alias("known"), F.max(F.col("level") + F.col("far") + 1).alias("level")).filter("n = known")
        ready = stored(ready.select("call_id", "level"))
        if ready.isEmpty():
            break
        done = stored(done.union(ready))
        open_ = stored(open_.join(ready, "call_id", "left_anti").select("call_id", "to", "far"))
    on_chains = ends.join(done.select(F.col("call_id").alias("to"), "level"), "to").select("call_id", (F.col("level") + F.col("far")).alias("level"))
    return done.union(on_chains)


SERIAL = T.StructType([T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("json", T.StringType())])


def serialise_call(call_id: Column, name: Column, arguments: Column, result: Column, schemas: dict[str, dict]) -> Column:
    """struct(errors: where the arguments break the schema of the name; json: the canonical form)."""

    def one(i, n, text, res) -> dict:
        args = parsed(text)
        schema = schemas.get(n)
        errors = ["$: not an object"] if not isinstance(args, dict) else ["name: unknown"] if schema is None else violations(args, schema)
        return {"errors": errors, "json": canonical({"id": i, "name": n, "arguments": args if isinstance(args, dict) else text, "result": res})}

    def run(i: pa.Array, n: pa.Array, a: pa.Array, r: pa.Array) -> pa.Array:
        rows = zip(i.to_pylist(), n.to_pylist(), a.to_pylist(), r.to_pylist(), strict=True)
        return pa.array([one(*x) for x in rows], type=pa.struct([("errors", pa.list_(pa.string())), ("json", pa.string())]))

    run.__annotations__ = dict.fromkeys("inar", pa.Array) | {"return": pa.Array}
    return F.arrow_udf(run, returnType=SERIAL)(call_id, name, arguments, result)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: conv_id, turn, call_id, name, level, needs_missing, linked, valid, errors, json."""
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    answers = results.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    ids = calls.filter("call_id is not null").select(F.col("call_id").alias("need")).distinct()
    lost = calls.filter("call_id is not null").select("call_id", F.explode("after").alias("need")).distinct().join(ids, "need", "left_anti").groupBy("call_id").agg(F.count("*").alias("needs_missing"))
    linked = calls.join(answers, "call_id", "left").join(levels(calls), "call_id", "left").join(lost, "call_id", "left")
    out = linked.withColumn("s", serialise_call(F.col("call_id"), F.col("name"), F.col("arguments"), F.col("answer.content"), schemas))
    return out.select(
        "conv_id",
        "turn",
        "call_id",
        "name",
        F.col("level").cast("long").alias("level"),
        F.coalesce("needs_missing", F.lit(0)).cast("long").alias("needs_missing"),
        F.col("answer").isNotNull().alias("linked"),
        (F.size("s.errors") == 0).alias("valid"),
        F.array_join("s.errors", "; ").alias("errors"),
        F.col("s.json").alias("json"),
    )


#: The schemas of the calls that ``conversation_calls`` derives.
SCHEMAS = {"reply": {"type": "object", "required": ["question", "words"], "additionalProperties": False, "properties": {"question": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 3}, "turn": {"type": "integer", "minimum": 0}}}}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain conversations: each user turn calls ``reply``, the assistant turn
    after it is the result, and a call needs the user turn before it, two turns back."""
    id_of = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    question = F.coalesce("text", F.lit(""))
    args = F.to_json(F.struct(F.col("turn"), F.size(F.split(F.trim(question), r"\s+")).alias("words"), question.alias("question")))
    after = F.array(F.when(F.col("turn") >= 2, id_of(F.col("turn") - 2)))
    users = turns.filter("role = 'user'").select("conv_id", "turn", id_of(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), args.alias("arguments"), F.array_compact(after).alias("after"))
    results = turns.filter("role = 'assistant'").select(id_of(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return users, results


def op1_tool_calls(spark, sf_dir):
    """Every user turn of conversations as a call, linked with its reply."""
    users, results = conversation_calls(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return link_tool_calls(users, results, SCHEMAS)
