"""Chat formatting with linked tool calls.

Messages are rows (conv_id, turn, role, text). An assistant text that is a JSON object with
`tool_calls` (a list of objects with `id`, `name` and `arguments`, or with these inside
`function`) makes calls; a text of role `tool` that is a JSON object with `tool_call_id` is a
result. Everything else is plain.

1. Each message is parsed once. The calls of a message are ordered topologically by the
   references in their arguments (a string "${id}" needs the result of call `id`; a cycle is
   reported and keeps the given order), and arguments are validated against the schema of
   their tool.
2. Calls and results are hash-joined by (conv_id, call id). Of calls that repeat an id the
   first (by turn, then place) owns it; of several results each is linked.
3. A result that stands before its call moves behind it: the pair (order_turn, order_step) is
   a topological order of the conversation; no conversation is gathered in one task.
4. Every message is serialised as canonical JSON (sorted keys, no blanks, UTF-8).

Only calls and results are shuffled; plain messages pass through. References order the calls of
one message; a reference to a call of another message moves nothing.

Defined results: null or empty text is a plain message with content null or ""; a null
conv_id or turn is kept, and its calls link with nothing; malformed JSON is plain text, and so
is JSON with NaN, an infinite number or more nesting than the parser takes; a lone surrogate
is written as its escape; ties in the order of calls go to the call given first; very long
texts are parsed whole; repeated rows appear repeatedly; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

PARSED = "conv_id long, turn long, role string, kind string, json string, result_of string, calls array<struct<id:string,name:string,place:int,problem:string>>, cyclic boolean"
REFERENCE = re.compile(r"\$\{([^}]+)\}")


SURROGATE = re.compile("[\ud800-\udfff]")


def plain_text(s: str) -> str:
    """s with lone surrogates as escapes, so that it has a UTF-8 form."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", s)


def canonical(value) -> str:
    return plain_text(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(x: str) -> float:
    value = float(x)
    if not math.isfinite(value):
        raise ValueError(f"{x} is no finite number")
    return value


def parsed_json(text: str):
    """The value of a JSON text; raises ValueError where it is none."""
    try:
        return json.loads(text, parse_float=_finite, parse_constant=_finite)
    except RecursionError as e:
        raise ValueError("too much nesting") from e


def violation(value, schema: dict, path: str = "$") -> str | None:
    """The first violation of a JSON schema (type, enum, required, properties, additionalProperties, items, bounds), or None."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    want = schema.get("type")
    if want is not None:
        for w in want if isinstance(want, list) else [want]:
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            if (w == "number" and number) or (w == "integer" and number and (isinstance(value, int) or value.is_integer())) or (w in kinds and isinstance(value, kinds[w])):
                break
        else:
            return f"{path}: type"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: enum"
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                found = violation(value[name], known[name], f"{path}.{name}")
            elif schema.get("additionalProperties", True) is False:
                found = f"{path}.{name}: unknown"
            elif isinstance(schema.get("additionalProperties"), dict):
                found = violation(value[name], schema["additionalProperties"], f"{path}.{name}")
            else:
                found = None
            if found:
                return found
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for k, x in enumerate(value):
            if found := violation(x, schema["items"], f"{path}[{k}]"):
                return found
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if ("minimum" in schema and value < schema["minimum"]) or ("maximum" in schema and value > schema["maximum"]):
            return f"{path}: bounds"
    return None


def _call(x) -> dict | None:
    if not isinstance(x, dict):
        return None
    inner = x.get("function") if isinstance(x.get("function"), dict) else x
    name, arguments = inner.get("name"), inner.get("arguments", {})
    if isinstance(arguments, str):
        try:
            arguments = parsed_json(arguments)
            canonical(arguments)
        except (ValueError, RecursionError):
            arguments = inner["arguments"]
    if not isinstance(name, str):
        return None
    return {"id": None if x.get("id") is None else str(x["id"]), "name": name, "arguments": arguments}


def ordered(calls: list[dict]) -> tuple[list[dict], bool]:
    """Calls in topological order of their references, first given first; whether there is a cycle."""
    own = {c["id"]: k for k, c in reversed(list(enumerate(calls))) if c["id"] is not None}
    needs = [{own[r] for r in REFERENCE.findall(canonical(c["arguments"])) if r in own} for c in calls]
    users: list[list[int]] = [[] for _ in calls]
    for k, own_needs in enumerate(needs):
        for n in own_needs:
            users[n].append(k)
    left, out = [len(n) for n in needs], []
    ready = [k for k, n in enumerate(left) if not n]
    while ready:
        k = heapq.heappop(ready)
        out.append(calls[k])
        for u in users[k]:
            left[u] -= 1
            if not left[u]:
                heapq.heappush(ready, u)
    return (out, False) if len(out) == len(calls) else (calls, True)


def parse_message(turn, role, text, schemas: dict) -> tuple[str, str, str | None, list[dict], bool]:
    """(kind, canonical JSON, id that a result answers, calls, cyclic)."""
    value = None
    if text and text.lstrip()[:1] == "{" and role in ("assistant", "tool"):
        try:
            value = parsed_json(text)
            canonical(value)
        except (ValueError, RecursionError):
            value = None
    if isinstance(value, dict) and role == "assistant" and isinstance(value.get("tool_calls"), list):
        calls = [c for c in map(_call, value["tool_calls"]) if c]
        if calls:
            calls, cyclic = ordered(calls)
            listed = []
            for k, c in enumerate(calls):
                schema = schemas.get(c["name"])
                listed.append({"id": None if c["id"] is None else plain_text(c["id"]), "name": plain_text(c["name"]), "place": k, "problem": ("unknown tool" if schemas else None) if schema is None else plain_text(violation(c["arguments"], schema) or "") or None})
            return "call", canonical({"content": value.get("content"), "role": role, "tool_calls": calls, "turn": turn}), None, listed, cyclic
    if isinstance(value, dict) and role == "tool" and value.get("tool_call_id") is not None:
        return "result", canonical({"content": value.get("content"), "role": role, "tool_call_id": str(value["tool_call_id"]), "turn": turn}), plain_text(str(value["tool_call_id"])), [], False
    return "plain", canonical({"content": text, "role": role, "turn": turn}), None, [], False


def format_chats(messages: DataFrame, workdir: str, schemas: dict | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, kind, order_turn, order_step, json, n_calls, n_answered, n_invalid, linked (results: is there a call), cyclic.

    schemas: {tool name: JSON schema}, a small parameter; without any, arguments are not judged.
    """
    ship(messages.sparkSession)
    known = dict(schemas or {})

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            conv, turn, role = b.column("conv_id"), b.column("turn"), b.column("role")
            rows = [parse_message(t, r, x, known) for t, r, x in zip(turn.to_pylist(), role.to_pylist(), b.column("text").to_pylist())]
            kind, text, result, calls, cyclic = zip(*rows)
            t = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("place", pa.int32()), ("problem", pa.string())]))
            yield pa.RecordBatch.from_arrays([conv, turn, role, pa.array(kind), pa.array(text, pa.string()), pa.array(result, pa.string()), pa.array(calls, t), pa.array(cyclic, pa.bool_())], ["conv_id", "turn", "role", "kind", "json", "result_of", "calls", "cyclic"])

    m = messages.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text")
    parsed = materialise(m.mapInArrow(run, PARSED), f"{workdir}/parsed")
    calls = parsed.where("kind = 'call'").withColumn("row", F.expr("uuid()"))
    calls = materialise(calls, f"{workdir}/calls")  # row names a repeated row apart
    each = calls.select("conv_id", "turn", "row", F.explode("calls").alias("c")).select("conv_id", "turn", "row", F.col("c.id").alias("call_id"), F.col("c.place").alias("place")).where("call_id is not null")
    owner = materialise(each.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place", "row")).alias("o")).select("conv_id", "call_id", F.col("o.turn").alias("call_turn"), F.col("o.place").alias("call_place"), F.col("o.row").alias("row")), f"{workdir}/owner")
    results = parsed.where("kind = 'result'").withColumn("call_id", F.col("result_of"))
    linked = results.join(owner.drop("row"), ["conv_id", "call_id"], "left")
    late = F.col("call_turn").isNotNull() & (F.col("turn") <= F.col("call_turn"))
    zero = F.lit(0).cast("long")
    answered = results.select("conv_id", "call_id").distinct().join(owner, ["conv_id", "call_id"]).groupBy("row").agg(F.count("*").alias("n_answered"))
    out_results = linked.select("conv_id", "turn", "role", "kind", F.when(late, F.col("call_turn")).otherwise(F.col("turn")).alias("order_turn"), F.when(late, F.col("call_place") + 1).otherwise(0).cast("long").alias("order_step"), "json", zero.alias("n_calls"), zero.alias("n_answered"), zero.alias("n_invalid"), F.col("call_turn").isNotNull().alias("linked"), "cyclic")
    out_calls = calls.join(answered, "row", "left").select("conv_id", "turn", "role", "kind", F.col("turn").alias("order_turn"), zero.alias("order_step"), "json", F.size("calls").cast("long").alias("n_calls"), F.coalesce("n_answered", zero).alias("n_answered"), F.size(F.filter("calls", lambda c: c["problem"].isNotNull())).cast("long").alias("n_invalid"), F.lit(False).alias("linked"), "cyclic")
    plain = parsed.where("kind = 'plain'").select("conv_id", "turn", "role", "kind", F.col("turn").alias("order_turn"), zero.alias("order_step"), "json", zero.alias("n_calls"), zero.alias("n_answered"), zero.alias("n_invalid"), F.lit(False).alias("linked"), "cyclic")
    return plain.unionByName(out_calls).unionByName(out_results)
