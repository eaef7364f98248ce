"""Chat formatting: tool calls and results are linked, ordered, checked against schemas and written as canonical JSON."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.shared import stored
from lintel.llm.words import columns, parts

#: How an assistant writes a call, and how a message of role `tool` writes a result: {"tool_call_id": ..., "content": ...}.
CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
#: An argument that is the result of an earlier call: {"$result": "<call id>"}.
REFERENCE = "$result"
#: References of a conversation up to which one task orders its calls; of more, every round settles calls by aggregation.
MOST_GATHERED = 200_000

#: What calls are checked against unless schemas are given: tool name -> JSON schema of its arguments.
TOOLS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces, characters as themselves; whole floats as integers. ValueError for NaN."""

    def even(x: Any) -> Any:
        if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
            return int(x)
        if isinstance(x, Mapping):
            return {str(k): even(v) for k, v in x.items()}
        return [even(v) for v in x] if isinstance(x, list) else x

    return json.dumps(even(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problems(value: Any, schema: Mapping, at: str = "$") -> list[str]:
    """What a JSON schema (types, enum, properties, required, items, bounds, patterns) finds wrong. References to results
    stand for any value."""
    if isinstance(value, dict) and set(value) == {REFERENCE}:
        return []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"number": is_number, "integer": is_number and float(value).is_integer() if is_number else False} | {k: isinstance(value, t) for k, t in _KINDS.items()}
    if kinds and not any(fits.get(k, False) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties", True) is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    sizes = [("minimum", value), ("maximum", value)] if is_number else [("minLength", len(value)), ("maxLength", len(value))] if isinstance(value, str) else [("minItems", len(value)), ("maxItems", len(value))] if isinstance(value, list) else []
    out += [f"{at}: {name}" for name, x in sizes if name in schema and (x < schema[name] if name.startswith("min") else x > schema[name])]
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: pattern")
    return out


def references(value: Any) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {REFERENCE}:
            return [str(value[REFERENCE])]
        return [x for v in value.values() for x in references(v)]
    return [x for v in value for x in references(v)] if isinstance(value, list) else []


def parse(role: str | None, text: str | None, tools: Mapping[str, Mapping]) -> list[tuple]:
    """(kind, call id, json, problems, references) of a message's parts: the message, then its calls; or a result."""
    role, text = role or "", text or ""
    if role == "tool":
        try:
            body = json.loads(text)
            if not isinstance(body, dict) or "tool_call_id" not in body:
                raise ValueError
            return [("result", str(body["tool_call_id"]), canonical({"content": body.get("content"), "role": "tool", "tool_call_id": str(body["tool_call_id"])}), [], [])]
        except (ValueError, RecursionError):
            return [("result", None, canonical({"content": text, "role": "tool"}), ["$: no tool_call_id"], [])]
    calls, plain = [], text
    if role == "assistant" and "<tool_call>" in text:
        plain = CALL.sub("", text).strip()
        for found in CALL.findall(text):
            try:
                body = json.loads(found)
                name, arguments = str(body["name"]), body.get("arguments", {})
                arguments = json.loads(arguments) if isinstance(arguments, str) else arguments
                wrong = problems(arguments, tools[name]) if name in tools else [f"$: unknown tool {name}"]
                calls.append(("call", str(body["id"]) if "id" in body else None, canonical({"arguments": arguments, "id": body.get("id"), "name": name}), wrong, references(arguments)))
            except (ValueError, KeyError, TypeError, RecursionError):
                calls.append(("call", None, canonical({"malformed": found}), ["$: malformed"], []))
    return [("message", None, canonical({"content": plain, "role": role}), [], []), *calls]


def settled(edges: list[tuple[str, int, str, int]]) -> Iterator[tuple[str, int, int, bool]]:
    """(call, rank, level, cycle) of all calls with references in edges (call, its turn, call it refers to, that one's turn).

    (rank, level) is the largest of (own turn, 0) and of (rank, level + 1) of all calls referred to. Calls are settled once
    none of their references is open; those that never are, are on a cycle or refer to one."""
    at = {c: (turn, 0) for call, own, ref, theirs in edges for c, turn in ((call, own), (ref, theirs))}
    refs, users = defaultdict(list), defaultdict(list)
    for call, _, ref, _ in edges:
        refs[call].append(ref)
        users[ref].append(call)
    waits = {c: len(x) for c, x in refs.items()}
    ready = [c for c in at if c not in refs]
    while ready:
        done = ready.pop()
        if done in refs:
            at[done] = max(at[done], *((at[x][0], at[x][1] + 1) for x in refs[done]))
        for c in users[done]:
            waits[c] -= 1
            if not waits[c]:
                ready.append(c)
    for c in refs:
        yield (c, at[c][0], 0, True) if waits[c] else (c, *at[c], False)


def peeled(edges: DataFrame) -> DataFrame:
    """What `settled` says, for conversations of any size: each round settles the calls without open references, by an
    aggregation and joins on the call, until there are none. Needs as many rounds as the longest chain has calls."""
    waiting = edges.select("conv_id", F.col("call_id").alias("ref"), F.lit(True).alias("waits")).distinct()
    left = stored(edges.join(waiting, ["conv_id", "ref"], "left").select("conv_id", "call_id", "own", "ref", F.col("theirs").alias("r"), F.lit(0).cast("long").alias("l"), F.col("waits").isNull().alias("ready")), "open")
    out = None
    while True:
        each = left.groupBy("conv_id", "call_id").agg(F.greatest(F.max(F.struct(F.col("r").alias("rank"), (F.col("l") + 1).alias("level"))), F.struct(F.max("own").alias("rank"), F.lit(0).cast("long").alias("level"))).alias("o"), F.min("ready").alias("ready"))
        done = stored(each.where("ready").select("conv_id", "call_id", "o.rank", "o.level"), "done")
        if done.first() is None:
            rest = left.groupBy("conv_id", "call_id").agg(F.max("own").alias("rank")).select("conv_id", "call_id", "rank", F.lit(0).cast("long").alias("level"), F.lit(True).alias("cycle"))
            return rest if out is None else out.union(rest)
        out = done.withColumn("cycle", F.lit(False)) if out is None else out.union(done.withColumn("cycle", F.lit(False)))
        known = done.select("conv_id", F.col("call_id").alias("ref"), "rank", "level")
        left = left.join(done, ["conv_id", "call_id"], "left_anti").join(known, ["conv_id", "ref"], "left")
        left = stored(left.select("conv_id", "call_id", "own", "ref", F.coalesce("rank", "r").alias("r"), F.coalesce("level", "l").alias("l"), (F.col("ready") | F.col("rank").isNotNull()).alias("ready")), "open")


def ordered(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, rank, level, cycle) of the calls with references; edges: conv_id, call_id, own, ref, theirs."""

    def run(found: pa.Table) -> pa.Table:
        rows = [*settled([*zip(*columns(found, "call_id", "own", "ref", "theirs"), strict=True)])]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
        held = [pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.table([pa.array([found.column("conv_id")[0].as_py()] * len(rows), pa.int64()), *held], ["conv_id", "call_id", "rank", "level", "cycle"])

    large = stored(edges.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_GATHERED).select("conv_id"), "large")
    out = edges.join(large, "conv_id", "left_anti").groupBy("conv_id").applyInArrow(run, "conv_id long, call_id string, rank long, level long, cycle boolean")
    return out if large.first() is None else out.union(peeled(edges.join(large, "conv_id", "left_semi")))


def chat(messages: DataFrame, tools: Mapping[str, Mapping] = TOOLS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each part of each message: conv_id, turn, part, kind (message, call, result), call_id, status, problems,
    level, place (array<long>), json.

    Calls and results meet in a hash join on (conv_id, call id); the first call with an id counts (by turn, then part).
    status: ok; duplicate (of a call's id); unanswered; orphan (a result without a call); invalid (malformed, unknown tool
    or arguments that the schema refuses); cycle. Rows of a conversation in the order of `place` are topologically
    ordered: a result stands behind its call, a call behind the calls whose results it refers to, and all else by turn and
    part. A call is a cycle if it is on one or refers, through other calls or not, to one that is; its level is 0. Only ids
    of calls with references are gathered, up to MOST_GATHERED of a conversation; beyond, see `peeled`. Messages and results
    never are, and results with a very common conversation or identifier split like any join. Null conversations, turns, roles and texts are kept: such calls are not linked
    (a null equals nothing), a null turn sorts first, a null text is empty. Repeated rows are parts of their own.
    """
    rows = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    held = dict(tools)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = [(c, t, i, *p) for c, t, r, x in zip(*columns(batch, "conv_id", "turn", "role", "text"), strict=True) for i, p in enumerate(parse(r, x, held))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "turn", "part", "kind", "call_id", "json", "problems", "refs"])

    found = rows.mapInArrow(run, "conv_id long, turn long, part int, kind string, call_id string, json string, problems array<string>, refs array<string>")
    linked = found.where("kind <> 'message'")
    calls = linked.where("kind = 'call' and call_id is not null and conv_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "part", "refs")).alias("c"), F.count("*").alias("n"))
    results = linked.where("kind = 'result' and call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("answers"))
    calls = stored(calls.join(results, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("c.turn").alias("call_turn"), F.col("c.part").alias("call_part"), F.col("c.refs").alias("call_refs"), "answers"), "calls")
    own = F.coalesce("call_turn", F.lit(-1)).cast("long")
    edges = calls.select("conv_id", "call_id", own.alias("own"), F.explode(F.array_distinct("call_refs")).alias("ref"))
    edges = edges.join(calls.select("conv_id", F.col("call_id").alias("ref"), own.alias("theirs")), ["conv_id", "ref"])
    calls = calls.drop("call_refs").withColumns({"rank": own, "level": F.lit(0).cast("long"), "cycle": F.lit(False)})
    if edges.first() is not None:
        order = ordered(stored(edges, "edges")).withColumnsRenamed({"rank": "_rank", "level": "_level", "cycle": "_cycle"})
        calls = calls.join(order, ["conv_id", "call_id"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("rank", "level", "cycle")}).drop("_rank", "_level", "_cycle")
    both = linked.join(calls.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    first = (F.col("kind") == "result") | (F.col("turn").eqNullSafe(F.col("call_turn")) & (F.col("part") == F.col("call_part")))
    status = (
        F.when(F.size("problems") > 0, "invalid")
        .when((F.col("kind") == "call") & F.col("call_id").isNull(), "invalid")
        .when(F.col("kind") == "result", F.when(F.col("call_part").isNull(), "orphan").otherwise("ok"))
        .when(~first, "duplicate")
        .when(F.col("cycle"), "cycle")
        .when(F.col("answers").isNull(), "unanswered")
        .otherwise("ok")
    )
    turn_ = F.coalesce("turn", F.lit(-1))
    base = F.when(first & F.col("rank").isNotNull(), F.greatest(turn_, F.col("rank"))).otherwise(turn_)
    step = F.when(first & F.col("rank").isNotNull() & (F.col("rank") >= turn_), 2 * F.col("level") + F.when(F.col("kind") == "result", 1).otherwise(0)).otherwise(F.lit(0))
    place = F.array(base, step.cast("long"), turn_, F.col("part").cast("long"))
    tied = both.select("conv_id", "turn", "part", "kind", "call_id", status.alias("status"), "problems", F.coalesce("level", F.lit(0)).alias("level"), place.alias("place"), "json")
    plain = found.where("kind = 'message'").select("conv_id", "turn", "part", "kind", "call_id", F.lit("ok").alias("status"), "problems", F.lit(0).cast("long").alias("level"), F.array(turn_, F.lit(0).cast("long"), turn_, F.col("part").cast("long")).alias("place"), "json")
    return plain.unionByName(tied)
