"""Operator 6: chat formatting with linked tool calls.

A message of an assistant may hold calls, a message of a tool a result, both as JSON:
    {"tool_calls": [{"id": "...", "name": "...", "arguments": {...} or a JSON string, "after": ["..."]}]}
    {"tool_call_id": "...", "content": ...}
Calls and results are hash-joined by conversation and identifier. A result follows its call, and a call
follows the calls that it names in `after` and their results. Messages are ordered topologically by
rounds of joins (Kahn): a message is placed once all that it follows are, at its own turn or at the
latest of theirs. Arguments are validated against the JSON schema of the tool, and every message becomes
one line of canonical JSON (sorted keys, no spaces, shortest numbers).

Work is by message, never by conversation: places in a conversation come from a range partition over
(conversation, order), so a conversation of any length spreads over tasks. The driver holds one
number for each range.

Edge cases: null conversation, turn, role or text are kept as null and sort first; equal turns are
ordered by role and text; text that isn't such JSON is plain content, and so is JSON nested deeper than
DEEPEST; a call without a string as id can't be linked, one without a string as name is a problem; of
calls with the same id in a conversation the first by turn counts; of several results each is linked;
messages that follow each other in a circle stay at their turns, each a problem; numbers beyond all
floats become null; halves of surrogate pairs are written as escapes.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, discard, materialize, partitions, slices

DEEPEST = 100
HALVES = re.compile("[\ud800-\udfff]")


def printable(text: str) -> str:
    """Halves of surrogate pairs, which UTF-8 can't hold, as JSON escapes."""
    return HALVES.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def shallow(value: object) -> bool:
    """Whether value is nested no deeper than DEEPEST."""
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > DEEPEST:
            return False
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
    return True


def canonical(value: object) -> str:
    """Canonical JSON: sorted keys, no spaces; whole floats as integers; NaN and infinities as null."""

    def plain(x: object) -> object:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            return None if not math.isfinite(x) else int(x) if x == int(x) and abs(x) < 2**53 else x
        return x if x is None or isinstance(x, (str, int)) else str(x)  # ids may be decimals or times

    return printable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
NESTED = ("not", "items", "additionalProperties", "propertyNames", "contains", "if", "then", "else")
NESTED_LISTS = ("anyOf", "oneOf", "allOf", "prefixItems")
NESTED_MAPS = ("properties", "patternProperties", "$defs", "definitions")
KEYWORDS = {
    *NESTED, *NESTED_LISTS, *NESTED_MAPS, "$ref", "type", "enum", "const", "required", "minProperties", "maxProperties", "minItems", "maxItems",
    "uniqueItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
    "title", "description", "default", "examples", "format", "$comment", "$schema", "$id", "deprecated", "readOnly", "writeOnly",
}


def checked(schema: object, name: str) -> None:
    """Raises ValueError where a schema has a keyword that `problems` doesn't know."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict) or (unknown := set(schema) - KEYWORDS):
        raise ValueError(f"schema of {name}: {sorted(unknown) if isinstance(schema, dict) else schema}")
    for part in [*(schema[k] for k in NESTED if k in schema), *(x for k in NESTED_LISTS for x in schema.get(k, ())), *(x for k in NESTED_MAPS for x in schema.get(k, {}).values())]:
        checked(part, name)


def number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def of_kind(value: object, kind: str) -> bool:
    if kind == "number":
        return number(value)
    if kind == "integer":
        return number(value) and math.isfinite(value) and value == int(value)
    return isinstance(value, KINDS[kind]) if kind in KINDS else False


def same(a: object, b: object) -> bool:
    """Equality of JSON values: true is not 1, but 1 is 1.0."""
    if number(a) and number(b):
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def referred(root: object, reference: str) -> object:
    """What "#/..." names in root; a schema that allows nothing if there is no such part."""
    if not reference.startswith("#"):
        return False
    for step in reference[1:].split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(root, dict) and step in root:
            root = root[step]
        elif isinstance(root, list) and step.isdigit() and int(step) < len(root):
            root = root[int(step)]
        else:
            return False
    return root


def problems(value: object, schema: object, path: str = "$", root: object = None, hops: int = 0) -> list[str]:
    """What in value breaks a schema (the keywords are listed in KEYWORDS; annotations and format say nothing)."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: nothing is allowed"]
    found = []
    inner = lambda v, part, at=path, n=0: problems(v, part, at, root, n)
    if "$ref" in schema:
        found += [f"{path}: endless reference"] if hops > DEEPEST else inner(value, referred(root, schema["$ref"]), path, hops + 1)
    kinds = schema.get("type")
    if kinds is not None and not any(of_kind(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [*found, f"{path}: not of type {kinds}"]
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        found.append(f"{path}: not one of the values")
    if "const" in schema and not same(value, schema["const"]):
        found.append(f"{path}: not the value")
    for part in schema.get("allOf", ()):
        found += inner(value, part)
    fitting = {k: sum(not inner(value, part) for part in schema[k]) for k in ("anyOf", "oneOf") if k in schema}
    if fitting.get("anyOf") == 0 or fitting.get("oneOf", 1) != 1:
        found.append(f"{path}: fits {'none' if 0 in fitting.values() else 'several'} of the schemas")
    if "not" in schema and not inner(value, schema["not"]):
        found.append(f"{path}: fits what it must not")
    if "if" in schema:
        found += inner(value, schema.get("else" if inner(value, schema["if"]) else "then", True))
    if isinstance(value, dict):
        properties, patterns, more = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
        found += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            found.append(f"{path}: wrong number of properties")
        for k in sorted(value):
            parts = ([properties[k]] if k in properties else []) + [p for x, p in patterns.items() if re.search(x, k)]
            for part in parts or ([more] if more is not False else []):
                found += inner(value[k], part, f"{path}.{k}")
            if not parts and more is False:
                found.append(f"{path}.{k}: unknown")
            if "propertyNames" in schema:
                found += inner(k, schema["propertyNames"], f"{path}.{k}")
    if isinstance(value, list):
        lead = schema.get("prefixItems", [])
        for i, v in enumerate(value):
            found += inner(v, lead[i] if i < len(lead) else schema.get("items", True), f"{path}[{i}]")
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            found.append(f"{path}: wrong number of items")
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            found.append(f"{path}: repeated items")
        if "contains" in schema and all(inner(v, schema["contains"]) for v in value):
            found.append(f"{path}: no fitting item")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            found.append(f"{path}: wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{path}: not of the pattern")
    if number(value):
        low, high, step = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum"), schema.get("multipleOf")
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value) or low is not None and value <= low or high is not None and value >= high:
            found.append(f"{path}: out of range")
        if step and not (math.isfinite(value) and abs(value / step - round(value / step)) < 1e-9):
            found.append(f"{path}: not a multiple")
    return found


def parsed(text: str | None) -> object:
    if not text or text.lstrip()[:1] != "{":
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if shallow(found) else None


def calls_of(role: str | None, text: str | None) -> list[dict]:
    if role != "assistant" or not isinstance(x := parsed(text), dict) or not isinstance(x.get("tool_calls"), list):
        return []
    return [c for c in x["tool_calls"] if isinstance(c, dict)]


def strings(value: object) -> list[str]:
    return [printable(x) for x in value if isinstance(x, str)] if isinstance(value, list) else []


def arguments_of(call: dict) -> object:
    given = call.get("arguments", {})
    if isinstance(given, str):
        try:
            found = json.loads(given)
        except (ValueError, RecursionError):
            return given
        return found if shallow(found) else given
    return given


def line_of(conv: object, turn: object, role: str | None, text: str | None, linked: bool, circular: bool, schemas: dict) -> tuple[str, int, int]:
    """Canonical line of a message, its number of calls and of problems."""
    out: dict = {"conversation": conv, "turn": turn, "role": role}
    calls = calls_of(role, text)
    wrong = ["follows itself"] if circular else []
    if calls:
        rows = []
        for c in calls:
            name, given = c.get("name"), arguments_of(c)
            schema = schemas.get(name) if isinstance(name, str) else None
            bad = [f"{name}: unknown tool"] if schema is None else problems(given, schema)
            wrong += bad
            rows.append({"id": c.get("id"), "name": name, "arguments": given, "valid": not bad} | ({"after": c["after"]} if "after" in c else {}))
        rest = {k: v for k, v in parsed(text).items() if k != "tool_calls"}
        out |= {"tool_calls": rows} | ({"content": rest.get("content")} if "content" in rest else {})
    elif role == "tool" and isinstance(x := parsed(text), dict) and "tool_call_id" in x:
        out |= {"tool_call_id": x["tool_call_id"], "content": x.get("content"), "linked": linked}
        wrong += [] if linked else ["no such call"]
    else:
        out["content"] = text
    return canonical(out), len(calls), len(wrong)


def link(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) of what a message follows, and the mids of results that have a call."""
    by = F.struct(F.col("turn"), F.col("mid"))
    calls = messages.select("conv_id", "turn", "mid", F.explode("call_ids").alias("call_id"))
    calls = calls.groupBy("conv_id", "call_id").agg(F.min(by).alias("at")).select("conv_id", "call_id", F.col("at.mid").alias("src"))
    calls = materialize(calls, "calls")
    on = lambda a, b, key: a["conv_id"].eqNullSafe(b["conv_id"]) & (a[key] == b["call_id"])
    answers = messages.where(F.col("result_of").isNotNull()).select("conv_id", "result_of", F.col("mid").alias("dst"))
    results = materialize(answers.join(calls, on(answers, calls, "result_of")).select(answers["conv_id"], "call_id", "src", "dst"), "results")
    waits = messages.select("conv_id", F.col("mid").alias("dst"), F.explode("after_ids").alias("named"))
    ends = calls.unionByName(results.select("conv_id", "call_id", F.col("dst").alias("src")))
    follows = waits.join(ends, on(waits, ends, "named")).select("src", "dst")
    edges = results.select("src", "dst").union(follows).where("src != dst").distinct()
    return materialize(edges, "edges"), results.select(F.col("dst").alias("mid")).distinct()


def order(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """mid, after, depth, circular of every message that stands at an edge, by rounds: those are placed next
    of which all that they follow are placed."""
    turns = messages.select("mid", "turn")
    ends = edges.select(F.col("src").alias("mid")).union(edges.select(F.col("dst").alias("mid"))).distinct()
    nodes = materialize(turns.join(ends, "mid"), "nodes")
    done = nodes.join(edges.select(F.col("dst").alias("mid")).distinct(), "mid", "left_anti").select("mid", F.col("turn").alias("after"), F.lit(0).alias("depth"), F.lit(False).alias("circular"))
    done, left = materialize(done, "placed"), edges
    while True:
        known = left.join(done.select(F.col("mid").alias("src"), "after", "depth"), "src", "left").groupBy("dst").agg(
            F.count("*").alias("n"), F.count("depth").alias("placed"), F.max(F.struct("after", "depth")).alias("last"))
        ready = materialize(known.where("n = placed").join(nodes, F.col("dst") == F.col("mid")).select(
            "mid", F.greatest("turn", "last.after").alias("after"),
            F.when(F.col("turn") > F.col("last.after"), 0).otherwise(F.col("last.depth") + 1).cast("int").alias("depth"), F.lit(False).alias("circular")), "ready")
        if not ready.limit(1).count():
            circles = left.select(F.col("dst").alias("mid")).distinct().join(nodes, "mid").select("mid", F.col("turn").alias("after"), F.lit(0).alias("depth"), F.lit(True).alias("circular"))
            return done.unionByName(circles)
        before, done = done, materialize(done.unionByName(ready), "placed")
        rest, left = left, materialize(left.join(ready.select(F.col("mid").alias("dst")), "dst", "left_anti").select("src", "dst"), "waiting")
        discard(before, ready, *([rest] if rest is not edges else []))


def format(df: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, role, position (from 0 in its conversation), line, n_calls, n_problems.

    schemas: JSON schema of the arguments by name of the tool; it goes to all tasks. A keyword that
    isn't known raises an error.
    """
    spark = df.sparkSession
    schemas = schemas or {}
    for name, schema in schemas.items():
        checked(schema, name)
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, result_of string, call_ids array<string>, after_ids array<string>"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for big in batches:
            for batch in slices(big):
                for conv, turn, role, text in zip(*(batch[i].to_pylist() for i in range(4)), strict=True):
                    x = parsed(text) if role == "tool" else None
                    of = x.get("tool_call_id") if isinstance(x, dict) else None
                    calls = calls_of(role, text)
                    after = {y for c in calls for y in strings(c.get("after"))}
                    out.add(conv, turn, role, text, printable(of) if isinstance(of, str) else None, strings([c.get("id") for c in calls]), sorted(after), size=len(text or ""))
                    if out.full():
                        yield out.take()
        yield from out.rest()

    messages = materialize(df.select("conv_id", "turn", "role", "text").mapInArrow(parse, schema).withColumn("mid", F.monotonically_increasing_id()), "messages")
    edges, answered = link(messages)
    placed = order(messages, edges)
    every = messages.drop("result_of", "call_ids", "after_ids").join(placed, "mid", "left").join(answered.withColumn("linked", F.lit(True)), "mid", "left").select(
        "conv_id", "turn", "role", "text", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("circular", F.lit(False)).alias("circular"),
        F.coalesce("after", "turn").alias("after"), F.coalesce("depth", F.lit(0)).alias("depth"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "after", "depth", "turn", "role", "text")]
    ordered = every.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id())
    lined = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, lane int, row bigint, line string, n_calls int, n_problems int"

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(lined)
        for big in batches:
            for batch in slices(big):
                for conv, turn, role, text, linked, circular, mid in zip(*(batch[i].to_pylist() for i in range(7)), strict=True):
                    line, n, bad = line_of(conv, turn, role, text, linked, circular, schemas)
                    out.add(conv, turn, role, mid >> 33, mid & ((1 << 33) - 1), line, n, bad, size=len(line))
                    if out.full():
                        yield out.take()
        yield from out.rest()

    rows = materialize(ordered.select("conv_id", "turn", "role", "text", "linked", "circular", "mid").mapInArrow(serialise, lined), "lines")
    found = sorted((r["lane"], r["n"]) for r in rows.groupBy("lane").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for lane, n in found:
        before += [F.lit(lane), F.lit(total).cast("bigint")]
        total += n
    place = F.element_at(F.create_map(*before), F.col("lane")) + F.col("row") if before else F.col("row")
    placed = rows.withColumn("place", place)
    first = placed.groupBy(F.col("conv_id").alias("c")).agg(F.min("place").alias("base"))
    return placed.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "turn", "role", (F.col("place") - F.col("base")).cast("bigint").alias("position"), "line", "n_calls", "n_problems"
    )
