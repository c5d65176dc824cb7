"""Tool calls linked to their results, checked against schemas and written as canonical JSON.

An assistant's message that is a JSON object with "tool_calls" makes one row per call ("id",
"name", "arguments", at the top or within "function"); a tool's message that is an object with "tool_call_id" is a result; a
message that is an object with "tools" declares schemas. Calls meet results and schemas in joins on (conversation,
identifier) and (conversation, name), so a conversation may be of any length. An argument
{"$ref": identifier} depends on that call's result; levels follow from joins, one pass per level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import column, slices
from gleaner.session import materialize

PARSED = ("conv_id long, turn long, row long, part long, role string, kind string, call_id string, name string, "
          "payload string, refs array<string>, content string")
#: JSON schema's names of types and their Python forms.
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}


def canonical(value: object) -> str:
    """JSON with sorted names, no blanks, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def refs(value: object) -> list[str]:
    """Identifiers that arguments refer to, anywhere inside."""
    found, todo = set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if set(x) == {"$ref"} and isinstance(x["$ref"], str):
                found.add(x["$ref"])
            todo.extend(x.values())
        elif isinstance(x, list):
            todo.extend(x)
    return sorted(found)


#: Keywords that say nothing about which values fit.
NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
CHECKED = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
           "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties", "anyOf", "oneOf", "allOf", "not", "$ref"}
#: Levels of references and schemas followed; deeper ones are reported as unchecked.
DEEPEST = 64


def _is(value: object, kind: str) -> bool:
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, KINDS[kind]) and not (kind in ("integer", "number") and isinstance(value, bool))


def _found(root: object, pointer: str) -> tuple[object, bool]:
    """What a reference within the same schema points to, and whether there is such a place."""
    if pointer != "#" and not pointer.startswith("#/"):
        return None, False
    held = root
    for step in pointer.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(held, list) and step.isdecimal() and int(step) < len(held):
            held = held[int(step)]
        elif isinstance(held, dict) and step in held:
            held = held[step]
        else:
            return None, False
    return held, True


def _unchecked(found: list[str]) -> bool:
    return any(x.partition(": ")[2].startswith("unchecked ") for x in found)


def violations(value: object, schema: object, at: str = "$", root: object = None, depth: int = 0) -> list[str]:
    """Where ``value`` breaks ``schema``, by the keywords CHECKED; references to results fit any type.

    Another keyword, or a form of one that cannot be checked, is reported as "unchecked", not passed as valid.
    """
    root = schema if root is None else root
    if schema is False:
        return [f"{at}: not allowed"]
    if not isinstance(schema, dict) or isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    if depth > DEEPEST:
        return [f"{at}: unchecked depth"]
    out = [f"{at}: unchecked {k}" for k in sorted(set(schema) - CHECKED - NOTES)]
    inner = lambda x, s, where=at: violations(x, s, where, root, depth + 1)
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind]
    if "type" in schema:
        if not all(isinstance(k, str) and k in KINDS for k in kinds):
            out.append(f"{at}: unchecked type")
        elif not any(_is(value, k) for k in kinds):
            return [*out, f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema:
        if not isinstance(schema["enum"], list):
            out.append(f"{at}: unchecked enum")
        elif not any(_equal(value, x) for x in schema["enum"]):
            out.append(f"{at}: not in enum")
    if "const" in schema and not _equal(value, schema["const"]):
        out.append(f"{at}: not const")

    def limit(name: str, held: object, breaks) -> None:
        if name in schema:
            if not _is(schema[name], "number"):
                out.append(f"{at}: unchecked {name}")
            elif held is not None and breaks(held, schema[name]):
                out.append(f"{at}: {name}")

    number = value if _is(value, "number") else None
    limit("minimum", number, lambda x, n: x < n)
    limit("maximum", number, lambda x, n: x > n)
    limit("exclusiveMinimum", number, lambda x, n: x <= n)
    limit("exclusiveMaximum", number, lambda x, n: x >= n)
    for name, form in (("Length", str), ("Items", list), ("Properties", dict)):
        size = len(value) if isinstance(value, form) else None
        limit(f"min{name}", size, lambda x, n: x < n)
        limit(f"max{name}", size, lambda x, n: x > n)
    if "pattern" in schema and isinstance(value, str):
        try:
            if re.search(schema["pattern"], value) is None:
                out.append(f"{at}: pattern")
        except (re.error, TypeError):
            out.append(f"{at}: unchecked pattern")
    if schema.get("uniqueItems") is True and isinstance(value, list) and any(_equal(x, y) for i, x in enumerate(value) for y in value[:i]):
        out.append(f"{at}: uniqueItems")
    if isinstance(value, dict):
        known = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
        required = schema.get("required") if isinstance(schema.get("required"), list) else []
        more = schema.get("additionalProperties")
        out += [f"{at}.{n}: missing" for n in required if n not in value]
        for n in sorted(value):
            if n in known:
                out += inner(value[n], known[n], f"{at}.{n}")
            elif "patternProperties" in schema:
                continue  # reported as unchecked
            elif more is False:
                out.append(f"{at}.{n}: unknown")
            else:
                out += inner(value[n], more, f"{at}.{n}")
    if isinstance(value, list):
        for i, x in enumerate(value):
            out += inner(x, schema.get("items"), f"{at}[{i}]")
        if isinstance(schema.get("items"), list):
            out.append(f"{at}: unchecked items")
    for name in ("anyOf", "oneOf", "allOf"):
        if name not in schema:
            continue
        if not isinstance(schema[name], list) or not schema[name]:
            out.append(f"{at}: unchecked {name}")
            continue
        each = [inner(value, s) for s in schema[name]]
        fits, open_ = sum(not e for e in each), sum(_unchecked(e) for e in each)
        if name == "allOf":
            out += [x for e in each for x in e]
        elif open_ and (name == "oneOf" and fits < 2 or name == "anyOf" and not fits):
            out.append(f"{at}: unchecked {name}")
        elif fits == 0 or name == "oneOf" and fits > 1:
            out.append(f"{at}: {name}")
    if "not" in schema:
        held = inner(value, schema["not"])
        if not held or _unchecked(held):
            out.append(f"{at}: not" if not held else f"{at}: unchecked not")
    if "$ref" in schema:
        held, there = _found(root, schema["$ref"]) if isinstance(schema["$ref"], str) else (None, False)
        out += inner(value, held) if there else [f"{at}: unchecked $ref"]
    return out


def _equal(a: object, b: object) -> bool:
    """Equality of JSON values: 1 is 1.0, true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return set(a) == set(b) and all(_equal(a[k], b[k]) for k in a)
    return a == b


def _written(value: object) -> object:
    """Strings with halves of surrogate pairs, which JSON can escape but UTF-8 cannot hold, replaced by "?"."""
    if isinstance(value, list):
        return [_written(x) for x in value]
    return value.encode("utf-8", "replace").decode() if isinstance(value, str) else value


def _object(text: str | None, mark: str) -> dict | None:
    if text is None or mark not in text or not text.lstrip().startswith("{"):
        return None
    try:
        held = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return held if isinstance(held, dict) else None


def _nested(held: dict) -> dict:
    """Where a call or a tool has its name: itself, or its "function"."""
    return held["function"] if isinstance(held.get("function"), dict) and "name" not in held else held


def _parts(role: str | None, text: str | None) -> list[tuple]:
    """(kind, call_id, name, payload, refs, content) of a message's parts."""
    if role == "assistant" and (held := _object(text, "tool_calls")) is not None and isinstance(held.get("tool_calls"), list):
        content = held.get("content")
        out = [("message", None, None, None, None, content if content is None or isinstance(content, str) else canonical(content))]
        for call in held["tool_calls"]:
            if not isinstance(call, dict):  # no call, but content all the same
                out.append(("call", None, None, canonical(call), [], None))
                continue
            inner = _nested(call)
            given = inner.get("arguments")
            if isinstance(given, str):  # arguments are often JSON within a string
                try:
                    given = json.loads(given)
                except (ValueError, RecursionError):
                    pass
            out.append(("call", call.get("id") if isinstance(call.get("id"), str) else None,
                        inner.get("name") if isinstance(inner.get("name"), str) else None, canonical(given), refs(given), None))
        return out
    if role == "tool" and (held := _object(text, "tool_call_id")) is not None and isinstance(held.get("tool_call_id"), str):
        return [("result", held["tool_call_id"], None, canonical(held.get("content")), None, None)]
    if (held := _object(text, "tools")) is not None and isinstance(held.get("tools"), list):
        return [("message", None, None, None, None, text)] + [
            ("schema", None, tool["name"], canonical(tool.get("parameters")), None, None)
            for tool in (_nested(t) for t in held["tools"] if isinstance(t, dict)) if isinstance(tool.get("name"), str)]
    return [("message", None, None, None, None, text)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 5 + [pa.list_(pa.string()), pa.string()]
    names = [x.split(" ")[0] for x in PARSED.split(", ")]
    for batch in slices(batches):
        out = []
        for conv, turn, row, role, text in zip(*[column(batch, c).to_pylist() for c in ("conv_id", "turn", "row", "role", "text")], strict=True):
            for part, (kind, call, name, payload, needs, content) in enumerate(_parts(role, text)):
                out.append((conv, turn, row, part, role, kind, *map(_written, (call, name, payload, needs, content))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without references, else one more than the highest call referred to.

    Calls of a cycle, or behind one or an unknown identifier, get no level. A call that waits is placed when no reference is left open.
    """
    edges = materialize(calls.select("conv_id", "call_id", F.explode("refs").alias("needs")), "tool-edges")
    placed = materialize(calls.where("size(refs) = 0").select("conv_id", "call_id", F.lit(0).cast("long").alias("level")), "tool-levels")
    waiting = edges
    while not waiting.isEmpty():
        known = placed.select("conv_id", F.col("call_id").alias("needs"), "level")
        told = waiting.join(known, ["conv_id", "needs"], "left").groupBy("conv_id", "call_id").agg(
            F.max("level").alias("level"), F.sum(F.col("level").isNull().cast("int")).alias("open"))
        fresh = materialize(told.where("open = 0").select("conv_id", "call_id", (F.col("level") + 1).alias("level")), "tool-levels")
        if fresh.isEmpty():
            break
        placed = materialize(placed.unionByName(fresh), "tool-levels")
        waiting = materialize(waiting.join(fresh, ["conv_id", "call_id"], "left_anti"), "tool-edges")
    return placed


def linked(conversations: DataFrame) -> DataFrame:
    """One row per message, call and result: conv_id, turn, part, kind, call_id, level, status, errors, json.

    Order within a conversation is (turn, level of calls, part). ``status`` of a call: linked, unanswered, duplicate (its
    identifier names an earlier call), early (its first result comes before it), unordered (a cycle or unknown reference), unnamed;
    of a result: linked, duplicate, orphan. ``errors`` are violations of the schema declared in the conversation (the first
    one of a name), keywords that were not checked ("unchecked ..."), or "no schema". A message's content that is no string is carried as canonical JSON. Null conversations and turns stay, and link nothing; repeated rows are messages of their own, broken
    JSON is plain text; other columns are ignored; an empty table gives no rows.
    """
    source = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.monotonically_increasing_id().alias("row"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parts = materialize(source.mapInArrow(_parse, PARSED), "tool-parts")
    order = F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), "row", "part")
    calls = parts.where("kind = 'call'").withColumn("at", order)
    results = parts.where("kind = 'result'").withColumn("at", order)
    first_call = calls.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("at").alias("call_at"), F.min_by("refs", "at").alias("refs"))
    first_result = results.groupBy("conv_id", "call_id").agg(F.min("at").alias("result_at"))
    schemas = parts.where("kind = 'schema'").groupBy("conv_id", "name").agg(F.min_by("payload", order).alias("schema"))
    first_call = materialize(first_call, "tool-calls")
    known = first_call.drop("refs").join(first_result, ["conv_id", "call_id"], "left").join(_levels(first_call), ["conv_id", "call_id"], "left")

    told = calls.join(known, ["conv_id", "call_id"], "left").join(schemas, ["conv_id", "name"], "left")
    status = (F.when(F.col("call_id").isNull() | F.col("call_at").isNull(), "unnamed").when(F.col("at") != F.col("call_at"), "duplicate")
              .when(F.col("level").isNull(), "unordered").when(F.col("result_at").isNull(), "unanswered")
              .when(F.col("result_at") < F.col("at"), "early").otherwise("linked"))
    calls = told.select("conv_id", "turn", "part", "role", "kind", "call_id", "name", "payload", "content", "level", status.alias("status"), "schema")
    told = results.join(first_call.drop("refs"), ["conv_id", "call_id"], "left").join(first_result, ["conv_id", "call_id"], "left")
    status = F.when(F.col("call_at").isNull(), "orphan").when(F.col("at") != F.col("result_at"), "duplicate").otherwise("linked")
    blank = [F.lit(None).cast("long").alias("level"), status.alias("status"), F.lit(None).cast("string").alias("schema")]
    results = told.select("conv_id", "turn", "part", "role", "kind", "call_id", "name", "payload", "content", *blank)
    blank[1] = F.lit(None).cast("string").alias("status")
    plain = parts.where("kind = 'message'").select("conv_id", "turn", "part", "role", "kind", "call_id", "name", "payload", "content", *blank)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors, texts = batch.to_pylist(), [], []
            for r in rows:
                given = json.loads(r["payload"]) if r["payload"] is not None else None
                wrong = None
                if r["kind"] == "call":
                    wrong = violations(given, json.loads(r["schema"])) if r["schema"] is not None else ["no schema"]
                    told = {"arguments": given, "id": r["call_id"], "name": r["name"]}
                elif r["kind"] == "result":
                    told = {"content": given, "role": "tool", "tool_call_id": r["call_id"]}
                else:
                    told = {"content": r["content"], "role": r["role"]}
                errors.append(wrong)
                texts.append(canonical(told))
            kept = [column(batch, c) for c in ("conv_id", "turn", "part", "kind", "call_id", "level", "status")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())],
                                             names=["conv_id", "turn", "part", "kind", "call_id", "level", "status", "errors", "json"])

    schema = "conv_id long, turn long, part long, kind string, call_id string, level long, status string, errors array<string>, json string"
    return plain.unionByName(calls).unionByName(results).mapInArrow(write, schema)
