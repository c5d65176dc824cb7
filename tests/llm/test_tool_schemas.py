"""Nested calls and tools, content in parts, and the keywords of schemas."""

import json

from gleaner.llm import tool_calls
from gleaner.llm.tool_calls import violations


def test_nested_form(spark):
    tool = {"type": "function", "function": {"name": "find", "parameters": {"type": "object", "properties": {"q": {"type": "string"}}}}}
    call = {"id": "a", "type": "function", "function": {"name": "find", "arguments": '{"q": 1}'}}
    parts = [{"type": "text", "text": "look"}]
    rows = [(1, 0, "system", json.dumps({"tools": [tool]})), (1, 1, "assistant", json.dumps({"content": parts, "tool_calls": [call, "odd"]})),
            (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "y"}))]
    found = tool_calls.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    calls = {r.call_id: r for r in found if r.kind == "call"}
    assert (calls["a"].status, calls["a"].errors) == ("linked", ["$.q: not string"])
    assert json.loads(calls["a"].json) == {"arguments": {"q": 1}, "id": "a", "name": "find"} and json.loads(calls[None].json)["arguments"] == "odd"
    message = next(r for r in found if r.kind == "message" and r.turn == 1)
    assert json.loads(json.loads(message.json)["content"]) == parts


def test_keywords():
    for value, schema, want in [
        (None, {"type": ["string", "null"]}, []), (1, {"type": ["string", "null"]}, ["$: not string or null"]),
        (3, {"minimum": 4}, ["$: minimum"]), (3, {"maximum": 2}, ["$: maximum"]), (3, {"exclusiveMinimum": 3}, ["$: exclusiveMinimum"]),
        ("abc", {"maxLength": 2, "pattern": "^b"}, ["$: maxLength", "$: pattern"]), ([1, 1.0], {"uniqueItems": True}, ["$: uniqueItems"]),
        ([], {"minItems": 1}, ["$: minItems"]), (1, {"const": True}, ["$: not const"]), (1, {"enum": [1.0]}, []), (True, {"enum": [1]}, ["$: not in enum"]),
        (1, {"anyOf": [{"type": "string"}, {"type": "null"}]}, ["$: anyOf"]), (1, {"oneOf": [{"type": "integer"}, {"minimum": 0}]}, ["$: oneOf"]),
        (1, {"allOf": [{"minimum": 2}, {"type": "integer"}]}, ["$: minimum"]), (1, {"not": {"type": "integer"}}, ["$: not"]),
        ({"a": 1}, {"properties": {"a": {"$ref": "#/$defs/x"}}, "$defs": {"x": {"type": "string"}}}, ["$.a: not string"]),
        (1, {"$ref": "#/none"}, ["$: unchecked $ref"]), (1, {"$ref": "#"}, ["$: unchecked depth"]),
        ({"a": 1}, {"additionalProperties": {"type": "string"}}, ["$.a: not string"]),
        (4, {"multipleOf": 2}, ["$: unchecked multipleOf"]), (4, {"anyOf": [{"multipleOf": 2}]}, ["$: unchecked anyOf"]), ("x", {"type": "date"}, ["$: unchecked type"]),
    ]:
        assert violations(value, schema) == want, (value, schema)
