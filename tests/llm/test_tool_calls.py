import json

from gleaner.llm import tool_calls


def _message(**body):
    return json.dumps(body)


def test_links_levels_and_schemas(spark):
    tools = [{"name": "find", "parameters": {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}}, "additionalProperties": False}}]
    call = lambda i, **a: {"id": i, "name": "find", "arguments": a}
    rows = [
        (1, 0, "system", _message(tools=tools)),
        (1, 1, "assistant", _message(content="look", tool_calls=[call("b", q={"$ref": "a"}), call("a", q="x"), call("c", q=1, z=2)])),
        (1, 2, "tool", _message(tool_call_id="a", content={"n": 2, "b": 1})),
        (1, 3, "tool", _message(tool_call_id="b", content="y")),
        (1, 4, "tool", _message(tool_call_id="zz", content="y")),
        (1, 5, "tool", _message(tool_call_id="a", content="again")),
        (2, 0, "assistant", _message(tool_calls=[call("p", q={"$ref": "r"}), call("r", q={"$ref": "p"})])),
        (None, None, None, None), (3, 0, "assistant", '{"tool_calls": broken'), (3, 0, "assistant", '{"tool_calls": broken'), (4, 0, "user", ""),
    ]
    found = tool_calls.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    calls = {(r.conv_id, r.call_id): r for r in found if r.kind == "call"}
    assert (calls[1, "a"].status, calls[1, "a"].level, calls[1, "a"].errors) == ("linked", 0, [])
    assert (calls[1, "b"].status, calls[1, "b"].level) == ("linked", 1)
    assert calls[1, "c"].status == "unanswered" and calls[1, "c"].errors == ["$.q: not string", "$.z: unknown"]
    assert calls[2, "p"].status == "unordered" and calls[2, "p"].errors == ["no schema"]
    assert sorted((r.turn, r.status) for r in found if r.kind == "result") == [(2, "linked"), (3, "linked"), (4, "orphan"), (5, "duplicate")]
    assert [r.json for r in found if r.turn == 2] == ['{"content":{"b":1,"n":2},"role":"tool","tool_call_id":"a"}']
    assert sum(r.conv_id == 3 for r in found) == 2 and sum(r.conv_id is None for r in found) == 1
    assert json.loads(calls[1, "a"].json) == {"arguments": {"q": "x"}, "id": "a", "name": "find"}


def test_empty_table(spark):
    assert tool_calls.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string, level int")).count() == 0
