"""Linked tool calls against a version in plain Python."""

import json

from shelfmark.llm import toolcalls

CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, needs array<string>, level string"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string, json string"
SCHEMAS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("search", "share", "number", None),
           ("note", "tags", "array", False), ("note", "flag", "boolean", True), ("note", "more", "object", False), ("note", None, "x", True),
           ("any", "x", "unheard", True)]
SCHEMAS_SCHEMA = "name string, parameter string, type string, required boolean"


def test_link(spark):
    long = "ä\"\n\\" * 50_000
    calls = [
        (1, 1, "a", "search", '{ "query" : "x", "limit": 3 }', None, ""),
        (1, 3, "b", "search", '{"limit":"3"}', ["a"], ""),
        (1, 5, "c", "note", '{"tags":[1, 2],"flag":true,"more":{"z":1,"a":{"y":null,"b":"é"}}}', ["b", "a", None], ""),
        (1, 7, "c", "note", "{}", [], ""),
        (1, 9, "d", "nothing", "{}", ["zz"], ""),
        (1, 11, "e", "note", '{"flag":1,"tags":{},"x":0}', ["d"], ""),
        (1, 13, "f", "note", "[1]", None, ""), (1, 13, "f", "note", "[1]", None, ""),
        (1, 15, None, "note", '{"flag":true}', None, ""), (None, 15, "n", None, None, ["a"], ""),
        (2, 1, "a", "search", '{"query":"y","share":0.5}', ["b"], ""), (2, 3, "b", "search", '{"query":"y"}', ["a"], ""),
        (2, 5, "c", "search", '{"query":"y"}', ["a"], ""), (2, 7, "q", "search", '{"query":"y"}', ["missing"], ""),
        (3, 1, "l", "search", json.dumps({"query": long}), [], ""), (3, 2, "m", "any", '{"x":"cut', [], ""), (3, 3, "o", "any", '{"x":[]}', [], ""),
    ]
    results = [(1, 2, "a", 'one "two"', ""), (1, 4, "a", "later", ""), (1, 6, "c", None, ""), (1, 8, "lost", "x", ""), (1, 9, None, "x", ""),
               (2, 4, "b", "r", ""), (3, 2, "l", long, "")]
    got = toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS),
                         spark.createDataFrame(SCHEMAS, SCHEMAS_SCHEMA)).collect()

    def line(arguments, call_id, name, result):
        return json.dumps({"arguments": arguments, "id": call_id, "name": name, "result": result},
                          sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    want = [
        (1, 1, "a", 0, "ok", "", line({"query": "x", "limit": 3}, "a", "search", 'one "two"')),
        (1, 3, "b", 1, "bad_arguments", "missing query, type of limit", line({"limit": "3"}, "b", "search", None)),
        (1, 5, "c", 2, "ok", "", line({"tags": [1, 2], "flag": True, "more": {"z": 1, "a": {"y": None, "b": "é"}}}, "c", "note", "")),
        (1, 7, "c", 2, "duplicate_id", "missing flag", line({}, "c", "note", "")),
        (1, 9, "d", 0, "unknown_tool", "", line({}, "d", "nothing", None)),
        (1, 11, "e", 1, "bad_arguments", "type of flag, type of tags, unknown x", line({"flag": 1, "tags": {}, "x": 0}, "e", "note", None)),
        (1, 13, "f", 0, "not_an_object", "", line(None, "f", "note", None)), (1, 13, "f", 0, "not_an_object", "", line(None, "f", "note", None)),
        (1, 15, None, 0, "no_id", "", line({"flag": True}, None, "note", None)),
        (None, 15, "n", 0, "unknown_tool", "", line(None, "n", None, None)),
        (2, 1, "a", None, "circle", "", line({"query": "y", "share": 0.5}, "a", "search", None)),
        (2, 3, "b", None, "circle", "", line({"query": "y"}, "b", "search", "r")),
        (2, 5, "c", None, "circle", "", line({"query": "y"}, "c", "search", None)),
        (2, 7, "q", 0, "missing_need", "", line({"query": "y"}, "q", "search", None)),
        (3, 1, "l", 0, "ok", "", line({"query": long}, "l", "search", long)),
        (3, 2, "m", 0, "not_an_object", "", line(None, "m", "any", None)),
        (3, 3, "o", 0, "no_result", "", line({"x": []}, "o", "any", None)),
        (1, 8, "lost", None, "orphan_result", "", line(None, "lost", None, "x")),
        (1, 9, None, None, "orphan_result", "", line(None, None, None, "x")),
    ]
    rows = [(r["conv_id"], r["turn"], r["call_id"], r["level"], r["status"], r["problems"], r["json"]) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_levels_of_a_chain_and_a_circle(spark):
    edges = [(f"k{n + 1}", f"k{n}") for n in range(6)] + [("k6", "k1"), ("x", "y"), ("y", "x"), ("z", "x"), ("z", "k0"), ("s", "s")]
    got = {r["_key"]: r["level"] for r in toolcalls.levels(spark.createDataFrame(edges, "_key string, _need string")).collect()}
    assert got == {**{f"k{n}": n for n in range(1, 7)}, "x": None, "y": None, "z": None, "s": None}


def test_empty(spark):
    empty = toolcalls.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), spark.createDataFrame([], SCHEMAS_SCHEMA))
    assert empty.count() == 0
