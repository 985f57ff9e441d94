import random

from perennial.llm import tool_calls as tc

CALLS = "conv_id long, call_id string, place long, name string, arguments string, after array<string>, note string"
RESULTS = "conv_id long, call_id string, place long, content string, name string"
SCHEMA = '{"type":"object","required":["x"],"properties":{"x":{"type":"integer","minimum":1}}}'


def link(spark, calls, results):
    schemas = spark.createDataFrame([("f", SCHEMA), (None, "{}")], "name string, schema string")
    rows = tc.link_calls(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas
    ).collect()
    return {(r["conv_id"], r["call_id"]): r for r in rows}, rows


def test_statuses_and_order(spark):
    calls = [
        (1, "a", 0, "f", '{"x":1.0, "b":"é\\n"}', [], None),
        (1, "b", 2, "f", '{"x":0}', ["a"], None),
        (1, "c", 4, "g", "{}", ["a", None, "zz"], None),
        (1, "d", 6, "f", "{x", None, None),
        (1, "d", 7, "f", '{"x":9}', None, None),
        # points forward: q before p
        (2, "p", 0, "f", '{"x":2}', ["q"], None),
        (2, "q", 1, "f", '{"x":3}', [], None),
        (2, "r", 2, "f", '{"x":3}', ["p", "q"], None),
        # a cycle, and one behind it
        (3, "u", 0, "f", '{"x":2}', ["v"], None),
        (3, "v", 1, "f", '{"x":2}', ["u"], None),
        (3, "w", 2, "f", '{"x":2}', ["v"], None),
        (3, "s", 3, "f", '{"x":2}', ["s"], None),
        (3, "t", 4, "f", '{"x":2}', [], None),
        (None, "n", 0, "f", None, [], None),
        (4, None, 0, None, None, [], None),
    ]
    results = [(1, "a", 1, "ok", "x"), (1, "a", 3, "later", "x"), (1, "lost", 5, "?", "x"), (None, "a", 1, "z", "x")]
    got, rows = link(spark, calls, results)
    status = {k: r["status"] for k, r in got.items() if None not in k}
    assert status == {
        (1, "a"): "linked", (1, "b"): "no_result", (1, "c"): "missing_dependency", (1, "d"): "no_result",
        (1, "lost"): "orphan_result", (2, "p"): "no_result", (2, "q"): "no_result", (2, "r"): "no_result",
        (3, "u"): "cycle", (3, "v"): "cycle", (3, "w"): "cycle", (3, "s"): "cycle", (3, "t"): "no_result",
    }
    assert sum(r["status"] == "unidentified" for r in rows) == 3
    place = {k: r["position"] for k, r in got.items()}
    assert place[2, "q"] < place[2, "p"] < place[2, "r"] and place[1, "a"] < place[1, "b"]
    a = got[1, "a"]
    assert (a["n_calls"], a["n_results"], a["errors"]) == (1, 2, [])
    assert a["record"] == (
        '{"arguments":{"b":"é\\n","x":1},"call_id":"a","content":"ok","conv_id":1,"name":"f"}'
    )
    assert got[1, "b"]["errors"] == ["$.x: below minimum"]
    assert got[1, "c"]["errors"] == ["unknown tool"]
    assert got[1, "d"]["errors"] == ["$: not JSON"] and got[1, "d"]["n_calls"] == 2


def test_arguments_that_break_no_job(spark):
    odd = {
        "huge": '{"x":1e999}', "digits": '{"x":' + "9" * 6000 + "}", "half": '{"x":"\\ud800", "\\udfff":1}',
        "deep": '{"x":' + "[" * 5000 + "]" * 5000 + "}", "brackets": '{"x":"' + "[" * 5000 + '"}',
        "pair": '{"x":"\\ud83d\\ude00"}', "large": '{"x":1e308}',
    }
    schemas = {
        "f": SCHEMA, "odd": '{"type":"decimal"}', "list": "[1]", "no": "false", "broken": "{",
        "loose": '{"required":1,"properties":[],"minimum":"a","enum":5}', "one": '{"enum":[1,{"x":1.0}]}',
    }
    calls = [(i, k, 0, f, v, [], None) for i, f in enumerate(schemas) for k, v in odd.items()]
    calls += [(9, n, 0, "one", v, [], None) for n, v in (("true", "true"), ("1.0", "1.0"), ("x", '{"x":1}'))]
    table = spark.createDataFrame(list(schemas.items()), "name string, schema string")
    rows = tc.link_calls(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), table
    ).collect()
    errors = {(r["conv_id"], r["call_id"]): r["errors"] for r in rows}
    assert all(errors[0, k] == ["$: not JSON"] for k in ("huge", "digits", "deep"))
    assert errors[0, "half"] == ["$.x: not integer"] and errors[0, "large"] == []
    assert errors[1, "pair"] == ["$: not decimal"] and errors[3, "pair"] == ["$: not allowed"]
    assert errors[2, "pair"] == errors[4, "pair"] == errors[5, "pair"] == []
    assert errors[9, "true"] == ["$: not listed"] and errors[9, "1.0"] == errors[9, "x"] == []
    record = {(r["conv_id"], r["call_id"]): r["record"] for r in rows}
    assert '{"x":"\\ud800","\\udfff":1}' in record[0, "half"] and '{"x":"\U0001f600"}' in record[0, "pair"]


def plain_levels(calls, edges):
    level, left = {}, set(calls)
    while ready := {c for c in left if all(a != c or b not in left for a, b in edges)}:
        level.update(dict.fromkeys(ready, 1 + max(level.values(), default=-1)))
        left -= ready
    return [level.get(c) for c in calls]


def test_chains_against_peeling(spark, monkeypatch):
    draw = random.Random(2)
    calls, want = [], {}
    for conv in range(12):
        names = [f"c{i}" for i in range(draw.randint(1, 9))]
        after = {n: draw.sample(names, draw.randint(0, min(2, len(names)))) for n in names}
        levels = plain_levels(names, [(n, p) for n in names for p in after[n]])
        forward = any(names.index(p) >= names.index(n) for n in names for p in after[n])
        for i, n in enumerate(names):
            calls.append((conv, n, i, "f", '{"x":1}', after[n], None))
            want[conv, n] = levels[i] if forward else i
    for limit in (1 << 20, 12, 0):
        monkeypatch.setattr(tc, "MOST_IN_TASK", limit)
        got, _ = link(spark, calls, [])
        assert {k: r["position"] for k, r in got.items()} == want


def test_long_chain_with_one_forward_edge(spark):
    n = 50_000
    calls = spark.range(n).selectExpr(
        "1L AS conv_id", "string(id) AS call_id", "id AS place", "'f' AS name", "'{\"x\":1}' AS arguments",
        f"CASE WHEN id = 0 THEN array('{n - 1}') WHEN id < {n - 1} THEN array(string(id - 1)) END AS after",
    )
    schemas = spark.createDataFrame([("f", SCHEMA)], "name string, schema string")
    got = tc.link_calls(calls, spark.createDataFrame([], RESULTS), schemas)
    bad = got.selectExpr("position - pmod(bigint(call_id) + 1, 50000) AS gap", "status").where("gap != 0 OR status != 'no_result'")
    assert bad.isEmpty()


def test_empty(spark):
    assert link(spark, [], [])[1] == []


def test_violations():
    schema = {
        "type": "object", "required": ["a", "b"], "additionalProperties": False,
        "properties": {
            "a": {"type": ["string", "null"], "maxLength": 2},
            "b": {"type": "array", "minItems": 1, "items": {"enum": [1, 2]}},
        },
    }
    assert tc.violations({"a": None, "b": [1]}, schema) == []
    assert tc.violations({"a": "abc", "b": [3], "c": 0}, schema) == [
        "$.a: too long", "$.b[0]: not listed", "$.c: not allowed",
    ]
    assert tc.violations({"b": []}, schema) == ["$.a: missing", "$.b: too short"]
    assert tc.violations(True, {"type": "integer"}) == ["$: not integer"]


def test_canonical():
    assert tc.canonical({"b": 1.0, "a": [1.5, {"z": None, "y": True}]}) == '{"a":[1.5,{"y":true,"z":null}],"b":1}'
    assert tc.parse('{"a": NaN}') == (None, False)
