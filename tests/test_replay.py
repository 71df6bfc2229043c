"""G01-G06, C11, D01, D02, S09-S13."""

import json

import pytest
from pyspark.sql import functions as F

from frameloom.functions.schema import MESSAGE
from frameloom.operators import replay
from frameloom.operators.registry import Tool, ToolError, ToolRegistry
from frameloom.sources import readers


def made():
    """Functions that are pickled by value: executors can't import the tests."""

    def double(x):
        return x * 2

    def broken():
        raise RuntimeError("no")

    return double, broken


double, broken = made()
REGISTRY = ToolRegistry([Tool("double", double), Tool("broken", broken)])
A = "<|action|>"


def runs(spark, recorded, **options):
    rows = [(run, i, text, n) for run, steps in recorded.items() for i, (text, n) in enumerate(s if isinstance(s, tuple) else (s, 1) for s in steps)]
    df = spark.createDataFrame(rows, "run_id string, step int, raw_text string, n_gen int").repartition(3)
    return {r["run_id"]: (r["stopped_on"], r["iterations"], r["answer"], json.loads(r["frames"])) for r in replay.replay(df, REGISTRY, **options).collect()}


def test_frames_runs(spark):
    call = A + '{"tool": "double", "x": 2}'
    got = runs(spark, {
        "answer": [A + '{"tool": "answer", "text": "42"}' + call], "fail": [A + '{"tool": "fail", "reason": "x"}'], "two": [call, "<|belief|>b" + A + '{"tool": "answer", "text": 7}'], "error": [A + '{"tool": "broken"}', "x"],
        "endless": [call] * 5, "garbage": ["garbage"], "belief": ["<|belief|>b"], "both": [call + A + '{"tool": "zz"}' + A + '{"tool": "double"}', A + '{"tool": "answer"}'], "cut": [(call, 512)], "owned": ["<|result|>{}"], "reserved": ["<|reserved_special_token_3|>b"],
    }, max_iterations=3)
    assert {k: v[:3] for k, v in got.items() if k not in ("error", "garbage", "owned")} == {
        "answer": ("terminal_action", 1, "42"), "fail": ("terminal_action", 1, None), "two": ("terminal_action", 2, "7"), "endless": ("max_iterations", 3, None), "belief": ("no_action", 1, None), "both": ("terminal_action", 2, None), "cut": ("max_tokens", 1, None),
        "reserved": ("no_action", 1, None),
    }
    assert got["garbage"][0].startswith("parse_error: expected frame marker") and got["garbage"][1] == 1 and got["owned"][0].startswith("parse_error: runtime-owned")
    assert [f["content"] for f in got["two"][3] if f["type"] == "result"] == [{"tool": "double", "value": 4}, {"tool": "answer", "value": None}]
    assert "raised: RuntimeError: no" in got["error"][3][1]["content"]["value"]
    values = [f["content"]["value"] for f in got["both"][3] if f["type"] == "result"]
    assert values[0] == 4 and "unknown tool" in values[1] and "bad arguments" in values[2] and len(got["answer"][3]) == 3


def test_chat_runs(spark):
    call = '<|python_tag|>{"name": "double", "parameters": {"x": 2}}<|eom_id|>'
    got = runs(spark, {"text": ["hello<|eot_id|>"], "call": [call, '{"name": "answer", "parameters": "{\\"text\\": \\"4\\"}"}<|eot_id|>'], "fail": ['<|python_tag|>{"name": "fail", "arguments": {"reason": "r"}}<|eot_id|>'], "bad": ["<|python_tag|>{x<|eot_id|>"], "nameless": ["<|python_tag|>{}<|eot_id|>"]}, kind="chat")
    assert {k: v[:3] for k, v in got.items() if k != "bad"} == {"text": ("terminal_action", 1, "hello"), "call": ("terminal_action", 2, "4"), "fail": ("terminal_action", 1, None), "nameless": ("parse_error: tool call missing name", 1, None)}
    assert got["bad"][0].startswith("parse_error: ") and [m["role"] for m in got["call"][3]] == ["assistant", "tool", "assistant"] and json.loads(got["call"][3][1]["content"]) == {"tool": "double", "value": 4}


def test_command_stops(spark):
    def step(run, i, command="c", problem=None, n=1, submitted=False, cut=False):
        return run, i, command, problem, n, submitted, cut

    rows = [step("same", i) for i in range(5)] + [step("sub", 0, "a"), step("sub", 1, "b", submitted=True)] + [step("none", 0, None, n=0)] + [step("bad", 0, "a", problem="parse_error: x")] + [step("cut", 0, "a", cut=True)] + [step("long", i, f"c{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "run_id string, step int, command string, problem string, n_calls int, submitted boolean, max_tokens boolean")
    got = {r["run_id"]: (r["stopped_on"], r["iterations"]) for r in replay.command_stops(df, max_iterations=6).collect()}
    assert got == {"same": ("repeated_command", 3), "sub": ("submitted", 2), "none": ("no_action", 1), "bad": ("parse_error: x", 1), "cut": ("max_tokens", 1), "long": ("max_iterations", 6)}


def test_nested_results(spark):
    rows = [("a", 0, 0, "x"), ("a", 0, 1, "[]"), ("a", 0, 2, "late"), ("a", 1, 0, ""), ("b", 0, 1, "q"), ("b", 0, 0, "p")]
    got = dict(map(tuple, replay.nested_results(spark.createDataFrame(rows, "id string, turn int, step int, result string")).collect()))
    assert got == {"a": [["x"], []], "b": [["p", "q"]]}


def test_chain(spark):
    def m(role, content, *calls):
        return role, content, None, [(None, "function", (n, "{}")) for n in calls] or None

    messages = [m("system", "s"), m("user", "u"), m("assistant", "hm", "f", "g"), m("tool", "out"), m("assistant", "", "Finish"), m("tool", "hidden"), m("assistant", "bye")]
    df = spark.createDataFrame([(messages,)], f"m array<{MESSAGE}>")
    got = [tuple(x) for x in df.select(replay.first_calls(F.col("m")).alias("c")).first()["c"]]
    assert got == [("tool", "f", "{}", "out", None), ("tool", "Finish", "{}", "", None), ("assistant", None, None, None, "bye")]


def test_registry():
    assert REGISTRY.call("double", {"x": 3}) == 6 and [s["name"] for s in REGISTRY.schemas()] == ["broken", "double"] and "double" in REGISTRY and len(REGISTRY) == 2 and REGISTRY["double"].name == "double" and len(list(REGISTRY)) == 2
    with pytest.raises(ValueError):
        ToolRegistry([Tool("a", double), Tool("a", double)])
    for name, args, said in (("zz", {}, "unknown"), ("double", {}, "bad arguments"), ("broken", {}, "RuntimeError")):
        with pytest.raises(ToolError, match=said):
            REGISTRY.call(name, args)


def test_result_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one.json").write_text(json.dumps({"id": 7, "v": 1}))
    (tmp_path / "m" / "two.json").write_text(json.dumps({"v": 2}))
    got = {r["id"]: r["v"] for r in readers.result_files(spark, [str(tmp_path / "m" / "*.json"), str(tmp_path / "zz" / "*.json")], "id string, v int").collect()}
    assert got == {"7": 1, "two": 2} and readers.result_files(spark, [str(tmp_path / "none")], "id string").count() == 0
    assert readers.bfcl_paths("r", "o/m", ["simple"], {"simple": "non_live"}, "V4") == ["r/o_m/non_live/V4_simple_result.json"]
    with pytest.raises(KeyError):
        readers.bfcl_paths("r", "m", ["zz"], {}, "V4")
    for cat, name, said in (("a", "t1", "first"), ("b", "t2", "last")):
        (tmp_path / "tools" / cat).mkdir(parents=True)
        (tmp_path / "tools" / cat / f"{name}.json").write_text(json.dumps({"tool_name": "My Tool", "tool_description": said}))
    assert [tuple(r) for r in readers.tool_files(spark, str(tmp_path / "tools")).collect()] == [("my_tool", "My Tool", "last")]


def test_what_a_model_wrote_ends_its_own_run_alone(spark):
    deep = "[" * 100_000
    got = runs(spark, {"list": [A + "[1]"], "half": [A + '{"tool": "answer", "text": "\\ud83d"}'], "deep": [A + deep], "good": [A + '{"tool": "answer", "text": "4"}']})
    assert got["list"][0] == "parse_error: action is no object" and got["good"][:3] == ("terminal_action", 1, "4") and got["half"][2] == "\ufffd" and got["deep"][0]
    tag = '<|python_tag|>{"name": "double", "arguments": %s}<|eom_id|>'
    got = runs(spark, {"bad": [tag % '"{x"'], "list": [tag % "[1]"], "deep": [tag % deep], "good": ["hi<|eot_id|>"]}, kind="chat")
    assert got["bad"][0] == got["list"][0] == "parse_error: arguments are no object" and got["deep"][0].startswith("parse_error") and got["good"][0] == "terminal_action"


def test_bad_lines_end_no_load(spark, tmp_path):
    good = {"id": "1", "domain": "d", "frames": [{"type": "goal", "content": "g"}]}
    half = json.dumps(good | {"id": "2", "frames": [{"type": "goal", "content": "\ud83d"}]})
    (tmp_path / "x.jsonl").write_text("\n".join([json.dumps(good), half, "[" * 100_000, '{"id": 3, "domain": "d", "frames": ' + "[" * 500 + "]" * 500 + "}"]))
    rows, bad = readers.trajectories(spark, str(tmp_path / "x.jsonl"))
    got = {r["id"]: r for r in rows.collect()}
    assert got["1"]["error"] is None and got["2"]["frames"][0]["text"] == "\ufffd" and got["3"]["error"] and bad.count() == 1
