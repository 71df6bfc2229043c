"""C01, C05-C07, C09, C10, F09-F12, P04, P05."""

import json

from helpers import ANSWER, BASH, frame_table, frames_of, message_table, one
from pyspark.sql import functions as F

from frameloom.functions import tools
from frameloom.operators import bridge


def to_messages(spark, rows):
    got = one(frame_table(spark, rows).withColumn("m", bridge.frames_to_messages(F.col("frames"))), "m")
    return {k: [m.asDict(recursive=True) for m in v] for k, v in got.items()}


def brief(ms):
    return [(m["role"], m["content"], m["tool_call_id"], [(c["id"], c["function"]["name"], c["function"]["arguments"]) for c in m["tool_calls"] or []]) for m in ms]


def test_frames_to_messages(spark):
    got = to_messages(spark, {
        "plain": frames_of("gm"), "loop": frames_of("gmkar"), "batch": frames_of("gmaarr"), "late": frames_of("mato"), "end": frames_of("gmbpte"), "lost": frames_of("gmb"), "fail": [{"type": "action", "content": {"tool": "fail", "reason": "no"}}],
        "odd": [{"type": "think", "content": "t"}, {"type": "action", "content": 5}, {"type": "action", "content": BASH}], "null": [{"type": "goal", "content": None}, {"type": "mission", "content": {"a": 1}}],
    })
    assert brief(got["plain"]) == [("system", "goal text", None, []), ("user", "mission text", None, [])]
    assert brief(got["loop"])[2:] == [("assistant", "think text", None, [("call_2", "bash", '{"command": "ls"}')]), ("tool", '{"tool": "bash", "value": "ok"}', "call_2", [])]
    assert [m[2] or m[3][0][0] for m in brief(got["batch"])[2:]] == ["call_2", "call_3", "call_3", "call_4"]
    assert [m["role"] for m in got["late"]] == ["system", "user", "assistant", "assistant"] and got["late"][2]["tool_calls"][0]["id"] == "call_1"
    assert got["end"][-1]["content"] == "belief text\nplan text\n\n42" and len(got["lost"]) == 2 and got["fail"][0]["content"] == "no"
    assert brief(got["odd"]) == [("assistant", "t", None, [("call_0", "bash", '{"command": "ls"}')])]
    assert [m["content"] for m in got["null"]] == ["None", "{'a': 1}"]


def to_frames(spark, rows):
    df = message_table(spark, rows).withColumn("c", bridge.messages_to_frames(F.col("messages")))
    return {r["id"]: ([(f["type"], json.loads(f["json"])) for f in r["c"]["frames"]], r["c"]["error"]) for r in df.collect()}


def call(name, args):
    return {"id": "x", "type": "function", "function": {"name": name, "arguments": args}}


def test_messages_to_frames(spark):
    got = to_frames(spark, {
        "plain": [{"role": "system", "content": "be good"}, {"role": "user", "content": "do"}, {"role": "assistant", "content": " done\n"}, {"role": "user", "content": "more"}, {"role": "other", "content": "?"}],
        "calls": [{"role": "assistant", "content": "hm", "tool_calls": [call("a", '{"x": 1}'), call("b", {"tool": "c"})]}, {"role": "tool", "content": "5x"}, {"role": "tool", "content": '{"v": 1}'}, {"role": "tool", "content": '"no t"'}, {"role": "tool", "content": '{"tool": "q"}'}],
        "null": [{"role": "tool", "content": "7"}], "blank": [{"role": "assistant", "content": " "}, {"role": "user"}],
        "tools": [{"role": "system", "content": "X\n\ntools:\nnamespace tools {...}"}], "avail": [{"role": "system", "content": "available tools:\n[]"}], "split": [{"role": "system", "content": "a\n\nb\n\nThe Tools"}],
    })
    assert got["plain"] == ([("goal", "be good"), ("mission", "do"), ("action", {"tool": "answer", "text": "done"}), ("feedback", "more")], None)
    assert got["calls"][0] == [("think", "hm"), ("action", {"tool": "a", "x": 1}), ("action", {"tool": "c"}), ("result", {"tool": "a", "value": "5x"}), ("result", {"tool": "c", "value": {"v": 1}}), ("result", {"tool": "unknown", "value": "no t"}), ("result", {"tool": "q"})]
    assert got["null"][1].startswith("TypeError") and got["blank"][0] == [("mission", "")]
    assert got["tools"][0] == [("goal", "X\n\ntools:"), ("obs", "namespace tools {...}")]
    assert got["avail"][0] == [("goal", "available"), ("obs", "tools:\n[]")] and got["split"][0] == [("goal", "a"), ("obs", "b\n\nThe Tools")]


def test_round_trip_keeps_the_types(spark):
    rows = {"x": frames_of("gmkarft")}
    messages = to_messages(spark, rows)["x"]
    back = to_frames(spark, {"x": messages})["x"][0]
    assert [t for t, _ in back] == [f["type"] for f in rows["x"]]


def test_coerce(spark):
    rows = [("f", json.dumps(frames_of("gmt"))), ("m", json.dumps([{"role": "user", "content": "q", "type": "x"}])), ("e", "[]"), ("bad", "{")]
    got = {r["id"]: r for r in bridge.coerce(spark.createDataFrame(rows, "id string, j string"), "j").collect()}
    assert [f["type"] for f in got["m"]["frames"]] == ["mission"] and [m["role"] for m in got["f"]["messages"]] == ["system", "user", "assistant"]
    assert got["e"]["frames"] == [] and got["e"]["messages"] == [] and got["bad"]["error"]


def test_tool_schemas(spark):
    listed = [{"name": "run", "description": "does", "parameters": {"properties": {"mode": {"type": "string", "enum": ["fast", "slow"], "description": "how"}, "n": {"type": "array", "items": {"type": "integer"}}, "o": {"type": "object"}, "z": {}}, "required": ["mode"]}}, {"name": "no"}, {}]
    text = tools.namespace(listed)
    assert text.split("\n") == ["tools:", "namespace tools {", " // does", " type run = (_: {", "   // how", "   mode: 'fast' | 'slow',", "   n?: number[],", "   o?: object,", "   z?: any,", "  }) => any;", " type no = () => any;", " type <unnamed> = () => any;", "}"]
    df = frame_table(spark, {"has": [*frames_of("g"), {"type": "obs", "content": text}], "no": frames_of("gm"), "goalless": frames_of("m")})
    out = one(df.withColumn("o", bridge.with_tool_obs(F.col("frames"), tools.render_tools(F.lit(json.dumps(listed))))), "o")
    assert {k: [f["type"] for f in v] for k, v in out.items()} == {"has": ["goal", "obs"], "no": ["goal", "obs", "mission"], "goalless": ["mission", "obs"]}
    assert one(df.withColumn("o", F.size(bridge.with_tool_obs(F.col("frames"), tools.render_tools(F.lit("[]"))))), "o")["no"] == 2


def test_inject_tools(spark):
    df = message_table(spark, {"s": [{"role": "user", "content": "u"}, {"role": "system", "content": "be"}], "n": [{"role": "user", "content": "u"}]})
    plain = F.transform("messages", bridge._plain)
    out = one(df.withColumn("m", bridge.inject_tools(plain, F.lit("[1]"))), "m")
    assert [m["content"] for m in out["s"]] == ["u", "be\n\navailable tools:\n[1]"] and [m["content"] for m in out["n"]] == ["available tools:\n[1]", "u"]
    assert len(one(df.withColumn("m", bridge.inject_tools(plain, F.lit(None).cast("string"))), "m")["n"]) == 1


def test_generations(spark):
    rows = {
        "tag": '<|python_tag|>{"name": "f", "parameters": {}}<|eom_id|>', "text": "hello<|eot_id|>", "bare": '{"name": "f", "parameters": "{\\"a\\": 1}"}<|eot_id|>', "bad": "<|python_tag|>{x<|eot_id|>", "list": "<|python_tag|>[1]<|eot_id|>",
        "nameless": '{"a": 1}<|eot_id|>', "head": "<|start_header_id|>assistant<|end_header_id|>\n\nhi<|eot_id|>more", "empty": "<|eot_id|>", "none": None, "open": " no stop ",
    }
    got = {r["id"]: (r["call"], r["said"], r["stop"]) for r in bridge.parse_generation(spark.createDataFrame(list(rows.items()), "id string, g string"), "g").collect()}
    assert json.loads(got["tag"][0]) == {"name": "f", "parameters": {}} and got["tag"][2] == "tool_call" and json.loads(got["bare"][0])["parameters"] == {"a": 1}
    assert got["text"] == (None, "hello", "assistant_text") and got["head"][1] == "hi" and got["open"] == (None, "no stop", "assistant_text")
    assert got["bad"][2].startswith("parse_error: ") and got["list"][2] == "parse_error: not object" and got["empty"][2] == got["none"][2] == "parse_error: empty"
    assert got["nameless"] == (None, '{"a": 1}', "assistant_text")
    assert ANSWER["tool"] == "answer"
