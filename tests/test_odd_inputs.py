"""Whatever a text holds, no public UDF ends its job; and conversions take time in proportion to what they are given."""

import json
import time

import pytest
from helpers import frame_table
from pyspark.sql import functions as F

from frameloom.functions import pyjson, tools
from frameloom.operators import bridge, replay
from frameloom.sources import readers

DEEP = 100_000
ODD = [
    None, "", " ", "[" * DEEP, '{"a": ' * DEEP, "[" * 900 + "]" * 900, "[]", "{}", "null", "7", '"x"', "[1]", "[null]", "[[]]", "[{}]", '[{"name": "\\ud83d"}]', '{"name": "\\ud83d", "arguments": "\\udc00"}', '[{"name": 1, "parameters": 7}]',
    '[{"name": "f", "parameters": {"properties": {"x": 5}}}]', '[{"name": "f", "parameters": {"properties": {"x": {"type": ["a"]}}}}]', '[{"name": "f", "parameters": {"properties": [1]}}]', '[{"name": "f", "parameters": null}]', '[{"type": "goal"}]', '[{"type": null}]',
    '[{"role": "tool", "content": {"a": 1}}]', '[{"role": "assistant", "tool_calls": [{"function": {"name": "f", "arguments": "x"}}]}]', '[{"role": "assistant", "tool_calls": 5}]', "NaN", "[NaN]", "Infinity", '{"a": 1e999}', ";", ";;", '{"name": "f"};{', '{"name": ["f"]}',
    '{"name": "f", "parameters": [1]}', '{"name": "f", "arguments": "[' + "[" * DEEP + '"}', "\u0000", " ", "é" * 10, "1" * 5000, '{"name": "f", "arguments": ' + "[" * 500 + "]" * 500 + "}",
]
UDFS = [
    tools.render_tools, tools.tool_schemas, tools.decode_result, bridge.read_call, pyjson.ingest_frames, pyjson.ingest_messages, pyjson.dumps, pyjson.dumps_utf8, pyjson.dumps_sorted, pyjson.is_json, readers._record,
    lambda c: pyjson.read_payloads(F.array(*(F.struct(F.lit(k).alias("type"), F.coalesce(c, F.lit("")).alias("raw")) for k in ("action", "result", "reward", "goal", "end")))),
]
NAMES = [getattr(f, "__name__", "") for f in UDFS[:-1]] + ["read_payloads"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "id int, t string")


@pytest.mark.parametrize("udf", UDFS, ids=NAMES)
def test_udfs(odd, udf):
    assert odd.select("id", udf(F.col("t")).alias("x")).collect().__len__() == len(ODD)


def test_generations_and_replays(spark, odd):
    assert bridge.parse_generation(odd, "t").count() == len(ODD)
    from frameloom.operators.registry import ToolRegistry

    for kind, around in (("chat", "<|python_tag|>%s<|eom_id|>"), ("chat", "%s"), ("frames", "<|action|>%s"), ("frames", "%s")):
        steps = odd.select(F.col("id").alias("run_id"), F.lit(0).alias("step"), F.format_string(around.replace("%s", "%1$s"), F.coalesce("t", F.lit(""))).alias("raw_text"), F.lit(1).alias("n_gen"))
        out = replay.replay(steps, ToolRegistry([]), kind).collect()
        assert len(out) == len(ODD) and all(r["stopped_on"] for r in out)


def test_too_deep_is_said(odd):
    got = {r["id"]: r["x"] for r in odd.select("id", tools.decode_result(F.col("t")).alias("x")).collect()}
    assert got[3]["error"] == tools.TOO_DEEP and got[3]["calls"] is None and got[0]["calls"] == []
    read = {r["id"]: r["x"] for r in odd.select("id", bridge.read_call(F.col("t")).alias("x")).collect()}
    assert read[0] is None and read[3]["error"] == tools.TOO_DEEP and read[16]["name"] == "�" and read[9]["error"] == "not object"


def chat(n):
    out = [{"type": "goal", "content": "g"}, {"type": "mission", "content": "m"}]
    while len(out) < n:
        out += [{"type": "think", "content": "t"}, {"type": "action", "content": {"tool": "bash", "n": len(out)}}, {"type": "result", "content": {"tool": "bash", "value": len(out)}}]
    return out


def test_conversions_take_time_in_proportion(spark):
    took = {}
    for n in (500, 500, 30_000):  # the first compiles
        df = frame_table(spark, {"x": chat(n)}).cache()
        df.count()
        began = time.perf_counter()
        messages = bridge.settled(df.select(bridge.frames_to_messages(F.col("frames")).alias("m")))
        got = messages.select(F.size("m").alias("n"), F.size(replay.first_calls(F.col("m"))).alias("c"), F.element_at("m", -1).alias("last")).first()
        took[n] = time.perf_counter() - began
        assert (got["n"], got["c"]) == (2 * got["c"] + 2, (len(chat(n)) - 2) // 3) and got["last"]["tool_call_id"] == f"call_{got['n'] - 2}"
        back = messages.select(pyjson.ingest_messages(F.to_json("m")).alias("x")).select(bridge.messages_to_frames(F.col("x.messages"))["frames"].alias("f")).first()["f"]
        assert [(f["type"], json.loads(f["json"])) for f in back] == [(f["type"], f["content"]) for f in chat(n)]
    assert took[30_000] < 10 + 40 * took[500]
