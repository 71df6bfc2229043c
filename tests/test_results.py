"""A01-A14, J01-J11, O04-O06, P07-P12, U01-U03, W03, W04, T01-T03, M01-M03, F15, F25-F28, K03-K08."""

import hashlib
import json

import pytest
from helpers import frame_table, frames_of, one
from pyspark.sql import functions as F

from frameloom.functions import tools
from frameloom.operators import bridge, labels, lookups, results, validate, vectors
from frameloom.plans import matrix
from frameloom.sources import readers, writers


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


TASKS = "task_id string, domain string, success boolean, total_tokens long, generated_tokens long, total_sec double, inference_sec double, parsed_ok boolean, valid boolean, parse_error string, errors array<string>"


def test_efficiency(spark):
    r = results.efficiency(table(spark, [("a", "x", True, 100, 1, 1.0, 0.5, True, True, None, []), ("b", "x", False, 200, 3, 3.0, 1.5, True, False, None, []), ("c", "y", None, 300, 2, 2.0, 1.0, False, False, None, None)], TASKS)).first()
    assert (r["n"], r["avg_total_tokens"], r["tokens_per_success"], r["n_success"], r["success_rate"]) == (3, 200.0, 100.0, 1, 0.5)
    r = results.efficiency(table(spark, [], TASKS)).first()
    assert r["n"] == 0 and r["avg_total_tokens"] is None and r["success_rate"] is None


def test_rates_and_failures(spark):
    tasks = table(spark, [
        ("1", "x", None, 0, 0, 0.0, 0.0, True, True, None, []), ("2", "y", None, 0, 0, 0.0, 0.0, False, False, "parse failure: what: x", []), ("3", "y", None, 0, 0, 0.0, 0.0, True, False, "", ["[a] frame 1: m", "[a] frame 2: m", "[a] frame 1: n"]),
    ], TASKS)
    got = {r["domain"] if not r["whole"] else "all": (r["n"], r["parsed"], r["valid"]) for r in results.format_rates(tasks).collect()}
    assert got == {"all": (3, 2, 1), "x": (1, 1, 1), "y": (2, 1, 0)}
    assert [tuple(r) for r in results.failure_modes(tasks).collect()] == [("validation: [a] frame 1", 2), ("parse: parse failure", 1), ("validation: [a] frame 2", 1)]
    assert results.summary_lines(results.format_rates(tasks)) == ["examples evaluated: 3", "parse rate: 66.7%", "structural valid: 33.3%", "x: n=1 parsed=100.0% valid=100.0%", "y: n=2 parsed=50.0% valid=0.0%"]
    empty = results.format_rates(table(spark, [], TASKS)).collect()
    assert [(r["n"], r["parse_rate"]) for r in empty] == [(0, 0.0)]


def test_accuracy_and_retries(spark):
    assert results.weighted_accuracy(table(spark, [(1.0, 1), (0.0, 3), (None, 9)], "accuracy double, n int")).first()["primary"] == 0.25
    assert results.weighted_accuracy(table(spark, [(1.0, None), (0.5, None)], "accuracy double, n int")).first()["primary"] == 0.75
    rows = table(spark, [("multi_turn_1", [["x"], ["a", "b", "c"]]), ("simple_1", [["a", "b"]]), ("multi_turn_2", None)], "id string, turns array<array<string>>")
    r = results.retry_metrics(rows.where("id <> 'simple_1'")).first()
    assert (r["avg_retry_count"], r["total_retry_count"]) == (1.0, 2.0) and results.retry_metrics(rows.where("false")).first()["avg_retry_count"] == 0.0


def test_validity_and_reports(spark):
    ids = table(spark, [("a",), ("b",), ("c",)], "id string")
    assert dict(map(tuple, results.entry_validity(ids, table(spark, [("a", False), ("a", True), ("b", True)], "id string, valid boolean")).collect())) == {"a": False, "b": True, "c": True}
    report = table(spark, [(2, 1, ["a", "z"])], "submitted_instances int, resolved_instances int, resolved_ids array<string>")
    assert {tuple(r) for r in results.resolved(ids.limit(3), report).collect()} == {("a", True, 0.5), ("b", False, 0.5), ("c", False, 0.5)}
    none = table(spark, [(0, 0, [])], "submitted_instances int, resolved_instances int, resolved_ids array<string>")
    assert {r["primary"] for r in results.resolved(ids, none).collect()} == {None}


def test_merge_and_orders(spark, tmp_path):
    old = table(spark, [("x_52", 1, "old"), ("x_279", 1, "old"), ("x_52", 2, "older")], "id string, pos int, v string")
    new = table(spark, [("x_52", 0, "new")], "id string, pos int, v string")
    merged = results.upsert(old, new, "id", "pos")
    assert [(r["id"], r["v"]) for r in merged.orderBy(*results.natural_order(F.col("id"))).collect()] == [("x_52", "new"), ("x_279", "old")]
    writers.merge(old, new, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    assert table(spark, [("a_b_1",), ("q",)], "id string").select(results.category(F.col("id"))).first()[0] == "a_b"
    r = results.predictions(table(spark, [("i", None, 1), ("i", "p", 2), ("j", None, 1)], "instance_id string, model_patch string, pos int"), "m").orderBy("instance_id").collect()
    assert [tuple(x) for x in r] == [("i", "m", "p"), ("j", "m", "")]


def test_tool_scores(spark):
    rows = table(spark, [(["a"], ["a"], "x", True), (["a"], ["a"], "", True), (["b"], ["a"], "x", True), (["a"], ["a"], "x", False), ([], [], None, True)], "called array<string>, offered array<string>, answer string, finished boolean")
    got = [r["r"]["reason"] for r in rows.select(results.structural_pass(*(F.col(c) for c in rows.columns)).alias("r")).collect()]
    assert got == ["structural pass", "empty final answer", "hallucination", "no finish", "empty final answer"]
    r = results.tool_scores(table(spark, [(True, True, None, 3), (None, False, True, 1)], "structural boolean, cache boolean, gpt boolean, steps int")).first()
    assert (r["structural_pass_rate"], r["cache_pass_rate"], r["gpt_pass_rate"], r["avg_steps"]) == (0.5, 0.5, 1.0, 2.0)
    r = results.tool_scores(table(spark, [], "structural boolean, cache boolean, gpt boolean, steps int")).first()
    assert (r["n"], r["structural_pass_rate"], r["gpt_pass_rate"], r["avg_steps"]) == (0, 0.0, None, 0.0)


def test_load_time_and_tokens(spark):
    rows = results.share_load_time(table(spark, [("a", 0.0), ("b", 5.0)], "id string, load_sec double"), 2.0).collect()
    assert [r["load_sec"] for r in rows] == [1.0, 5.0]
    r = table(spark, [(1, 2, 0), (1, 2, 9), (1, 2, None)], "p int, g int, t int").select(results.total_tokens(F.col("p"), F.col("g"), F.col("t")).alias("x")).collect()
    assert [x["x"] for x in r] == [3, 9, 3]


def test_checks_of_generations(spark):
    df = frame_table(spark, {"ok": frames_of("gmt"), "bad": frames_of("gmr")}).withColumn("e", F.when(F.col("id") == "none", "x").cast("string"))
    shown = F.transform(validate.violations(F.col("frames"), allow_unresolved=True), validate.shown)
    got = one(df.withColumn("c", results.check_frames(shown, F.col("e"), validate.crashes(F.col("frames")))), "c")
    assert got["ok"]["valid"] and not got["bad"]["valid"] and got["bad"]["parsed_ok"]
    said = bridge.parse_generation(table(spark, [("a", "hi<|eot_id|>"), ("b", "hi"), ("c", '{"tool": "x"}<|eot_id|>'), ("d", '{"name": "x"}<|eom_id|>'), ("e", "<|eot_id|>")], "id string, g string"), "g")
    got = one(said.withColumn("c", results.check_chat(F.col("g"), F.col("call"), F.col("stop"))), "c")
    assert {k: (v["parsed_ok"], v["valid"]) for k, v in got.items()} == {"a": (True, True), "b": (False, False), "c": (True, False), "d": (True, True), "e": (True, False)}
    assert got["b"]["parse_error"] == "missing stop token"


def test_calls_as_text(spark):
    df = frame_table(spark, {"one": frames_of("at"), "two": frames_of("aa"), "none": frames_of("t"), "quote": [{"type": "action", "content": {"tool": 'a"b', "x": 1}}]})
    assert one(df.withColumn("c", results.encode_actions(F.col("frames"))), "c") == {"one": '{"name": "bash", "parameters": {"command": "ls"}}', "two": "[" + ", ".join(['{"name": "bash", "parameters": {"command": "ls"}}'] * 2) + "]", "none": "[]", "quote": '{"name": "a\\"b", "parameters": {"x": 1}}'}
    texts = ['{"name": "f", "parameters": {"a": 1}}', '[{"tool": "f", "arguments": "{}"}, {"x": 1}]', '{"name": "f"};{"name": "g"}', "[]", None, "f(x)", '{"name": "f", "parameters": {"a": ";"}}']
    got = [r["d"] for r in table(spark, list(enumerate(texts)), "i int, t string").orderBy("i").select(tools.decode_result(F.col("t")).alias("d")).collect()]
    assert [[(c["name"], c["args"]) for c in d["calls"]] if d["calls"] is not None else "error" for d in got] == [[("f", '{"a": 1}')], [("f", "{}")], [("f", "{}"), ("g", "{}")], [], [], "error", "error"]
    r = table(spark, [(["f(1)", "g"], [" out ", "", "more"])], "c array<string>, o array<string>").select(results.execution_results(F.col("c"), F.col("o")).alias("r")).first()["r"]
    assert [tuple(x) for x in r] == [("f", "out"), ("g", None)]
    assert tools.plain_schemas([{"name": "f", "parameters": {"type": "dict", "properties": {"a": {}}}}, {"x": 1}, {"name": "g", "description": None}]) == [{"name": "f", "description": "", "parameters": {"type": "object", "properties": {"a": {}}}}, {"name": "g", "description": "", "parameters": {"type": "object", "properties": {}, "required": []}}]


def test_streaks(spark):
    rows = table(spark, [("r", i, c) for i, c in enumerate(["a", "a", "", "a", "b", None, "b", "a"])], "run string, i int, c string")
    got = results.repeats(rows, "run", "i", "c").orderBy("i").collect()
    assert [(r["streak"], r["repeated"]) for r in got] == [(1, False), (2, False), (0, False), (3, True), (1, False), (0, False), (2, False), (1, False)]


def test_lookups(spark):
    keys = table(spark, [("101",), ("103",), ("7",), ("99",), ("x",)], "key string")
    got = dict(map(tuple, lookups.resolve(keys, table(spark, [("x", 1), ("x", 4)], "key string, index int"), table(spark, [("101", 0), ("103", 2)], "key string, index int"), 10).collect()))
    assert got == {"101": 0, "103": 2, "7": 7, "99": None, "x": 4}
    r = table(spark, [("get",), ("",), ("zz",)], "n string").select(lookups.by_suffix(F.col("n"), F.array(F.lit("a_set"), F.lit("b_get"), F.lit("get"))).alias("f")).collect()
    assert [x["f"] for x in r] == ["b_get", "a_set", None]
    ids = lookups.pinned(spark, ["b", "a"])
    data = table(spark, [("a", 1), ("b", 2), ("b", 3), ("c", 4)], "id string, v int")
    assert [(r["id"], r["v"]) for r in lookups.subset(data, ids, order="v").collect()] == [("b", 3), ("a", 1)] and lookups.wanted(data, ids).count() == 3
    with pytest.raises(KeyError):
        lookups.subset(data, lookups.pinned(spark, ["zz"]))
    with pytest.raises(TypeError):
        lookups.pinned(spark, [1])
    r = spark.range(1).select(lookups.all_listed(F.array(F.lit("a")), F.create_map(F.lit("a"), F.lit(1))).alias("y"), lookups.all_listed(F.array(F.lit("b")), F.create_map(F.lit("a"), F.lit(1))).alias("n")).first()
    assert (r["y"], r["n"]) == ([1], None)


def test_cache(spark):
    calls = table(spark, [("c", "t", "a", '{"é": 1}'), ("c", "t", "b", "")], "category string, tool string, api string, tool_input string")
    key = hashlib.sha256(json.dumps({"category": "c", "tool_name": "t", "api_name": "a", "tool_input": '{"é": 1}'}, sort_keys=True).encode()).hexdigest()
    hit, miss = lookups.cached(calls, table(spark, [(key, None, "ok")], "key string, error string, response string"))
    assert [(r["api"], r["error"], r["response"]) for r in hit.collect()] == [("a", "", "ok")] and [r["api"] for r in miss.collect()] == ["b"]


def test_tool_steps(spark):
    rows = [("get", "a_get", None, "ok"), ("get", "a_get", "Message error...", "x" * 2000), ("zz", None, None, None), ("Finish", None, None, "done"), ("Finish", None, None, "")]
    df = table(spark, [(i, *r) for i, r in enumerate(rows)], "i int, action string, found string, error string, response string").orderBy("i")
    got = [tuple(r["s"]) for r in df.select(lookups.tool_step(*(F.col(c) for c in ("action", "found", "error", "response"))).alias("s")).collect()]
    assert got[0] == ('{"error": "", "response": "ok"}', 0) and len(got[1][0]) == 1027 and got[1][1] == 11
    assert got[2:] == [('{"error": "No such function name: zz", "response": ""}', 1), ("done", 3), ("", 4)]


def test_matrix(spark, tmp_path):
    cells = lookups.cells(spark, list(matrix.SUITES), ["frames", "chat"], {"frames": "o/f", "chat": "o/c"})
    assert cells.count() == 8
    with pytest.raises(ValueError):
        lookups.cells(spark, ["a"], ["zz"], {})
    given = {
        ("bfcl", "chat"): {"meta": {"model": "o/c", "num_run": 45, "sample_seed": 0}, "metrics": {"accuracy": 0.6, "avg_retry_count": 1.25, "n": 45, "avg_total_tokens": 14267.5}}, ("swe", "frames"): {"meta": {}, "metrics": {"n": 3}},
        ("format_validity", "frames"): {"metrics": {"valid_rate": True, "parse_rate": None}}, ("other", "chat"): {"metrics": {"other_primary": 2}},
    }
    for (suite, fmt), payload in given.items():
        (tmp_path / suite / fmt).mkdir(parents=True)
        (tmp_path / suite / fmt / "summary.json").write_text(json.dumps(payload))
    (tmp_path / "toolbench" / "chat").mkdir(parents=True)
    (tmp_path / "toolbench" / "chat" / "summary.json").write_text("{bad")
    rows = matrix.rows(readers.summaries(spark, str(tmp_path)))
    got = {(r["suite"], r["format"]): r for r in rows.collect()}
    assert got["bfcl", "chat"]["primary"] == 0.6 and got["bfcl", "chat"]["sample_seed"] == 42 and got["swe", "frames"]["primary"] == 0.0 and got["swe", "frames"]["num_run"] == 3
    assert got["format_validity", "frames"]["primary"] == 1.0 and got["other", "chat"]["primary"] == 2.0 and len(got) == 4
    text = matrix.markdown(rows, list(matrix.SUITES), ["frames", "chat"])
    assert "| bfcl | chat | c | 45 | 60.0% (accuracy) | 1.2 (avg_retry_count) | 14268 | — | — |" in text and "- `toolbench/chat`" in text
    assert [(r["suite"], r["format"]) for r in lookups.missing_cells(cells, rows).collect()][0] == ("format_validity", "chat")


def test_envelope(spark, tmp_path):
    tasks = table(spark, [("a", "x", True, 100, 1, 1.0, 0.5, True, True, None, [])], TASKS)
    writers.benchmark({"model": "m"}, results.efficiency(tasks), tasks, str(tmp_path / "b"))
    at = tmp_path / "b"
    said = json.loads((at / "summary.json").read_text())
    assert said["meta"] == {"model": "m"} and said["metrics"]["n"] == 1 and [t["task_id"] for t in said["tasks"]] == ["a"]
    assert spark.read.json(str(at / "details.jsonl")).count() == 1


def test_what_is_written_can_be_read(spark, tmp_path):
    tasks = table(spark, [("a", "x", True, 100, 1, 1.0, 0.5, True, True, None, []), ("b", "x", False, 50, 1, 1.0, 0.5, True, True, None, [])], TASKS)
    writers.benchmark({"model": "m", "num_run": 2}, results.efficiency(tasks), tasks, str(tmp_path / "bfcl" / "chat"))
    writers.benchmark({}, results.efficiency(tasks.limit(0)), tasks.limit(0), str(tmp_path / "swe" / "chat"))
    got = {r["suite"]: r for r in readers.summaries(spark, str(tmp_path)).collect()}
    assert got["bfcl"]["meta"]["model"] == "m" and got["bfcl"]["metrics"]["success_rate"] == "0.5" and got["swe"]["metrics"]["n"] == "0"
    back = readers.summary_tasks(spark, str(tmp_path), "task_id string, success boolean").collect()
    assert sorted((r["suite"], r["task_id"], r["success"]) for r in back) == [("bfcl", "a", True), ("bfcl", "b", False)]
    assert readers.summaries(spark, str(tmp_path / "none")).count() == 0


def test_labels(spark):
    df = table(spark, [([10, 1, 2, 20, 3],), ([1, 20, 10],), ([],)], "ids array<int>")
    got = [r["x"] for r in df.select(labels.mask_runtime(F.col("ids"), [10, 20], [10]).alias("x")).collect()]
    assert got == [[-100, -100, -100, 20, 3], [-100, 20, -100], []]
    turns = df.limit(1).select(F.array(*map(F.lit, [1, 7, 2, 5, 6, 3, 1, 8, 2, 9, 3, 1, 7, 2, 4])).alias("ids"))
    assert turns.select(labels.mask_assistant(F.col("ids"), [1], [2], [3], [7]).alias("x")).first()["x"] == [-100, -100, -100, 5, 6, 3, -100, -100, -100, -100, -100, -100, -100, -100, 4]
    assert df.limit(1).select(labels.mask_assistant(F.col("ids"), [10], [1], [20], []).alias("x")).first()["x"] == [-100, -100, 2, 20, -100]


def test_tokenize_and_collate(spark):
    from frameloom.functions.schema import SLOT, TOKEN, reserved

    def encode(wire):
        ids = []
        while wire:
            for t, slot in SLOT.items():
                if wire.startswith(reserved(slot)):
                    ids, wire = [*ids, TOKEN[t]], wire[len(reserved(slot)) :]
                    break
            else:
                ids, wire = [*ids, ord(wire[0])], wire[1:]
        return ids

    df = frame_table(spark, {"a": frames_of("gmk"), "b": frames_of("gm"), "c": []})
    out = labels.tokenize(df, encode).collect()
    assert [r["id"] for r in out] == ["a"] and out[0]["labels"][-11:] == [TOKEN["think"], *map(ord, "think text")] and set(out[0]["labels"][:-11]) == {-100}
    assert labels.tokenize(df, encode, max_length=10).count() == 0
    batch = table(spark, [(1, [1, 2], [1, 2], [1, 1]), (1, [3], [3], [1]), (2, [], [], [])], "b int, input_ids array<int>, labels array<int>, attention_mask array<int>")
    got = sorted(map(tuple, labels.collate(batch, "b", 9).select("input_ids", "labels", "attention_mask").collect()))
    assert got == [([1, 2], [1, 2], [1, 1]), ([3, 9], [3, -100], [1, 0])]


def test_vectors(spark):
    rows = table(spark, [(1, [1.0, 2.0]), (2, [3.0, 6.0]), (3, None)], "row_id int, embedding array<float>")
    seeds = table(spark, [("t", 1), ("t", 2), ("t", 2), ("u", 3)], "target string, row_id int")
    (r,) = vectors.seeded(seeds, rows).collect()
    assert r["target"] == "t" and [round(x, 4) for x in r["mean"]] == [2.3333, 4.6667]
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.5))
    r = spark.range(1).select(vectors.norm(a).alias("n"), vectors.max_abs_error(a, b).alias("e"), vectors.check(a, b, F.lit(1.0)).alias("c"), vectors.check(a, a, F.lit(4.0)).alias("ok")).first()
    assert (r["n"], r["e"], r["c"], r["ok"]) == (5.0, 0.5, ["error", "ratio"], [])
