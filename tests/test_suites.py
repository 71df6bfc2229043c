"""P07-P09, J06, A11, C13, F24, O02, X01-X04, K09."""

import json

import pytest
from helpers import frame_table, frames_of
from pyspark.sql import functions as F

from frameloom.__main__ import main
from frameloom.operators import results, suites
from frameloom.plans import etl


def by_id(df):
    return {r["task_id"]: r for r in df.collect()}


def test_function_calls(spark):
    rows = spark.createDataFrame([("multi_turn_base_1", None, [["a", "b"]], 10, 5, 2.0), ("simple_2", "[]", None, None, 1, None)], "id string, result string, turns array<array<string>>, input_token_count int, output_token_count int, latency double")
    got = by_id(suites.function_calls(rows, spark.createDataFrame([("simple_2", True)], "id string, valid boolean")))
    m = got["multi_turn_base_1"]
    assert (m["domain"], m["success"], m["metrics"]["retry_steps"], m["tokens"]["total_tokens"], m["timing"]["total_sec"]) == ("multi_turn_base", None, "1", 15, 2.0) and json.loads(m["metrics"]["result"]) == [["a", "b"]]
    assert got["simple_2"]["success"] is True and got["simple_2"]["metrics"]["result"] == "[]" and got["simple_2"]["timing"]["inference_sec"] == 0.0


def test_tool_runs_and_patches(spark):
    schema = "id string, group string, steps int, stopped_on string, final_answer string, input_token_count int, output_token_count int, latency double, tool_sec double, total_sec double"
    rows = spark.createDataFrame([("1", None, 3, "terminal_action", "x", 1, 2, 4.0, 1.0, None), ("2", "G2", None, None, None, None, None, None, None, 9.0)], schema)
    got = by_id(suites.tool_runs(rows, spark.createDataFrame([("1", True, True, None, "structural pass")], "id string, structural boolean, cache boolean, gpt boolean, reason string")))
    assert got["1"]["domain"] == "G1_instruction" and got["1"]["success"] and got["1"]["timing"]["total_sec"] == 4.0 and "gpt_pass" not in got["1"]["metrics"] and got["1"]["detail"] == {"final_answer": "x", "score_reason": "structural pass"}
    assert got["2"]["success"] is False and got["2"]["domain"] == "G2" and got["2"]["timing"]["total_sec"] == 9.0 and got["2"]["metrics"]["steps"] == "0"
    rows = spark.createDataFrame([("i", "submitted", 4, "p", 1, 2, 3.0), ("j", "no_action", 1, "", 1, 2, None)], "instance_id string, stopped_on string, iterations int, model_patch string, prompt_tokens int, generated_tokens int, inference_sec double")
    got = by_id(suites.patches(rows, spark.createDataFrame([("i", True)], "id string, resolved boolean")))
    assert got["i"]["success"] is True and got["j"]["success"] is None and (got["i"]["metrics"]["submitted"], got["j"]["metrics"]["submitted"]) == ("true", "false")


def test_formats_flow_into_the_metrics(spark):
    check = F.struct(F.col("ok").alias("parsed_ok"), F.col("ok").alias("valid"), F.lit(None).cast("string").alias("parse_error"), F.when(F.col("ok"), F.array().cast("array<string>")).otherwise(F.array(F.lit("[r] frame 1: m"))).alias("errors"))
    rows = spark.createDataFrame([("a", "x", False, True), ("b", "", False, False), ("c", "x", True, None)], "id string, domain string, skipped boolean, ok boolean")
    rows = rows.select("id", "domain", "skipped", check.alias("check"), F.repeat(F.lit("g"), 300).alias("generated"), F.lit(10).alias("prompt_tokens"), F.lit(2).alias("generated_tokens"), F.lit(1.0).alias("inference_sec"))
    tasks = suites.formats(rows)
    got = by_id(tasks)
    assert got["c"]["metrics"] == {"skipped": "true"} and got["c"]["success"] is False and got["b"]["domain"] == "unknown" and len(got["a"]["detail"]["generated_text_preview"]) == 200
    flat = suites.flat(tasks)
    assert [tuple(r) for r in results.failure_modes(flat).collect()] == [("validation: [r] frame 1", 1)]
    assert {r["domain"]: (r["n"], r["valid"]) for r in results.format_rates(flat).where("not whole").collect()} == {"x": (2, 1), "unknown": (1, 0)}
    assert tuple(suites.tally(tasks).first()) == (3, 1)
    suite = suites.Suite("format_validity", lambda r: r, lambda r, _: suites.formats(r), lambda r: r.agg(F.count("*").alias("seen")))
    assert suite.run(rows)[1].first()["seen"] == 3


def test_evaluation_rows(spark):
    df = frame_table(spark, {f"r{i}": frames_of("gm" if i % 3 == 0 else "gmt") for i in range(9)})
    from frameloom.operators.dataset import evaluable

    rows, n, ok, k = suites.evaluation_rows(df, evaluable(F.col("frames")), 4)
    assert (n, ok, k, rows.count()) == (9, 6, 4, 4) and suites.evaluation_rows(df, evaluable(F.col("frames")))[3] == 6
    with pytest.raises(ValueError):
        suites.evaluation_rows(df, F.lit(False))


def test_preludes(spark):
    df = spark.createDataFrame([(" fix {task} ",)], "p string")
    r = df.select(suites.prelude(F.lit("be good"), suites.instance_mission("do: {task}.", F.col("p"))).alias("f")).first()["f"]
    assert [(f["type"], f["text"]) for f in r] == [("goal", "be good"), ("mission", "do: fix {task}.")]
    good, blank = suites.instances(spark.createDataFrame([(1, " x "), (2, "  "), (3, None)], "id int, p string"), "do {task}", "p")
    assert [(r["id"], r["mission"]) for r in good.collect()] == [(1, "do x")]
    assert sorted((r["id"], r["reason"]) for r in blank.collect()) == [(2, "instance without a problem statement"), (3, "instance without a problem statement")]
    assert frame_table(spark, {"a": [*frames_of("at"), {"type": "action", "content": 5}]}).select(F.size(suites.action_contents(F.col("frames"))).alias("n")).first()["n"] == 2


def test_plans(spark, tmp_path, capsys):
    (tmp_path / "raw.jsonl").write_text("\n".join(json.dumps({"id": str(i), "domain": "d", "frames": [*frames_of("g"), {"type": "mission", "content": f"m{i % 15}"}, *frames_of("t")]}) for i in range(20)) + "\n{bad")
    assert main(["clean", str(tmp_path / "raw.jsonl"), str(tmp_path / "out")]) == 0 and "|d     |15 |" in capsys.readouterr().out
    assert {r["split"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out" / "data")).groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 14, "eval": 1}
    (tmp_path / "runs" / "swe" / "chat").mkdir(parents=True)
    (tmp_path / "runs" / "swe" / "chat" / "summary.json").write_text(json.dumps({"metrics": {"resolved_rate": 0.5}}))
    assert main(["rollup", str(tmp_path / "runs"), "--format", "frames=a", "--format", "chat=b", "--markdown", str(tmp_path / "m.md")]) == 0
    assert "50.0% (resolved_rate)" in (tmp_path / "m.md").read_text()
    fresh = spark.createDataFrame([("k", "", "new"), ("old", "", "x")], "key string, error string, response string")
    etl.write_through(fresh, spark.createDataFrame([("old", "", "o")], fresh.schema), str(tmp_path / "cache"))
    assert [r["key"] for r in spark.read.parquet(str(tmp_path / "cache")).collect()] == ["k"]
