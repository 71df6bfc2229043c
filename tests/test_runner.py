"""Suites over recorded rows, and the commands."""

import json

import pytest
from pyspark.sql import functions as F

from frameloom import __main__ as cli
from frameloom.plans import runner
from frameloom.sources import readers

SWE = [{"instance_id": f"s{i}", "stopped_on": "submitted", "iterations": i, "model_patch": "d" if i % 2 else None, "prompt_tokens": 10, "generated_tokens": i, "inference_sec": 1.5} for i in range(6)]


def put(folder, rows, scores=None):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "rows.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    if scores is not None:
        (folder / "scores.jsonl").write_text("".join(json.dumps(r) + "\n" for r in scores))


def metrics(spark, root):
    return {(r["suite"], r["format"]): r["metrics"] for r in readers.summaries(spark, str(root)).collect()}


def test_a_run_is_taken_up_where_it_was(spark, tmp_path):
    cell, recorded, root = runner.Cell("swe", "chatml", "m"), tmp_path / "rec", tmp_path / "out"
    put(recorded, SWE[:4], [{"id": "s0", "resolved": True}, {"id": "s1", "resolved": False}])
    got = {r["task_id"]: r["success"] for r in runner.run_suite(spark, cell, str(recorded), str(root)).collect()}
    assert got == {"s0": True, "s1": False, "s2": None, "s3": None}
    # what has a verdict keeps it; what had none, and what is new, is scored
    put(recorded, [*SWE, SWE[0]], [{"id": f"s{i}", "resolved": i > 2} for i in range(5)])
    got = {r["task_id"]: r["success"] for r in runner.run_suite(spark, cell, str(recorded), str(root)).collect()}
    assert got == {"s0": True, "s1": False, "s2": False, "s3": True, "s4": True, "s5": None}
    found = metrics(spark, root)["swe", "chatml"]
    assert float(found["avg_iterations"]) == 2.5 and float(found["resolved_rate"]) == 0.6 and found["n"] == "6"
    listed = readers.summary_tasks(spark, str(root), "task_id string, success boolean")
    assert listed.count() == 6 and sorted(p.name for p in (root / "swe").iterdir()) == ["chatml"]
    again = runner.run_suite(spark, cell, str(recorded), str(root), resume=False).where("task_id = 's0'").first()
    assert again["success"] is False
    assert runner.run_suite(spark, cell, str(recorded), str(root), score=False, resume=False).where("success is not null").count() == 0


def test_no_rows(spark, tmp_path):
    put(tmp_path / "rec", [], [])
    assert runner.run_suite(spark, runner.Cell("swe", "chatml", "m"), str(tmp_path / "rec"), str(tmp_path / "out")).count() == 0
    assert float(metrics(spark, tmp_path / "out")["swe", "chatml"]["avg_iterations"]) == 0


def test_all_cells(spark, tmp_path):
    models = {"frames": "a", "chatml": "c"}
    chosen = runner.cells(["swe", "format_validity"], list(models), models)
    assert [(c.suite, c.format, c.model) for c in chosen] == [("swe", "frames", "a"), ("swe", "chatml", "c"), ("format_validity", "frames", "a"), ("format_validity", "chatml", "c")]
    for names, formats, said in ((["zz"], ["chatml"], "unknown suite"), (["swe"], ["zz"], "no model")):
        with pytest.raises(ValueError, match=said):
            runner.cells(names, formats, models)
    recorded, root = tmp_path / "rec", tmp_path / "out"
    put(recorded / "swe" / "chatml", SWE, [])
    put(recorded / "format_validity" / "frames", [{"id": "1", "domain": "d", "check": {"parsed_ok": True, "valid": True}, "generated": "g"}, {"id": "2", "skipped": True}])
    assert [r.tasks for r in runner.run_all(spark, chosen, str(recorded), str(root), dry_run=True)] == [None] * 4 and not root.exists()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        runner.run_all(spark, chosen, str(recorded), str(root))
    ran = runner.run_all(spark, chosen, str(recorded), str(root), continue_on_error=True)
    assert [bool(r.error) for r in ran] == [True, False, False, True]
    assert {r["task_id"]: r["success"] for r in ran[2].tasks.collect()} == {"1": True, "2": False} and set(metrics(spark, root)) == {("swe", "chatml"), ("format_validity", "frames")}


def test_commands(spark, tmp_path, capsys):
    recorded, root = tmp_path / "rec", tmp_path / "out"
    put(recorded / "swe" / "chatml", SWE, [{"id": "s1", "resolved": True}])
    where = [str(recorded), str(root)]
    assert cli.main(["eval-run-all", *where, "--suites", "swe", "--format", "chatml=m", "--dry-run"]) == 0 and "not run" in capsys.readouterr().out
    assert cli.main(["eval-benchmarks", str(recorded / "swe" / "chatml"), str(root), "--suite", "swe", "--format", "chatml", "--model", "m", "--score-only"]) == 0
    assert cli.main(["eval-run-all", *where, "--suites", "swe", "bfcl", "--format", "chatml=m", "--continue-on-error"]) == 1
    assert "bfcl / chatml / m: failed" in capsys.readouterr().out
    assert cli.main(["eval-aggregate", str(root), "--format", "chatml=m", "--markdown", str(tmp_path / "t.md")]) == 0 and "swe" in (tmp_path / "t.md").read_text()
    bad = ["eval-benchmarks", *where, "--format", "chatml", "--model", "m", "--suite"]
    for wrong in (["nothing"], [*bad, "toolbench", "--score-only"], [*bad, "swe", "--score-only", "--no-score"], [*bad, "zz"]):
        with pytest.raises(SystemExit) as e:
            cli.main(wrong)
        assert e.value.code
    (tmp_path / "generated.txt").write_text('text\n{"id": 1}\n{bad\n {"id": 2}\n')
    assert cli.main(["data-append", str(tmp_path / "generated.txt"), str(tmp_path / "lines"), "--target-lines", "5"]) == 0 and "3 lines to go" in capsys.readouterr().out


def test_vectors_by_command(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("targets", "vocabulary", "vectors", "out", "checked")}
    spark.createDataFrame([("t", "think", 0), ("t", "plan", 1)], "target string, word string, pos int").write.parquet(at["targets"])
    spark.createDataFrame([(" think", 1), (" plan", 2)], "piece string, row_id int").write.parquet(at["vocabulary"])
    rows = [(1, None, [1.0, 3.0]), (2, None, [3.0, 5.0]), (9, "t", [2.0, 4.0])]
    spark.createDataFrame(rows, "row_id int, target string, embedding array<double>").write.parquet(at["vectors"])
    tables = [at["targets"], at["vocabulary"], at["vectors"]]
    assert cli.main(["seed-rows", *tables, at["out"]]) == 0 and spark.read.parquet(at["out"]).first()["mean"] == [2.0, 4.0]
    assert cli.main(["verify-rows", *tables, at["checked"]]) == 0
    spark.read.parquet(at["vectors"]).withColumn("embedding", F.transform("embedding", lambda x: x + 1)).where("target is not null").unionByName(spark.read.parquet(at["vectors"]).where("target is null")).write.parquet(at["vectors"] + "2")
    assert cli.main(["verify-rows", *tables[:2], at["vectors"] + "2", at["checked"]]) == 1
