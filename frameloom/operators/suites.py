"""Benchmark suites over recorded rows: from a suite's rows and scores to one table of task results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions import text
from frameloom.functions.schema import frame
from frameloom.operators import dataset, results


def _whole(name: str) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))


def _seconds(*names: str) -> Column:
    """The first of the columns that is neither null nor 0; 0 if none is."""
    return F.coalesce(*(F.nullif(F.col(n).cast("double"), F.lit(0.0)) for n in names), F.lit(0.0))


def task(task_id: Column, domain: Column, success: Column, metrics: dict[str, Column], detail: dict[str, Column], prompt: str, generated: str, inference: Column, total: Column, tool: Column | None = None) -> list[Column]:
    """The columns of a task result. A metric that is null is not in the map."""

    def mapping(items: dict[str, Column]) -> Column:
        if not items:
            return F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
        whole = F.create_map(*(x for k, v in items.items() for x in (F.lit(k), v.cast("string"))))
        return F.map_filter(whole, lambda _, v: v.isNotNull())

    zero = F.lit(0.0)
    return [
        task_id.cast("string").alias("task_id"), domain.alias("domain"), success.alias("success"), mapping(metrics).alias("metrics"),
        F.struct(zero.alias("load_sec"), inference.alias("inference_sec"), (tool if tool is not None else zero).alias("tool_sec"), total.alias("total_sec")).alias("timing"),
        F.struct(_whole(prompt).alias("prompt_tokens"), _whole(generated).alias("generated_tokens"), (_whole(prompt) + _whole(generated)).alias("total_tokens")).alias("tokens"), mapping(detail).alias("detail"),
    ]


def function_calls(rows: DataFrame, validity: DataFrame) -> DataFrame:
    """Task results of rows(id, result, turns, input_token_count, output_token_count, latency) and validity(id, valid). A row without a verdict is not scored."""
    known = rows.join(validity.select("id", "valid"), "id", "left")
    retry = results.retries(F.col("id"), F.col("turns"))
    shown = F.coalesce("result", F.to_json("turns"))
    return known.select(*task(F.col("id"), results.category(F.col("id")), F.col("valid"), {"retry_steps": retry, "result": shown}, {}, "input_token_count", "output_token_count", _seconds("latency"), _seconds("latency")))


def tool_runs(rows: DataFrame, scores: DataFrame, group: str = "G1_instruction") -> DataFrame:
    """Task results of rows(id, group, steps, stopped_on, final_answer, token counts, latency, tool_sec, total_sec) and scores(id, structural, cache, gpt, reason). A row without a score fails."""
    known = rows.join(scores.select("id", "structural", "cache", "gpt", "reason"), "id", "left")
    ok = F.coalesce("structural", F.lit(False))
    metrics = {"structural_pass": ok, "cache_pass": F.coalesce("cache", F.lit(False)), "gpt_pass": F.col("gpt"), "steps": F.coalesce("steps", F.lit(0)), "stopped_on": F.col("stopped_on")}
    detail = {"final_answer": F.col("final_answer"), "score_reason": F.col("reason")}
    domain = F.coalesce(F.nullif("group", F.lit("")), F.lit(group))
    return known.select(*task(F.col("id"), domain, ok, metrics, detail, "input_token_count", "output_token_count", _seconds("latency"), _seconds("total_sec", "latency"), _seconds("tool_sec")))


def patches(rows: DataFrame, report: DataFrame, domain: str = "swe_bench_lite") -> DataFrame:
    """Task results of rows(instance_id, stopped_on, iterations, model_patch, prompt_tokens, generated_tokens, inference_sec) and report(id, resolved). A row that the report lacks is not scored."""
    known = rows.join(report.select(F.col("id").alias("instance_id"), "resolved"), "instance_id", "left")
    metrics = {"stopped_on": F.col("stopped_on"), "iterations": F.col("iterations"), "submitted": F.coalesce("model_patch", F.lit("")) != ""}
    return known.select(*task(F.col("instance_id"), F.lit(domain), F.col("resolved"), metrics, {}, "prompt_tokens", "generated_tokens", _seconds("inference_sec"), _seconds("inference_sec")))


def formats(rows: DataFrame) -> DataFrame:
    """Task results of rows(id, domain, skipped, check struct<parsed_ok, valid, parse_error, errors>, generated, prompt_tokens, generated_tokens, inference_sec). Skipped rows fail, with that as their only metric."""
    skipped = F.coalesce("skipped", F.lit(False))
    unless = lambda c: F.when(~skipped, c)
    metrics = {"parsed_ok": unless(F.col("check.parsed_ok")), "structurally_valid": unless(F.col("check.valid")), "skipped": F.when(skipped, True)}
    detail = {"parse_error": unless(F.col("check.parse_error")), "validation_errors": unless(F.to_json("check.errors")), "generated_text_preview": unless(F.substring("generated", 1, 200))}
    domain = F.coalesce(F.nullif("domain", F.lit("")), F.lit("unknown"))
    success = F.when(skipped, False).otherwise(F.col("check.valid"))
    return rows.select(*task(F.col("id"), domain, success, metrics, detail, "prompt_tokens", "generated_tokens", _seconds("inference_sec"), _seconds("inference_sec")))


def flat(tasks: DataFrame) -> DataFrame:
    """Task results with the columns that results.efficiency, format_rates and failure_modes read."""
    yes = lambda k: F.coalesce(F.col("metrics")[k] == "true", F.lit(False))
    return tasks.select(
        "task_id", "domain", "success", "tokens.*", "timing.*", yes("parsed_ok").alias("parsed_ok"), yes("structurally_valid").alias("valid"), F.col("detail")["parse_error"].alias("parse_error"),
        F.from_json(F.col("detail")["validation_errors"], "array<string>").alias("errors"),
    )


def tally(tasks: DataFrame) -> DataFrame:
    """One row: how many tasks there are, and how many passed."""
    return tasks.agg(F.count("*").alias("n"), F.count_if("success").alias("passed"))


def evaluation_rows(df: DataFrame, good: Column, k: int = -1, seed: int = 42, key: str = "id") -> tuple[DataFrame, int, int, int]:
    """(rows to evaluate, all rows, rows that can be evaluated, rows chosen): those where good holds, k of them by a hash, all for a negative k. None raises."""
    counts = df.agg(F.count("*").alias("n"), F.count_if(good).alias("ok")).first()
    if not counts["ok"]:
        raise ValueError("no row can be evaluated")
    fit = df.where(good)
    chosen = counts["ok"] if k < 0 else min(k, counts["ok"])
    return (fit if chosen == counts["ok"] else dataset.sample(fit, chosen, seed, key)), counts["n"], counts["ok"], chosen


def prelude(goal: Column, mission: Column) -> Column:
    """A goal and a mission as frames."""
    return F.array(frame("goal", goal), frame("mission", mission))


def instance_mission(template: str, problem: Column) -> Column:
    """The template with the stripped problem in place of {task}; null for a blank problem."""
    stripped = text.strip(F.coalesce(problem, F.lit("")))
    return F.when(stripped != "", F.replace(F.lit(template), F.lit("{task}"), stripped))


def instances(rows: DataFrame, template: str, problem: str = "problem_statement") -> tuple[DataFrame, DataFrame]:
    """(rows with a mission, rows without a problem and why): a blank problem is set aside and ends no other row."""
    known = rows.withColumn("mission", instance_mission(template, F.col(problem)))
    return known.where("mission is not null"), known.where("mission is null").drop("mission").withColumn("reason", F.lit("instance without a problem statement"))


def action_contents(frames: Column) -> Column:
    """JSON of the objects that a step's actions hold."""
    return F.transform(F.filter(frames, lambda f: (f["type"] == "action") & (f["kind"] == "object")), lambda f: f["json"])


@dataclass(frozen=True)
class Suite:
    """A suite's steps: rows and their scores to task results, and the metrics beside efficiency."""

    name: str
    score: Callable[[DataFrame], DataFrame]
    to_tasks: Callable[[DataFrame, DataFrame], DataFrame]
    metrics: Callable[[DataFrame], DataFrame] | None = None

    def run(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(task results, one row of metrics)."""
        tasks = self.to_tasks(rows, self.score(rows))
        efficiency = results.efficiency(flat(tasks))
        return tasks, efficiency if self.metrics is None else efficiency.crossJoin(F.broadcast(self.metrics(rows)))
