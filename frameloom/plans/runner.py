"""Runs of suites over recorded rows: score what has not been scored, write the envelope, go through all cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.schema import TASK_RESULT
from frameloom.operators import suites
from frameloom.sources import readers, writers

_TOKENS = "prompt_tokens bigint, generated_tokens bigint"
#: The columns of each suite's recorded rows, and of its recorded scores.
ROWS = {
    "bfcl": "id string, result string, turns array<array<string>>, input_token_count bigint, output_token_count bigint, latency double",
    "toolbench": "id string, group string, steps bigint, stopped_on string, final_answer string, input_token_count bigint, output_token_count bigint, latency double, tool_sec double, total_sec double",
    "swe": f"instance_id string, stopped_on string, iterations bigint, model_patch string, {_TOKENS}, inference_sec double",
    "format_validity": f"id string, domain string, skipped boolean, check struct<parsed_ok:boolean,valid:boolean,parse_error:string,errors:array<string>>, generated string, {_TOKENS}, inference_sec double",
}
SCORES = {"bfcl": "id string, valid boolean", "toolbench": "id string, structural boolean, cache boolean, gpt boolean, reason string", "swe": "id string, resolved boolean"}
KEY = {"swe": "instance_id"}


def _swe(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.coalesce("iterations", F.lit(0))), F.lit(0.0)).alias("avg_iterations"))


TO_TASKS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"bfcl": suites.function_calls, "toolbench": suites.tool_runs, "swe": suites.patches, "format_validity": lambda rows, _: suites.formats(rows)}


@dataclass(frozen=True)
class Cell:
    """A suite in a format, and the model whose rows are recorded."""

    suite: str
    format: str
    model: str


def cells(names: Sequence[str], formats: Sequence[str], models: dict[str, str]) -> list[Cell]:
    """Each suite with each format, suite by suite. An unknown suite and a format without a model are refused."""
    if unknown := [s for s in names if s not in ROWS]:
        raise ValueError(f"unknown suite: {', '.join(unknown)}")
    if lost := [f for f in formats if f not in models]:
        raise ValueError(f"no model configured for format: {', '.join(lost)}")
    return [Cell(s, f, models[f]) for s in names for f in formats]


def _rename(spark: SparkSession, old: str, new: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(sc._jsc.hadoopConfiguration())
    fs.delete(path(new), True)
    if not fs.rename(path(old), path(new)):
        raise OSError(f"{old} could not be renamed")


def run_suite(spark: SparkSession, cell: Cell, recorded: str, root: str, score: bool = True, resume: bool = True, meta: dict[str, object] | None = None) -> DataFrame:
    """Scores a cell's recorded rows and writes <root>/<suite>/<format>; returns its task results.

    recorded/rows.jsonl holds the rows, recorded/scores.jsonl what graders said of them (none, or not score: nothing is
    scored). With resume, rows that details.jsonl has already are not scored again, but for those that had no verdict. The envelope
    is written beside the old one and put in its place when it is whole. Of rows with one id one counts. No rows: an empty run.
    """
    key, at = KEY.get(cell.suite, "id"), f"{root}/{cell.suite}/{cell.format}"
    rows = spark.read.schema(ROWS[cell.suite]).json(f"{recorded}/rows.jsonl").dropDuplicates([key])
    scored = score and cell.suite in SCORES and readers._there(spark, f"{recorded}/scores.jsonl")
    scores = spark.read.schema(SCORES[cell.suite]).json(f"{recorded}/scores.jsonl").dropDuplicates(["id"]) if scored else spark.createDataFrame([], SCORES.get(cell.suite, "id string"))
    done = spark.read.schema(TASK_RESULT).json(f"{at}/details.jsonl") if resume and readers._there(spark, f"{at}/details.jsonl") else spark.createDataFrame([], TASK_RESULT)
    settled = done.where("success is not null")
    fresh = rows.join(settled.select(F.col("task_id").alias(key)), key, "left_anti")
    tasks = settled.unionByName(TO_TASKS[cell.suite](fresh, scores))
    # read once more for the numbers, from what has been written
    beside = f"{at}.next"
    tasks.select(F.to_json(F.struct(*tasks.columns), {"ignoreNullFields": "false"}).alias("j")).write.mode("overwrite").text(f"{beside}/tasks")
    written = spark.read.schema(TASK_RESULT).json(f"{beside}/tasks")
    metrics = suites.results.efficiency(suites.flat(written))
    if cell.suite == "swe":
        resolved = written.agg(F.avg(F.col("success").cast("int")).alias("resolved_rate"))
        metrics = metrics.join(_swe(rows).join(resolved))
    writers.benchmark({"model": cell.model, "format": cell.format, "suite": cell.suite, **(meta or {})}, metrics, written, f"{beside}/envelope")
    _rename(spark, f"{beside}/envelope", at)
    sc = spark.sparkContext
    gone = sc._jvm.org.apache.hadoop.fs.Path(beside)
    gone.getFileSystem(sc._jsc.hadoopConfiguration()).delete(gone, True)
    return spark.read.schema(TASK_RESULT).json(f"{at}/details.jsonl")


@dataclass(frozen=True)
class Ran:
    """What became of a cell: its table, or why there is none."""

    cell: Cell
    tasks: DataFrame | None = None
    error: str | None = None


def run_all(spark: SparkSession, chosen: Sequence[Cell], recorded: str, root: str, dry_run: bool = False, continue_on_error: bool = False, **options) -> list[Ran]:
    """run_suite() for each cell over <recorded>/<suite>/<format>, in order. dry_run: nothing is run or written. A cell that fails ends the run, or with continue_on_error is reported."""
    out = []
    for cell in chosen:
        if dry_run:
            out.append(Ran(cell))
            continue
        try:
            out.append(Ran(cell, run_suite(spark, cell, f"{recorded}/{cell.suite}/{cell.format}", root, **options)))
        except Exception as e:  # whatever a cell's files hold
            if not continue_on_error:
                raise
            out.append(Ran(cell, error=f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    return out
