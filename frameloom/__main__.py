"""python -m frameloom COMMAND: data-clean, data-append, eval-benchmarks, eval-run-all, eval-aggregate, seed-rows, verify-rows"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from frameloom.operators import vectors
from frameloom.plans import etl, runner
from frameloom.sources import readers, writers


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="frameloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, said: str, *places: str, short: str | None = None) -> argparse.ArgumentParser:
        out = commands.add_parser(name, help=said, aliases=[short] if short else [])
        out.set_defaults(command=name)
        for place in places:
            out.add_argument(place)
        return out

    clean = command("data-clean", "raw trajectories to a dataset", "source", "target", short="clean")
    clean.add_argument("--fraction", type=float, default=0.05)
    clean.add_argument("--seed", type=int, default=42)
    more = command("data-append", "generated text to lines of trajectories, up to a number", "source", "target")
    more.add_argument("--target-lines", type=int, default=20_000)
    one = command("eval-benchmarks", "score the recorded rows of a suite", "recorded", "root")
    one.add_argument("--suite", required=True, choices=list(runner.ROWS))
    one.add_argument("--format", required=True)
    one.add_argument("--model", required=True)
    one.add_argument("--score-only", action="store_true", help="bfcl, swe: score what is recorded (rows are always recorded here)")
    one.add_argument("--no-score", action="store_true", help="bfcl, swe: task results without verdicts")
    one.add_argument("--fresh", action="store_true", help="score again what has been scored")
    every = command("eval-run-all", "score the recorded rows of all suites and formats", "recorded", "root")
    every.add_argument("--suites", nargs="+", default=list(runner.ROWS))
    every.add_argument("--format", action="append", default=[], metavar="NAME=MODEL")
    every.add_argument("--dry-run", action="store_true")
    every.add_argument("--continue-on-error", action="store_true")
    table = command("eval-aggregate", "run summaries to the result table", "root", short="rollup")
    table.add_argument("--format", action="append", default=[], metavar="NAME=MODEL")
    table.add_argument("--markdown")
    for name, said in (("seed-rows", "vectors of targets from those of their seed words"), ("verify-rows", "whether vectors are those of their seed words")):
        rows = command(name, said, "targets", "vocabulary", "vectors", "out")
        rows.add_argument("--all-pieces", action="store_true", help="all pieces of a word, not words of one piece alone")
    return parser


def refused(given: argparse.Namespace) -> str | None:
    """Why options don't go together; None if they do."""
    if given.command != "eval-benchmarks":
        return None
    if given.suite not in ("bfcl", "swe") and (given.score_only or given.no_score):
        return f"{given.suite}: does not support --score-only or --no-score"
    return f"{given.suite}: cannot use --score-only and --no-score together" if given.score_only and given.no_score else None


def _models(formats: Sequence[str]) -> dict[str, str]:
    return dict(f.split("=", 1) for f in formats)


def _evaluate(spark: SparkSession, given: argparse.Namespace) -> int:
    tasks = runner.run_suite(spark, runner.Cell(given.suite, given.format, given.model), given.recorded, given.root, score=not given.no_score, resume=not given.fresh)
    tasks.groupBy("success").count().show()
    return 0


def _run_all(spark: SparkSession, given: argparse.Namespace) -> int:
    models = _models(given.format)
    ran = runner.run_all(spark, runner.cells(given.suites, list(models), models), given.recorded, given.root, given.dry_run, given.continue_on_error)
    for i, r in enumerate(ran, 1):
        print(f"[{i}/{len(ran)}] {r.cell.suite} / {r.cell.format} / {r.cell.model}: {f'failed: {r.error}' if r.error else 'not run' if r.tasks is None else 'done'}")
    return 1 if any(r.error for r in ran) else 0


def _vectors(spark: SparkSession, given: argparse.Namespace) -> int:
    """targets(target, word, pos), vocabulary(piece, row_id), vectors(row_id, embedding), all Parquet; verify: vectors also hold rows named by target."""
    targets, vocabulary, rows = (spark.read.parquet(p) for p in (given.targets, given.vocabulary, given.vectors))
    means = vectors.seeded(vectors.seeds(targets, vocabulary, single=not given.all_pieces), rows.select("row_id", "embedding"))
    if given.command == "seed-rows":
        means.write.mode("overwrite").parquet(given.out)
        return 0
    found = means.join(rows.select("target", "embedding"), "target", "left")
    wrong = F.when(F.col("embedding").isNull(), F.array(F.lit("missing"))).otherwise(F.filter(vectors.check(F.col("embedding"), F.col("mean"), vectors.norm(F.col("mean"))), lambda p: p == "error"))
    found.select("target", wrong.alias("problems")).write.mode("overwrite").parquet(given.out)
    return 1 if spark.read.parquet(given.out).where("size(problems) > 0").count() else 0


def main(args: list[str] | None = None) -> int:
    parser = _arguments()
    given = parser.parse_args(args)
    if why := refused(given):
        parser.error(why)
    spark = SparkSession.builder.getOrCreate()
    if given.command == "data-clean":
        for name, df in etl.clean(spark, given.source, given.target, given.fraction, given.seed).items():
            print(name)
            df.show(truncate=False)
        return 0
    if given.command == "data-append":
        lines = readers.trajectory_lines(spark.read.text(given.source, wholetext=True), "value")
        print(f"{writers.append_lines(lines, given.target, target=given.target_lines)} lines to go")
        return 0
    if given.command == "eval-aggregate":
        models = _models(given.format)
        rows, missing = etl.roll_up(spark, given.root, list(models), models, given.markdown)
        rows.show(truncate=False)
        missing.show(truncate=False)
        return 0
    return {"eval-benchmarks": _evaluate, "eval-run-all": _run_all}.get(given.command, _vectors)(spark, given)


if __name__ == "__main__":
    sys.exit(main())
