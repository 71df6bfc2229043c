"""Whole plans: raw trajectories to a dataset, run summaries to the result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators import dataset, lookups
from frameloom.plans import matrix
from frameloom.sources import readers, writers


def clean(spark: SparkSession, source: str, target: str, fraction: float = 0.05, seed: int = 42) -> dict[str, DataFrame]:
    """Reads JSON lines, keeps valid trajectories with new missions, splits them by domain and writes target/data.

    target/rejected has the lines that could not be read and the rows that break a rule. Returns domain counts
    and the ten most frequent reasons, read from what was written.
    """
    rows, bad = readers.trajectories(spark, source)
    kept, rejected = dataset.clean(rows, "pos", fraction, seed)
    writers.dataset(kept, f"{target}/data")
    lost = rejected.select(F.col("id"), "reason").unionByName(bad.select(F.lit(None).cast("string").alias("id"), F.substring(F.concat(F.lit("line: "), "error"), 1, 60).alias("reason")))
    lost.write.mode("overwrite").parquet(f"{target}/rejected")
    return {
        "domains": dataset.histogram(spark.read.parquet(f"{target}/data"), "domain"),
        "reasons": dataset.histogram(spark.read.parquet(f"{target}/rejected"), "reason", limit=10),
    }


def roll_up(spark: SparkSession, root: str, formats: Sequence[str], models: dict[str, str], markdown: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the result table, missing cells); the table as text goes to the local path markdown, if given."""
    rows = matrix.rows(readers.summaries(spark, root))
    if markdown is not None:
        with open(markdown, "w", encoding="utf-8") as out:
            out.write(matrix.markdown(rows, list(matrix.SUITES), formats))
    return rows, lookups.missing_cells(lookups.cells(spark, list(matrix.SUITES), formats, models), rows)


def write_through(fresh: DataFrame, cache: DataFrame, path: str) -> None:
    """Appends answers(key, error, response) that the cache lacks."""
    fresh.dropDuplicates(["key"]).join(cache, "key", "left_anti").select("key", "error", "response").write.mode("append").parquet(path)
