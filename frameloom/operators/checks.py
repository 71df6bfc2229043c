"""Checks that ride along with a job: what is wrong is counted while rows are written, and raised after."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Expected:
    """Expectations of a table, met or not once a job over table() has run: verify() raises what was not, and needs no job of its own.

        wanted = Expected(rows, count=45)
        wanted.table().write.parquet(path)
        wanted.verify()
    """

    def __init__(self, df: DataFrame, count: int | None = None, never: dict[str, Column] | None = None, name: Column | None = None):
        """never: conditions that no row may fulfil, by what is wrong then; name: what such a row is called. count: of the rows that fulfil none."""
        self.df, self.count, self.never, self.name, self.seen = df, count, never or {}, name, Observation()

    def table(self) -> DataFrame:
        """The rows that fulfil no condition. Rows are counted before the others are left out."""
        wrong = [F.coalesce(c, F.lit(False)) for c in self.never.values()]
        bad = F.lit(False)
        for c in wrong:
            bad = bad | c
        name = self.name if self.name is not None else F.lit("")
        metrics = [F.count_if(~bad).alias("n")]
        for i, c in enumerate(wrong):
            metrics += [F.count_if(c).alias(f"bad{i}"), F.min(F.when(c, name.cast("string"))).alias(f"first{i}"), F.max(F.when(c, name.cast("string"))).alias(f"last{i}")]
        return self.df.observe(self.seen, *metrics).where(~bad)

    def verify(self) -> int:
        """How many rows there were; raises ValueError where an expectation was not met."""
        found = self.seen.get
        problems = [f"{what}: {found[f'bad{i}']} rows, {found[f'first{i}']!r} to {found[f'last{i}']!r}" for i, what in enumerate(self.never) if found[f"bad{i}"]]
        if self.count is not None and found["n"] != self.count:
            problems.append(f"expected {self.count} rows, got {found['n']}")
        if problems:
            raise ValueError("; ".join(problems))
        return found["n"]


def pinned(rows: DataFrame, pins: DataFrame, key: str = "id", order: str | None = None, count: bool = True) -> Expected:
    """The pinned rows, one for each pin, in no order: a pin without a row, and a wrong number of rows, are raised once they have been written.

    pins(key, pos); of several rows with one key the last by order counts, or any.
    """
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.col(order or key)).alias("_row"))
    joined = pins.select(F.col(key).alias("_pin"), "pos").join(last, F.col("_pin") == F.col("_key"), "left")
    none = F.col("_key").isNull()
    shown = joined.select(*(F.col(f"_row.{c}").alias(c) for c in rows.columns), "pos", none.alias("_none"), "_pin")
    return Expected(shown, None, {"missing ids": F.col("_none")}, F.col("_pin"))


def kept_categories(rows: DataFrame, category: Column, excluded: Iterable[str] = (), also: Column | None = None) -> DataFrame:
    """rows whose category is not excluded; also: a further condition that leaves rows out. A null category stays."""
    out = F.coalesce(category.isin(list(excluded)), F.lit(False)) if (excluded := list(excluded)) else F.lit(False)
    return rows.where(~(out | (F.coalesce(also, F.lit(False)) if also is not None else F.lit(False))))


def present(spark: SparkSession, root: str, *needed: str) -> str:
    """root, if all needed files or folders are there; FileNotFoundError names those that are not. No file is read."""
    sc = spark.sparkContext
    conf, path = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.Path
    lost = [f"{root}/{n}" for n in needed if not (at := path(f"{root}/{n}")).getFileSystem(conf).exists(at)]
    if lost:
        raise FileNotFoundError(", ".join(lost))
    return root


def method_name(fmt: Column, chat: str, other: str) -> Column:
    """The name that a format's answers go by."""
    return F.when(fmt == "chatml", chat).otherwise(other)
