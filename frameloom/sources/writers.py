"""Writers: datasets, benchmark envelopes, result tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.schema import quote
from frameloom.operators import trajectory
from frameloom.operators.results import upsert
from frameloom.sources import keyed
from frameloom.sources.readers import count_lines


def records(df: DataFrame) -> DataFrame:
    """(id, domain, frames, messages, num_frames, split) with frames and messages as JSON text."""
    return df.select("id", "domain", trajectory.to_json(F.col("frames")).alias("frames"), messages_json(F.col("messages")).alias("messages"), F.size("frames").alias("num_frames"), "split")


def messages_json(messages: Column) -> Column:
    """JSON list of messages, as Python writes it, not ASCII-escaped; fields that are null are left out. Null messages give null."""

    def item(*fields: tuple[str, Column]) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{name}": '), said) for name, said in fields)), F.lit("}"))

    def listed(items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))

    def call(c: Column) -> Column:
        function = item(("name", quote(c["function"]["name"])), ("arguments", quote(c["function"]["arguments"])))
        return item(("id", quote(c["id"])), ("type", quote(c["type"])), ("function", F.when(c["function"].isNotNull(), function)))

    def one(m: Column) -> Column:
        return item(("role", quote(m["role"])), ("content", quote(m["content"])), ("tool_call_id", quote(m["tool_call_id"])), ("tool_calls", listed(F.transform(m["tool_calls"], call))))

    return listed(F.transform(messages, one))


def dataset(df: DataFrame, path: str) -> None:
    """Writes rows with a split, a folder for each split; a rerun replaces the splits it has."""
    records(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)


def append_lines(df: DataFrame, path: str, column: str = "line", target: int | None = None) -> int:
    """Appends text lines until the file has target lines; returns how many may still come before that."""
    room = None if target is None else max(0, target - count_lines(df.sparkSession, path))
    chosen = df.select(F.col(column)) if room is None else df.select(F.col(column)).limit(room)
    if room != 0:
        chosen.write.mode("append").text(path)
    return 0 if target is None else max(0, target - count_lines(df.sparkSession, path))


def benchmark(meta: dict[str, object], metrics: DataFrame, tasks: DataFrame, path: str) -> None:
    """summary.json (meta, the one row of metrics, all tasks) and details.jsonl, a folder of a line for each task.

    Tasks are written by Spark; into summary.json their files are copied as blocks of bytes. No row passes through the driver.
    """
    spark = tasks.sparkSession
    line = F.to_json(F.struct(*tasks.columns), {"ignoreNullFields": "false"}).alias("j")
    tasks.select(line).write.mode("overwrite").text(f"{path}/details.jsonl")
    measured = metrics.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/summary.json")
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    try:
        say = lambda s: out.write(bytearray(s.encode()))
        say(f'{{\n  "meta": {json.dumps(meta, ensure_ascii=False)},\n  "metrics": {measured["j"] if measured else "{}"},\n  "tasks": [')
        parted = f"{path}/.tasks"
        spark.read.text(f"{path}/details.jsonl").write.mode("overwrite").option("lineSep", _BETWEEN).text(parted)
        _copy(spark, parted, out)
        say("\n  ]\n}\n")
    finally:
        out.close()


#: Between two tasks of a summary.
_BETWEEN = ",\n    "


def _copy(spark: SparkSession, folder: str, out) -> None:
    """Copies a folder's files into out, one after the other, but for what stands after the last line; then the folder goes."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    parts = sorted((f for f in fs.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getPath().getName())
    if parts:
        out.write(bytearray(_BETWEEN[1:].encode()))
    for part in parts:
        given = fs.open(part.getPath())
        n = part.getLen() - (len(_BETWEEN) if part is parts[-1] else 0)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.org.apache.commons.io.input.BoundedInputStream(given, n), out, conf, False)
        given.close()
    fs.delete(at, True)


def merge(old: DataFrame, new: DataFrame, path: str, key: str = "id", order: str = "pos", partition: str | None = None) -> None:
    """Writes old with new's rows in place of those of the same key. path must not be where old is read from."""
    out = upsert(old, new, key, order).write.mode("overwrite")
    (out.partitionBy(partition) if partition else out).parquet(path)


def _versions(spark, path: str) -> list[int]:
    """The versions of a table that are whole, in order: Spark marks a folder when its job has been committed."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = at.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(int(str(f.getPath().getParent().getName()).removeprefix("version=")) for f in found or [])


def current(spark, path: str) -> DataFrame | None:
    """The table that merge_at() keeps at path; None before the first merge."""
    there = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={there[-1]}") if there else None


def merge_at(new: DataFrame, path: str, key: str = "id", order: str = "pos", keep: int = 2) -> DataFrame:
    """Puts new's rows in place of those of the same key in the table at path, and returns the table.

    The merged table is written beside the old one and counts from when it is whole; a run that is broken off at any point
    leaves the old one, and what it has written is written over by the next. A rerun with the same rows changes nothing. The last keep versions
    stay, for those who still read them. Of new's rows with one key the last by order counts.
    """
    spark = new.sparkSession
    there, old = _versions(spark, path), current(spark, path)
    number = there[-1] + 1 if there else 0
    merged = upsert(old if old is not None else new.limit(0), new, key, order)
    merged.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/version={number}")
    sc = spark.sparkContext
    for past in there[: max(0, len(there) + 1 - keep)]:
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/version={past}")
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    return current(spark, path)


def result_files(rows: DataFrame, path: str, key: str = "id", json_columns: tuple[str, ...] = (), newline: bool = False) -> None:
    """A JSON file for each row, under its id."""
    keyed.files(rows, path, key, json_columns, newline)


def converted(answers: DataFrame, path: str) -> None:
    """One object, id -> answer, of answers(id, value), value being JSON."""
    keyed.one_object(answers.select("id", "value"), path, "id", ("value",))


def predictions(rows: DataFrame, path: str, model: str) -> None:
    """One object, instance_id -> prediction, of rows(instance_id, model_patch); a null patch is an empty one."""
    named = rows.select(F.col("instance_id").cast("string").alias("_id"), F.col("instance_id").cast("string").alias("instance_id"), "model_patch")
    entry = F.struct(F.lit(model).alias("model_name_or_path"), "instance_id", F.coalesce("model_patch", F.lit("")).alias("model_patch"))
    keyed.one_object(named.select("_id", entry.alias("value")), path, "_id", newline=True)


def answers(df: DataFrame, path: str, key: str = "id") -> None:
    """A JSON line for each row: its key and the row."""
    df.select(F.col(key).alias("id"), F.struct(*[c for c in df.columns if c != key]).alias("value")).write.mode("overwrite").json(path)
