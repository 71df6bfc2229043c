"""Readers: JSON lines of raw trajectories, datasets, benchmark results and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from frameloom.functions import text
from frameloom.functions.pyjson import UNREADABLE, arrow_udf, ingest_frames, ingest_messages, is_json, loads
from frameloom.operators import bridge

#: Python breaks lines at these too; a text file read by Spark does not.
LINE_BREAKS = r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, pos) of text files: lines as Python's splitlines gives them; pos rises with file, place in the file and place in the line.

    A file is split into blocks where it is large; places are ordered by block, then by row of the block.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_r"))
    return raw.select("_f", "_b", "_r", F.posexplode(F.split("value", LINE_BREAKS)).alias("_i", "line")).select("line", F.struct("_f", "_b", "_r", "_i").alias("pos"))


@arrow_udf("struct<id:string,domain:string,frames:string,messages:string,error:string>")
def _record(line: str):
    import json

    none = dict.fromkeys(("id", "domain", "frames", "messages"))
    try:
        r = loads(line)
        if not isinstance(r, dict):
            return none | {"error": "not an object"}
        if lacking := [k for k in ("frames", "id", "domain") if k not in r]:
            return none | {"error": f"no {', '.join(lacking)}"}
        given = r.get("messages")
        return {"id": str(r["id"]), "domain": str(r["domain"] or "unknown"), "frames": json.dumps(r["frames"]), "messages": json.dumps(given) if given else None, "error": None}
    except UNREADABLE as e:
        return none | {"error": f"json: {e}"}


def trajectories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of JSON lines of trajectories.

    rows: id, domain (`unknown` for none), frames, messages (from the frames where none are given), error (frames that can't
    be built), pos. quarantine: line, error, pos of lines that are no JSON, no object, or lack a key. Blank lines are skipped.
    """
    read = lines(spark, path).where(text.strip(F.col("line")) != "").withColumn("_r", _record(F.col("line")))
    good = read.where("_r.error is null").withColumn("_f", ingest_frames(F.col("_r.frames"))).withColumn("_m", ingest_messages(F.col("_r.messages")))
    given = F.transform(F.col("_m.messages"), bridge._plain)
    rows = good.select(
        "_r.id", "_r.domain", F.col("_f.frames").alias("frames"), F.when(F.col("_r.messages").isNotNull(), given).otherwise(bridge.frames_to_messages(F.col("_f.frames"))).alias("messages"), F.col("_f.error").alias("error"), "pos"
    )
    return bridge.settled(rows), read.where("_r.error is not null").select("line", F.col("_r.error").alias("error"), "pos")


def trajectory_lines(generated: DataFrame, column: str) -> DataFrame:
    """(line): lines of generated text that are JSON and begin with {, stripped."""
    cut = generated.select(F.explode(F.split(F.col(column), "\n")).alias("line")).select(text.strip(F.col("line")).alias("line"))
    return cut.where(F.col("line").startswith("{")).where(is_json(F.col("line")))


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern has a file."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(at)
    return bool(found) and len(found) > 0


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are not blank; 0 for a file that isn't there."""
    return lines(spark, path).where(text.strip(F.col("line")) != "").count() if _there(spark, path) else 0


def dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A dataset written by writers.dataset; one split reads its folder alone."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def result_files(spark: SparkSession, paths: Sequence[str], schema: str, key: str = "id", multi_line: bool = True) -> DataFrame:
    """Rows of result files in JSON, one file a row or a line a row; a row without its key has the file's name. Paths that aren't there are left out."""
    there = [p for p in paths if _there(spark, p)]
    if not there:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("multiLine", multi_line).json(there)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1)
    return df.withColumn(key, F.coalesce(F.col(key).cast("string"), stem))


def bfcl_paths(root: str, model: str, categories: Sequence[str], groups: dict[str, str], prefix: str) -> list[str]:
    """Result files of the categories; a category without a group is refused."""
    if unknown := [c for c in categories if c not in groups]:
        raise KeyError(f"unknown categories: {unknown}")
    return [f"{root}/{model.replace('/', '_')}/{groups[c]}/{prefix}_{c}_result.json" for c in categories]


def summaries(spark: SparkSession, root: str) -> DataFrame:
    """(suite, format, meta, metrics, path) of <root>/<suite>/<format>/summary.json, as writers.benchmark writes them; files that are no JSON are left out, and without files there are no rows."""
    at = f"{root}/*/*/summary.json"
    if not _there(spark, at):
        return spark.createDataFrame([], "suite string, format string, meta map<string,string>, metrics map<string,string>, path string")
    raw = spark.read.text(at, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    part = F.split("path", "/")
    read = raw.where(is_json(F.col("value")))
    fields = lambda k: F.from_json(F.get_json_object("value", f"$.{k}"), "map<string,string>")
    return read.select(F.element_at(part, -3).alias("suite"), F.element_at(part, -2).alias("format"), fields("meta").alias("meta"), fields("metrics").alias("metrics"), "path")


def summary_tasks(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """(suite, format, task's columns) of the tasks that the summaries list."""
    at = f"{root}/*/*/summary.json"
    if not _there(spark, at):
        return spark.createDataFrame([], f"suite string, format string, {schema}")
    raw = spark.read.text(at, wholetext=True).select("value", F.split(F.col("_metadata.file_path"), "/").alias("_p"))
    tasks = F.from_json(F.get_json_object("value", "$.tasks"), f"array<struct<{', '.join(f'{c.name}:{c.dataType.simpleString()}' for c in _parse_datatype_string(schema).fields)}>>")
    return raw.select(F.element_at("_p", -3).alias("suite"), F.element_at("_p", -2).alias("format"), F.inline(tasks))


def tool_files(spark: SparkSession, root: str) -> DataFrame:
    """(standard_tool_name, tool_name, description) of <root>/<category>/<tool>.json; of tools with one standard name the last by path."""
    raw = spark.read.schema("tool_name string, tool_description string").option("multiLine", True).json(f"{root}/*/*.json").withColumn("_p", F.col("_metadata.file_path"))
    named = raw.withColumn("standard_tool_name", text.safe_name(text.identifier(F.col("tool_name"))))
    return named.groupBy("standard_tool_name").agg(F.max_by("tool_name", "_p").alias("tool_name"), F.max_by("tool_description", "_p").alias("description"))
