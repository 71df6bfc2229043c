"""Joins and lookups of entries, tools and caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import text
from frameloom.functions.pyjson import dumps


def wanted(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is wanted; the planner broadcasts the ids where their size allows."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def pinned(spark, ids: Sequence[str], key: str = "id") -> DataFrame:
    """A list of ids as (key, pos). Ids that are no text are refused."""
    if any(not isinstance(i, str) for i in ids):
        raise TypeError("ids must be text")
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} string, pos int")


def subset(rows: DataFrame, ids: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """The pinned rows in the pins' order; of several rows with one id the last by order. Missing ids raise, the first five named."""
    missing = [r[key] for r in ids.join(rows, key, "left_anti").orderBy("pos").limit(5).collect()]
    if missing:
        raise KeyError(f"missing ids: {missing}")
    found = rows.join(ids, key)
    if order is not None:
        found = found.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_rank = 1").drop("_rank")
    return found.orderBy("pos").drop("pos")


def resolve(keys: DataFrame, by_field: DataFrame, by_file: DataFrame, n_rows: int) -> DataFrame:
    """(key, index): by the field, or else by the file of ids, or else the key itself as a row number below n_rows; null if none fits.

    by_field(key, index) and by_file(key, index); of equal keys the last index counts.
    """
    first = by_field.groupBy("key").agg(F.max("index").alias("_field"))
    second = by_file.groupBy("key").agg(F.max("index").alias("_file"))
    number = F.when(F.col("key").rlike("^[0-9]+$"), F.col("key").try_cast("long"))
    place = F.when(number < n_rows, number)
    return keys.join(first, "key", "left").join(second, "key", "left").select("key", F.coalesce("_field", "_file", place).cast("long").alias("index"))


def cache_key(category: Column, tool: Column, api: Column, tool_input: Column) -> Column:
    """SHA-256 of the four fields' JSON with sorted keys, ASCII-escaped."""
    said = F.to_json(F.struct(api.alias("api_name"), category.alias("category"), tool_input.alias("tool_input"), tool.alias("tool_name")), {"ignoreNullFields": "false"})
    return F.sha2(dumps(said), 256)


def cached(calls: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls with their cached error and response, calls that the cache lacks). calls(category, tool, api, tool_input, ...), cache(key, error, response)."""
    keyed = calls.withColumn("key", cache_key(*(F.col(c) for c in ("category", "tool", "api", "tool_input"))))
    known = cache.select("key", F.coalesce(F.col("error").cast("string"), F.lit("")).alias("error"), F.coalesce(F.col("response").cast("string"), F.lit("")).alias("response")).dropDuplicates(["key"])
    return keyed.join(known, "key"), keyed.join(known, "key", "left_anti")


#: Hex digits of a key that name its bucket: 256 folders.
BUCKET_DIGITS = 2


def bucket(key: Column) -> Column:
    """The folder of a cache that a key is kept in: keys are hashes, so that folders are of one size."""
    return F.substring(key, 1, BUCKET_DIGITS)


def keep_answers(fresh: DataFrame, path: str) -> None:
    """Appends answers(key, error, response) to a cache at path, in a folder for each bucket; one file a bucket and run. Null keys are left out."""
    kept = fresh.where("key is not null").select("key", "error", "response", bucket(F.col("key")).alias("bucket"))
    kept.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("append").partitionBy("bucket").parquet(path)


def cache_at(spark, path: str, keys: DataFrame) -> DataFrame:
    """(key, error, response, bucket) of a cache at path, of the folders alone that keys(key) fall into; of answers with one key any counts.

    At most 256 names of folders reach the driver, whatever the number of keys; the others' files are not opened.
    """
    there = [r["bucket"] for r in keys.where("key is not null").select(bucket(F.col("key")).alias("bucket")).distinct().collect()]
    return spark.read.schema("key string, error string, response string, bucket string").parquet(path).where(F.col("bucket").isin(there))


def looked_up(calls: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """cached() against a cache at path, of which only the folders of the calls' keys are read. calls(category, tool, api, tool_input, ...)."""
    keys = calls.select(cache_key(*(F.col(c) for c in ("category", "tool", "api", "tool_input"))).alias("key"))
    return cached(calls, cache_at(calls.sparkSession, path, keys))


def suffix_join(names: DataFrame, functions: DataFrame, name: str = "name") -> DataFrame:
    """names' columns and found: the function of the least rank whose name ends with it; null if none does. functions(function, rank).

    A function is cut at the lengths alone that names have; suffixes are brought down to their least function before they are
    dealt out, and meet names by equality. The empty name fits the first function, a null one none. Ties of rank go to the
    lesser function.
    """
    lengths = names.where(F.col(name).isNotNull()).select(F.length(name).alias("_n")).distinct()
    whole = functions.where("function is not null").select("function", "rank", F.explode(F.sequence(F.lit(0), F.length("function"))).alias("_n"))
    cut = whole.join(lengths, "_n").select(F.expr("right(function, _n)").alias("_suffix"), "function", "rank")
    least = cut.groupBy("_suffix").agg(F.min(F.struct("rank", "function"))["function"].alias("found"))
    return names.join(least, names[name] == least["_suffix"], "left").drop("_suffix")


def by_suffix(name: Column, functions: Column) -> Column:
    """The first function whose name ends with name; null if none does. The empty name fits the first."""
    return F.get(F.filter(functions, lambda f: F.endswith(f, name)), F.lit(0))


def tool_step(action: Column, found: Column, error: Column, response: Column, limit: int = 1024) -> Column:
    """struct<observation, code> of a tool call: found is the function that it fits (by_suffix), null if none does.

    The observation is the JSON of the error and the response, cut at limit; the code follows from the error's
    text. No function: an error that says so, and code 1. Finish is not looked up: its code is 3 for an answer,
    4 otherwise, by the response.
    """
    said = dumps(F.to_json(F.struct(F.coalesce(error, F.lit("")).alias("error"), F.coalesce(response, F.lit("")).alias("response"))))
    unknown = dumps(F.to_json(F.struct(F.concat(F.lit("No such function name: "), action).alias("error"), F.lit("").alias("response"))))
    finish = F.struct(F.coalesce(response, F.lit("")).alias("observation"), F.when(F.coalesce(response, F.lit("")) != "", 3).otherwise(4).alias("code"))
    hit = F.struct(text.cut(said, limit).alias("observation"), text.status_code(F.coalesce(error, F.lit(""))).alias("code"))
    return F.when(action == "Finish", finish).when(found.isNull(), F.struct(unknown.alias("observation"), F.lit(1).alias("code"))).otherwise(hit)


def all_listed(candidates: Column, table: Column) -> Column:
    """The candidates' records of a map, or null if one is missing."""
    return F.when(F.forall(candidates, lambda c: F.map_contains_key(table, c)), F.transform(candidates, lambda c: table[c]))


def cells(spark, suites: Sequence[str], formats: Sequence[str], models: dict[str, str]) -> DataFrame:
    """(pos, suite, format, model): each suite with each format, suite by suite. A format without a model is refused."""
    if unknown := [f for f in formats if f not in models]:
        raise ValueError(f"no model for {unknown}")
    rows = [(i * len(formats) + j, s, f, models[f]) for i, s in enumerate(suites) for j, f in enumerate(formats)]
    return spark.createDataFrame(rows, "pos int, suite string, format string, model string")


def missing_cells(all_cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells that no result row has, in order."""
    return all_cells.join(rows, ["suite", "format"], "left_anti").orderBy("pos")
