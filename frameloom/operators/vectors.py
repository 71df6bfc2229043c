"""Embedding rows: means of seed rows and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mean): the element-wise mean of each key's vectors; repeated rows weigh more. Sums are combined before the shuffle; null vectors don't count."""
    flat = rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("_i", "_x"))
    means = flat.groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda p: p["_x"]).alias("mean"))


def seeded(targets: DataFrame, rows: DataFrame, key: str = "target", row: str = "row_id", vector: str = "embedding") -> DataFrame:
    """(target, mean) of the rows that targets(target, row_id) name; a row named twice weighs twice."""
    return mean_pool(targets.join(rows, row), key, vector)


def longest_match(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, row_ids) of each distinct word: it is cut from its beginning into the longest pieces of vocabulary(piece, row_id); characters that begin no piece are left out.

    All parts of a word are joined to the pieces by equality; the longest at each place comes down to one row before a fold picks the way.
    Words without any piece, and empty ones, have no ids. Null words are left out.
    """
    word = words.where("word is not null").select("word").distinct()
    begins = word.where("word <> ''").select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    parts = begins.select("word", "at", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("at") + 1)).alias("n")).select("*", F.expr("substring(word, at, n)").alias("piece"))
    longest = parts.join(vocabulary.groupBy("piece").agg(F.min("row_id").alias("row_id")), "piece").groupBy("word", "at").agg(F.max(F.struct("n", "row_id")).alias("best"))
    listed = longest.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "best.n", "best.row_id"))).alias("steps"))
    zero = F.struct(F.lit(1).alias("next"), F.array().cast("array<long>").alias("ids"))

    def step(s: Column, x: Column) -> Column:
        return F.when(x["at"] < s["next"], s).otherwise(F.struct((x["at"] + x["n"]).alias("next"), F.concat(s["ids"], F.array(x["row_id"].cast("long"))).alias("ids")))

    walked = listed.select("word", F.aggregate("steps", zero, step, lambda s: s["ids"]).alias("row_ids"))
    return word.join(walked, "word", "left").select("word", F.coalesce("row_ids", F.array().cast("array<long>")).alias("row_ids"))


def seeds(targets: DataFrame, vocabulary: DataFrame, single: bool = True) -> DataFrame:
    """(target, row_id): the rows whose mean a target begins with, of targets(target, word, pos) and vocabulary(piece, row_id).

    single: a blank and the word, where that is one piece; a target none of whose words is has the first piece of its first
    word. Otherwise all pieces of all words, as often as they occur. Words that repeat count again. A target without pieces has no rows.
    """
    given = targets.select("target", F.concat(F.lit(" " if single else ""), "word").alias("word"), "pos")
    cut = given.join(longest_match(given.select("word"), vocabulary), "word")
    if not single:
        return cut.select("target", F.explode("row_ids").alias("row_id"))
    whole = vocabulary.groupBy(F.col("piece").alias("word")).agg(F.min("row_id").alias("_whole"))
    known = cut.join(whole, "word", "left").withColumn("_one", F.col("_whole").isNotNull() & (F.col("word") != " "))
    first = known.groupBy("target").agg(F.min_by(F.get("row_ids", F.lit(0)), "pos").alias("_first"), F.max("_one").alias("_any"))
    chosen = known.where("_one").select("target", F.col("_whole").cast("long").alias("row_id"))
    return chosen.union(first.where("not _any and _first is not null").select("target", F.col("_first").alias("row_id")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def max_abs_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda most, x: F.greatest(most, x))


def check(found: Column, wanted: Column, typical_norm: Column, most_error: float = 0.05, least_norm: float = 0.15, most_ratio: float = 3.0) -> Column:
    """array<string>: what is wrong with a vector."""
    ratio = norm(found) / typical_norm
    problems = [
        F.when(max_abs_error(found, wanted) > most_error, "error"),
        F.when(norm(found) < least_norm, "norm"),
        F.when((ratio > most_ratio) | (ratio < 1 / most_ratio), "ratio"),
    ]
    return F.array_compact(F.array(*problems))
