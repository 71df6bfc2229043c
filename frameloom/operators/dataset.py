"""From raw trajectories to a dataset: validate, drop repeats, split by domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import text
from frameloom.operators import validate


def mission(frames: Column) -> Column:
    """Text of the first mission; null if its content is no string, whatever later missions hold."""
    first = F.get(F.filter(frames, lambda f: f["type"] == "mission"), F.lit(0))
    return F.when(first["kind"] == "string", first["text"])


def checked(df: DataFrame, frames: str = "frames", error: str = "error") -> DataFrame:
    """df with reason: null for valid rows, else why the row is rejected, 60 characters at most."""
    # the violations are an element of an array, so that they are sought once
    first = F.get(F.transform(F.array(validate.violations(F.col(frames))), lambda v: F.concat(F.lit("validation: "), validate.shown(F.get(v, F.lit(0))))), F.lit(0))
    why = F.when(F.col(error).isNotNull(), F.col(error)).when(validate.crashes(F.col(frames)), "validation: crashed on an action without keys").otherwise(first)
    return df.withColumn("reason", F.substring(why, 1, 60))


def histogram(df: DataFrame, column: str, order: str | None = None, limit: int | None = None) -> DataFrame:
    """(column, n) by falling count; equal counts in order of first appearance if order is given, else of the value."""
    first = F.min(order) if order else F.lit(0)
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), first.alias("_first"))
    ranked = counts.orderBy(F.desc("n"), "_first", column).select(column, "n")
    return ranked.limit(limit) if limit is not None else ranked


def deduplicate(df: DataFrame, text_column: Column, order: str) -> DataFrame:
    """The first row, in order, of each normalised text; rows whose text is null all stay.

    Rows without a text are kept apart, so that they don't meet in one window. The planner takes the
    first of each key before the shuffle already, so that a key may have any number of rows.
    """
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(order))
    first = df.where(text_column.isNotNull()).withColumn("_key", text.dedup_key(text_column)).withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_key")
    return first.unionByName(df.where(text_column.isNull()))


def split(df: DataFrame, fraction: float = 0.05, seed: int = 42, domain: str = "domain", key: str = "id", least: int = 10) -> DataFrame:
    """df with split: of each domain of least rows or more, round-half-even(n * fraction) rows, one at least, are eval, the rest train.

    Which, a hash of key and seed decides, so that it depends neither on the order nor on the
    partitions: eval rows are those of a domain's smallest hashes. A domain's rows are not ranked in one
    place. How many of its hashes lie below a bound is known but for a few standard deviations; those that
    surely are eval are counted, and only the band around the bound is ranked.
    """
    hashed = df.withColumn("_h", F.conv(F.substring(F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("long"))
    want = F.when(F.col("_n") >= least, F.greatest(F.lit(1), F.bround(F.col("_n") * fraction).cast("long"))).otherwise(0)
    slack = 12 * F.sqrt("_want") + 40
    bound = lambda share: F.when(F.col("_want") == 0, F.lit(-1.0)).otherwise(share / F.col("_n") * float(1 << 52))
    sizes = df.groupBy(F.col(domain).alias("_domain")).agg(F.count("*").alias("_n")).withColumn("_want", want)
    sizes = sizes.withColumn("_low", bound(F.col("_want") - slack)).withColumn("_high", bound(F.col("_want") + slack))
    rows = hashed.select(F.col(domain).alias("_of"), "_h", F.col(key).cast("string").alias("_key"))
    near = rows.join(sizes, F.col("_of").eqNullSafe(F.col("_domain"))).where(F.col("_h") <= F.col("_high"))
    sure = near.groupBy(F.col("_domain").alias("_with")).agg(F.count_if(F.col("_h") <= F.col("_low")).alias("_sure"))
    band = near.where(F.col("_h") > F.col("_low")).withColumn("_rank", F.row_number().over(Window.partitionBy("_domain").orderBy("_h", "_key")))
    chosen = band.join(sure, F.col("_domain").eqNullSafe(F.col("_with"))).where(F.col("_rank") <= F.col("_want") - F.col("_sure"))
    last = chosen.groupBy(F.col("_domain").alias("_with")).agg(F.max(F.struct("_h", "_key")).alias("_last"))
    bounds = sizes.select("_domain", "_low").join(last, F.col("_domain").eqNullSafe(F.col("_with")), "left").drop("_with")
    marked = hashed.join(bounds, F.col(domain).eqNullSafe(F.col("_domain")))
    place = F.struct(F.col("_h").alias("_h"), F.col(key).cast("string").alias("_key"))
    chosen_row = (F.col("_h") <= F.col("_low")) | F.coalesce(place <= F.col("_last"), F.lit(False))
    return marked.withColumn("split", F.when(chosen_row, "eval").otherwise("train")).drop("_h", "_last", "_low", "_domain")


def sample(df: DataFrame, k: int | None, seed: int = 42, key: str = "id") -> DataFrame:
    """k rows by a hash of key and seed, sorted by the key's text; all rows, unsorted, for k None or k of all rows and more."""
    if k is not None and k < 0:
        raise ValueError("a sample's size can't be negative")
    if k is None or k >= df.count():
        return df
    return df.orderBy(F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key).cast("string")).limit(k).orderBy(F.col(key).cast("string"))


def evaluable(frames: Column, types: tuple[str, ...] = ("belief", "plan", "think", "action", "end")) -> Column:
    """Whether there is a frame of the model; false for no frames."""
    return F.coalesce(F.exists(frames, lambda f: f["type"].isin(list(types))), F.lit(False))


def evaluable_messages(messages: Column) -> Column:
    return F.coalesce(F.exists(messages, lambda m: m["role"] == "assistant"), F.lit(False))


def prompt_frames(frames: Column) -> Column:
    """Frames before the model's first."""
    return F.slice(frames, F.lit(1), validate.cut_index(frames))


def prompt_messages(messages: Column) -> Column:
    at = F.array_position(F.transform(messages, lambda m: m["role"]), "assistant")
    return F.slice(messages, F.lit(1), F.when(at > 0, at - 1).otherwise(F.size(messages)).cast("int"))


def clean(df: DataFrame, order: str, fraction: float = 0.05, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(kept rows with split, rejected rows with reason) of df(id, domain, frames, error, ...)."""
    marked = checked(df)
    kept = marked.where("reason is null").drop("reason")
    once = deduplicate(kept, mission(F.col("frames")), order)
    return split(once, fraction, seed), marked.where("reason is not null")
