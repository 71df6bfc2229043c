"""Token ids to training labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.pyjson import arrow_udf
from frameloom.functions.schema import MODEL_TYPES, RUNTIME_TYPES, TOKEN
from frameloom.operators.wire import render

IGNORED = -100
MODEL_IDS = [TOKEN[t] for t in MODEL_TYPES]
RUNTIME_IDS = [TOKEN[t] for t in RUNTIME_TYPES]


def _flags(runs: Column) -> Column:
    """array<struct<on, n>> -> on, n times each, one array."""
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["on"], r["n"])))


def _labelled(ids: Column, flags: Column) -> Column:
    return F.zip_with(ids, flags, lambda i, on: F.when(on, i).otherwise(IGNORED))


def mask_runtime(ids: Column, model: Sequence[int] = MODEL_IDS, runtime: Sequence[int] = RUNTIME_IDS) -> Column:
    """Labels of an ids array: an id after a model's marker, the marker too, keeps itself; after a runtime's marker, or before any, it is IGNORED. An id in both sets is a runtime's.

    The markers are written as a text of one letter an id, which is cut before each marker: the work grows with the ids.
    """
    letters = F.transform(ids, lambda i: F.when(i.isin(list(runtime)), "r").when(i.isin(list(model)), "m").otherwise("-"))
    runs = F.regexp_extract_all(F.array_join(letters, ""), F.lit("[rm]?-*"), F.lit(0))
    return _labelled(ids, _flags(F.transform(runs, lambda r: F.struct(r.startswith("m").alias("on"), F.length(r).alias("n")))))


def mask_rows(rows: DataFrame, by: str, order: str, token: str, model: Sequence, runtime: Sequence) -> DataFrame:
    """rows of one token each with label: the same rule by windows."""
    turn = F.when(F.col(token).isin(list(runtime)), False).when(F.col(token).isin(list(model)), True)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = F.coalesce(F.last(turn, ignorenulls=True).over(w), F.lit(False))
    return rows.withColumn("label", F.when(on, F.col(token)).otherwise(F.lit(IGNORED).cast(rows.schema[token].dataType)))


def mask_assistant(ids: Column, start: list[int], end: list[int], turn_end: list[int], role: list[int]) -> Column:
    """Labels that keep what follows an assistant's header (start, role, end), its closing token too; an unclosed turn goes to the end. Null stays null.

    The ids are written as a text, each with a comma; a pattern finds the turns, and the commas between them are counted.
    """
    spelt = lambda part: "".join(f"{i}," for i in part)
    if not start or not end:  # no header can be found
        return F.transform(ids, lambda _: F.lit(IGNORED))
    some = r"([-\d,]*?)"
    closed = rf"((?<=,){spelt(turn_end)}|\z)" if turn_end else r"(\z)"
    pattern = rf"(?<![-\d]){spelt(start)}{some}(?<=,){spelt(end)}{some}{closed}"
    text = F.concat(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), F.when(F.size(ids) > 0, ",").otherwise(""))
    count = lambda s: F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    header, body, close = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2, 3))
    gaps = F.split(text, pattern, -1)
    turns = F.arrays_zip(header.alias("header"), body.alias("body"), close.alias("close"), F.slice(gaps, F.lit(1), F.size(header)).alias("gap"))
    ignored = lambda n: F.struct(F.lit(False).alias("on"), n.alias("n"))
    runs = F.flatten(
        F.transform(
            turns,
            lambda t: F.array(ignored(count(t["gap"]) + count(t["header"]) + (len(start) + len(end))), F.struct((t["header"] == spelt(role)).alias("on"), (count(t["body"]) + count(t["close"])).alias("n"))),
        )
    )
    rest = F.array(ignored(F.greatest(F.lit(0), F.size(ids) - F.aggregate(runs, F.lit(0), lambda a, r: a + r["n"]))))
    return F.when(ids.isNotNull(), _labelled(ids, _flags(F.concat(runs, rest))))


def tokenize(df: DataFrame, encode: Callable[[str], list[int]], frames: str = "frames", max_length: int = 2048) -> DataFrame:
    """df with input_ids, labels, attention_mask of its rendered frames, cut to max_length; rows without frames or without a label to learn from go.

    encode runs in Arrow batches on the executors.
    """
    ids = arrow_udf("array<int>")(lambda wire: None if not wire else list(encode(wire)))
    out = df.withColumn("input_ids", F.slice(ids(render(F.col(frames))), 1, max_length))
    out = out.withColumn("labels", mask_runtime(F.col("input_ids"))).where(F.exists("labels", lambda x: x != IGNORED))
    return out.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


def collate(df: DataFrame, batch: str, pad_id: int = 0) -> DataFrame:
    """df with input_ids, labels and attention_mask padded to the longest row of their batch; rows without ids go."""
    full = df.where(F.size("input_ids") > 0)
    longest = full.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_most"))
    out = full.join(longest, batch)
    for name, pad in (("attention_mask", 0), ("labels", IGNORED), ("input_ids", pad_id)):  # the ids last: their size is what is missing
        out = out.withColumn(name, F.concat(name, F.array_repeat(F.lit(pad), F.col("_most") - F.size("input_ids"))))
    return out.drop("_most")
