"""Marker-delimited text to frames and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions import pyjson, text
from frameloom.functions.schema import FRAME, RUNTIME_TYPES, SLOT, TYPES, lookup, marker, reserved

_MARKERS = "|".join(TYPES)
_NO_FRAMES = f"array<{FRAME}>"


def pieces(wire: Column) -> Column:
    """array<struct<type, raw>>: the text cut before each marker; white space before the first is skipped."""
    cut = F.split(text.lstrip(wire), rf"(?=<\|(?:{_MARKERS})\|>)")
    whole = F.filter(cut, lambda p: p != "")
    return F.transform(whole, lambda p: F.struct(F.regexp_extract(p, rf"\A<\|({_MARKERS})\|>", 1).alias("type"), F.regexp_replace(p, rf"\A<\|(?:{_MARKERS})\|>", "").alias("raw")))


def readable(wire: Column) -> Column:
    """Wire with reserved tokens as wire with markers; other wire as it is."""
    return F.when(wire.contains("<|reserved_special_token_"), text.to_markers(wire)).otherwise(wire)


def parse(df: DataFrame, column: str, strict: bool = False, frames: str = "frames", error: str = "parse_error") -> DataFrame:
    """df with the frames of a wire column, and why it could not be read (then no frames).

    Blank or null text has no frames and no error. A payload that can't be read leaves its frame, with an
    error of its own. strict: a runtime's frame in what a model wrote is an error.
    """
    wire = readable(F.col(column))
    body = text.lstrip(wire)
    offset = F.length(wire) - F.length(body)
    preview = F.replace(F.substring(body, 1, 40), F.lit("\n"), F.lit("\\n"))
    quote = F.when(preview.contains("'") & ~preview.contains('"'), '"').otherwise("'")
    outside = F.concat(F.lit("expected frame marker at offset "), offset.cast("string"), F.lit(", got: "), quote, F.replace(preview, F.lit("\\"), F.lit("\\\\")), quote)
    cut = pieces(wire)
    problem = F.when((body != "") & ~body.rlike(rf"\A<\|(?:{_MARKERS})\|>"), outside)
    if strict:
        first = F.try_element_at(F.filter(cut, lambda p: p["type"].isin(RUNTIME_TYPES)), F.lit(1))
        problem = problem.when(first.isNotNull(), F.concat(F.lit("runtime-owned marker '<|"), first["type"], F.lit("|>' found in model output")))
    out = df.withColumn(error, problem)
    read = F.when(F.col(error).isNull() & F.col(column).isNotNull(), cut)
    return out.withColumn(frames, F.coalesce(pyjson.read_payloads(read), F.array().cast(_NO_FRAMES)))


def render(frames: Column, wire: str = "reserved") -> Column:
    """Frames as text. Action and result: JSON in the order of its keys, not ASCII-escaped; end: nothing; else the content, nothing for what is falsy (a reward of 0 too)."""
    tokens = {t: reserved(SLOT[t]) if wire == "reserved" else marker(t) for t in TYPES}

    def one(f: Column) -> Column:
        body = F.when(f["type"] == "end", "").when(f["type"].isin("action", "result"), f["json_utf8"]).when(f["truthy"], f["text"]).otherwise("")
        return F.concat(lookup(tokens, f["type"]), body)

    return F.array_join(F.transform(frames, one), "")
