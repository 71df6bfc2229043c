"""Trajectories as arrays of frames: joining, slicing, looking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.schema import FRAME, FRAME_TYPES, lookup


def extend(frames: Column, *more: Column) -> Column:
    """The frames and then the others', each in its order; null counts as empty."""
    return F.concat(*(F.coalesce(f, F.array().cast(f"array<{FRAME}>")) for f in (frames, *more)))


def append(frames: Column, frame: Column) -> Column:
    return F.array_append(frames, frame)


def part(frames: Column, start: int = 0, stop: int | None = None) -> Column:
    """frames[start:stop]; negative places count from the end."""
    n = F.size(frames)
    place = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)
    first, last = place(start), n if stop is None else place(stop)
    return F.slice(frames, first + 1, F.greatest(last - first, F.lit(0)))


def types(frames: Column) -> Column:
    return F.transform(frames, lambda f: f["type"])


def owners(frames: Column) -> Column:
    """runtime or model for each frame."""
    return F.transform(frames, lambda f: lookup({t[0]: t[3] for t in FRAME_TYPES}, f["type"]))


def same(a: Column, b: Column) -> Column:
    """Whether two trajectories have the same types and contents; what was read from does not count."""
    content = lambda frames: F.transform(frames, lambda f: F.struct(f["type"], f["kind"], f["json"]))
    return content(a).eqNullSafe(content(b))


def to_json(frames: Column) -> Column:
    """JSON list of {type, content}, not ASCII-escaped."""
    return F.concat(F.lit("["), F.array_join(F.transform(frames, lambda f: F.concat(F.lit('{"type": "'), f["type"], F.lit('", "content": '), f["json_utf8"], F.lit("}"))), ", "), F.lit("]"))
