"""Text functions with Python's notion of white space, numbers and rounding, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.schema import FRAME_TYPES, marker, reserved

#: Python's white space.
SPACE = r"(?U)[\s\x1c-\x1f]"


def collapse(text: Column) -> Column:
    """Lower case, every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A[\s\x1c-\x1f]+", "")


def strip(text: Column) -> Column:
    return lstrip(rstrip(text))


def dedup_key(text: Column) -> Column:
    """SHA-1 of the collapsed text."""
    return F.sha1(collapse(text))


def to_markers(text: Column) -> Column:
    """Reserved tokens as readable markers."""
    for kind, slot, *_ in reversed(FRAME_TYPES):
        text = F.replace(text, F.lit(reserved(slot)), F.lit(marker(kind)))
    return text


def to_reserved(text: Column) -> Column:
    for kind, slot, *_ in FRAME_TYPES:
        text = F.replace(text, F.lit(marker(kind)), F.lit(reserved(slot)))
    return text


_DIGITS = r"[0-9](?:_?[0-9])*"


def to_float(text: Column) -> Column:
    """Python's float(str) for ASCII digits: 1_000, nan and inf pass; 1.5d and 0x1p3 don't. Null otherwise."""
    text = strip(text)
    number = text.rlike(rf"\A[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z")
    named = text.rlike(r"(?i)\A[+-]?(?:nan|inf|infinity)\z")
    name = F.when(F.lower(text).contains("nan"), F.lit(float("nan"))).when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(number, F.replace(text, F.lit("_"), F.lit("")).try_cast("double")).when(named, name)


def preview(text: Column, limit: int = 300) -> Column:
    """One line of at most limit characters, ... where it was cut."""
    line = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("..."))).otherwise(line)


def cut(text: Column, limit: int = 1024) -> Column:
    """At most limit characters, ... where it was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


#: Said where output was cut; a fixed value.
TOO_LONG = "The output of your last command was too long. Try a more selective command."


def _tag(name: str, *inner: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), *(F.lit(x) if isinstance(x, str) else x for x in inner), F.lit(f"</{name}>"))


def command_output(output: Column, returncode: Column, exception: Column | None = None, limit: int = 10_000) -> Column:
    """A command's output as tagged text; from limit characters on, its head, how many were left out, and its tail. A null return code is -1."""
    output = F.coalesce(output, F.lit(""))
    size, half = F.length(output), limit // 2
    head, tail = F.substring(output, 1, half), F.right(output, F.lit(half))
    elided = _tag("elided_chars", (size - limit).cast("string"), " characters elided")
    parts = F.concat_ws("\n", _tag("warning", TOO_LONG), _tag("output_head", "\n", head), elided, _tag("output_tail", "\n", tail))
    said = F.nullif(strip(exception), F.lit("")) if exception is not None else F.lit(None).cast("string")
    code = _tag("returncode", F.coalesce(returncode, F.lit(-1)).cast("string"))
    return F.concat_ws("\n", F.when(said.isNotNull(), _tag("exception", said)), code, F.when(size < limit, _tag("output", "\n", output)).otherwise(parts))


def directory_name(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("_"))


def identifier(name: Column) -> Column:
    """A tool's name as an identifier: other signs as _, runs of _ as one, lower case, no _ at the ends, get_ before a digit."""
    out = F.regexp_replace(name, r"[^一-龥^a-zA-Z0-9_]", "_")
    out = F.regexp_replace(F.lower(F.regexp_replace(out, "_+", "_")), "^_+|_+$", "")
    return F.when(out.rlike("^[0-9]"), F.concat(F.lit("get_"), out)).otherwise(out)


#: Names that an identifier must not have; fixed values.
RESERVED_NAMES = ["from", "class", "return", "false", "true", "id", "and"]


def safe_name(name: Column) -> Column:
    return F.when(name.isin(RESERVED_NAMES), F.concat(F.lit("is_"), name)).otherwise(name)


#: Status codes of a tool's error text; fixed values.
STATUS_CODES = {
    "API not working error...": 6, "Unauthorized error...": 7, "Unsubscribed error...": 8, "Too many requests error...": 9,
    "Rate limit per minute error...": 10, "Rate limit error...": 10, "Message error...": 11,
}


def status_code(error: Column) -> Column:
    found = F.create_map(*(F.lit(x) for kv in STATUS_CODES.items() for x in kv))[error]
    return F.coalesce(found, F.lit(0))


def called_tool(call: Column) -> Column:
    """Name before the ( of a call's text, or unknown."""
    return F.coalesce(F.nullif(strip(F.split(call, r"\(", 2)[0]), F.lit("")), F.lit("unknown"))


def fraction(text: Column) -> Column:
    """a/b as percent; null if it is no such fraction or b is 0."""
    part = F.split(text, "/")
    return F.lit(100.0) * part[0].try_cast("double") / F.nullif(F.get(part, F.lit(1)).try_cast("double"), F.lit(0.0))
