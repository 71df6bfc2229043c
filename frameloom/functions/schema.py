"""Schemas of frames, messages and results, and the frame types as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the wire format: type, slot, token id, owner, payload, whether it closes a model turn.
FRAME_TYPES = [
    ("goal", 0, 128002, "runtime", "prose", False),
    ("mission", 1, 128003, "runtime", "prose", False),
    ("obs", 2, 128005, "runtime", "prose", False),
    ("belief", 3, 128011, "model", "prose", True),
    ("plan", 4, 128012, "model", "prose", True),
    ("think", 5, 128013, "model", "prose", True),
    ("action", 6, 128014, "model", "json", True),
    ("end", 7, 128015, "model", "empty", False),
    ("result", 8, 128016, "runtime", "json", False),
    ("feedback", 9, 128017, "runtime", "prose", False),
    ("reward", 10, 128018, "runtime", "number", False),
]
TYPES = [t[0] for t in FRAME_TYPES]
SLOT = {t[0]: t[1] for t in FRAME_TYPES}
TOKEN = {t[0]: t[2] for t in FRAME_TYPES}
RUNTIME_TYPES = [t[0] for t in FRAME_TYPES if t[3] == "runtime"]
MODEL_TYPES = [t[0] for t in FRAME_TYPES if t[3] == "model"]
TURN_CLOSERS = [t[0] for t in FRAME_TYPES if t[5]]
TERMINAL_TOOLS = ["answer", "fail"]

#: content in the forms that operators need: kind (null, string, number, bool, object, array), Python's str() of it, its
#: JSON text with and without ASCII escapes, whether it is truthy; of an object its tool, the other keys as JSON, and text or reason.
FRAME = "struct<type:string,kind:string,text:string,json:string,json_utf8:string,truthy:boolean,tool:string,args:string,answer:string,raw:string,error:string>"
TOOL_CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,tool_call_id:string,tool_calls:array<{TOOL_CALL}>>"
VIOLATION = "struct<rule:string,frame_index:int,message:string>"
TASK_RESULT = (
    "task_id string, domain string, success boolean, metrics map<string,string>, "
    "timing struct<load_sec:double,inference_sec:double,tool_sec:double,total_sec:double>, "
    "tokens struct<prompt_tokens:bigint,generated_tokens:bigint,total_tokens:bigint>, detail map<string,string>"
)


def marker(kind: str) -> str:
    return f"<|{kind}|>"


def reserved(slot: int) -> str:
    return f"<|reserved_special_token_{slot}|>"


def frame_types(spark: SparkSession) -> DataFrame:
    """The eleven frame types with their markers: a table to join."""
    rows = [(*t, marker(t[0]), reserved(t[1])) for t in FRAME_TYPES]
    return spark.createDataFrame(rows, "type string, slot int, token_id int, owner string, payload string, turn_closer boolean, marker string, reserved string")


def lookup(values: dict, key: Column) -> Column:
    """A literal map's value at key; null if it has none."""
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def frame(kind: str | Column, text: Column | str | None = None) -> Column:
    """A frame with prose or no content."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = F.lit(text) if text is None or isinstance(text, str) else text
    text = text.cast("string")
    quoted = quote(text)
    none = F.lit(None).cast("string")
    return F.struct(
        kind.alias("type"), F.when(text.isNull(), "null").otherwise("string").alias("kind"), F.coalesce(text, F.lit("None")).alias("text"), F.coalesce(quoted, F.lit("null")).alias("json"),
        F.coalesce(quoted, F.lit("null")).alias("json_utf8"), (F.coalesce(text, F.lit("")) != "").alias("truthy"), none.alias("tool"), none.alias("args"), none.alias("answer"), none.alias("raw"), none.alias("error"),
    ).cast(FRAME)


def quote(text: Column) -> Column:
    """text as a JSON string, not ASCII-escaped; null stays null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))
