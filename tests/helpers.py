import json

from pyspark.sql import functions as F

from frameloom.functions import pyjson

KINDS = dict(zip("gmobpkaterfw", "goal mission obs belief plan think action action end result feedback reward".split(), strict=True))
BASH, ANSWER = {"tool": "bash", "command": "ls"}, {"tool": "answer", "text": "42"}


def frames_of(letters):
    """One letter a frame; t is a terminal action."""
    out = []
    for c in letters:
        content = {"a": BASH, "t": ANSWER, "r": {"tool": "bash", "value": "ok"}, "e": None, "w": 0.5}.get(c, f"{KINDS[c]} text")
        out.append({"type": KINDS[c], "content": content})
    return out


def frame_table(spark, rows):
    """(id, frames, error) of {id: list of frames}."""
    df = spark.createDataFrame([(i, json.dumps(f)) for i, f in rows.items()], "id string, j string")
    return df.withColumn("x", pyjson.ingest_frames(F.col("j"))).select("id", "x.frames", "x.error")


def message_table(spark, rows):
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in rows.items()], "id string, j string")
    return df.withColumn("x", pyjson.ingest_messages(F.col("j"))).select("id", "x.messages", "x.error")


def one(df, column):
    return {r["id"]: r[column] for r in df.select("id", column).collect()}
