"""Frames to chat messages and back, over array columns; all in time that grows with the array."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions import pyjson, text, tools
from frameloom.functions.schema import FRAME, MESSAGE, TERMINAL_TOOLS, TOOL_CALL, frame, quote

_MESSAGES, _FRAMES, _STRINGS = f"array<{MESSAGE}>", f"array<{FRAME}>", "array<string>"
#: In this order the first that a system text contains begins its tools part.
TOOLS_MARKERS = ["namespace tools {", "tools:", "available tools:"]


def message(role: str, content: Column, tool_call_id: Column | None = None, calls: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(role).alias("role"), content.alias("content"), (tool_call_id if tool_call_id is not None else none).alias("tool_call_id"), (calls if calls is not None else F.lit(None).cast(f"array<{TOOL_CALL}>")).alias("tool_calls")
    ).cast(MESSAGE)


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is worked out once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def settled(df: DataFrame) -> DataFrame:
    """df, as a plan whose columns later ones don't take apart: to be put between a conversion and a Python UDF that reads it.

    A conversion's inner functions read what outer ones hold, and Spark fails to take a UDF out of one expression with such;
    a filter that is always true, but is not known to be, keeps the two apart, and moves no row.
    """
    return df.where(F.rand() >= 0)


def _in_order(*placed: Column) -> Column:
    """The items of arrays of (at, items), by where they stand."""
    return F.flatten(F.transform(F.array_sort(F.concat(*placed)), lambda x: x["items"]))


def frames_to_messages(frames: Column) -> Column:
    """array<message>. Goals and observations become the system text at the next mission (or at the front, once all ids are given); reasoning waits for the next action.

    In time that grows with the frames: what an action or a mission gathers is the slice since the one before, and an id is a message's place.
    """
    return _once(frames, _messages_of)


def _messages_of(frames: Column) -> Column:
    placed = F.transform(frames, lambda f, i: F.struct(i.alias("at"), f.alias("f")))
    none = F.lit(None).cast("string")

    def since(others: Column, k: Column) -> Column:
        """The place of the k-th of others; -1 before the first."""
        return F.when(k >= 0, F.get(others, k)["at"]).otherwise(-1)

    def texts(before: Column, upto: Column, *kinds: str) -> Column:
        between = F.slice(frames, before + 2, upto - before - 1)
        return F.transform(F.filter(between, lambda f: f["type"].isin(*kinds)), lambda f: f["text"])

    def system(parts: Column) -> Column:
        return F.when(F.size(parts) > 0, F.array(message("system", F.array_join(parts, "\n\n")))).otherwise(F.array().cast(_MESSAGES))

    def acted(f: Column, said: Column) -> Column:
        final = F.when(said != "", text.strip(F.concat(said, F.lit("\n\n"), f["answer"]))).otherwise(f["answer"])
        call = F.struct(none.alias("id"), F.lit("function").alias("type"), F.struct(f["tool"].alias("name"), f["args"].alias("arguments")).alias("function"))
        return F.when(f["tool"].isin(TERMINAL_TOOLS), message("assistant", final)).otherwise(message("assistant", said, calls=F.array(call)))

    def at(x: Column, items: Column) -> Column:
        return F.struct(x["at"].alias("at"), items.alias("items"))

    def of_actions(actions: Column) -> Column:
        return F.transform(actions, lambda x, k: at(x, F.array(_once(F.array_join(texts(since(actions, k - 1), x["at"], "belief", "plan", "think"), "\n"), lambda said: acted(x["f"], said)))))

    def of_missions(missions: Column) -> Column:
        opened = lambda x, k: _once(texts(since(missions, k - 1), x["at"], "goal", "obs"), system)
        return F.transform(missions, lambda x, k: at(x, F.concat(opened(x, k), F.array(message("user", x["f"]["text"])))))

    def numbered(m: Column, i: Column) -> Column:
        ident = F.concat(F.lit("call_"), F.when(m["role"] == "tool", i - 1).otherwise(i).cast("string"))
        calls = F.transform(m["tool_calls"], lambda c: c.withField("id", ident))
        return m.withField("tool_calls", calls).withField("tool_call_id", F.when(m["role"] == "tool", ident)).cast(MESSAGE)

    is_action = lambda x: (x["f"]["type"] == "action") & (x["f"]["kind"] == "object")
    others = F.transform(
        F.filter(placed, lambda x: x["f"]["type"].isin("result", "feedback")),
        lambda x: at(x, F.array(F.when(x["f"]["type"] == "result", message("tool", x["f"]["json"])).otherwise(message("user", x["f"]["text"])))),
    )
    out = F.transform(_in_order(_once(F.filter(placed, is_action), of_actions), _once(F.filter(placed, lambda x: x["f"]["type"] == "mission"), of_missions), others), numbered)
    missions = F.filter(placed, lambda x: x["f"]["type"] == "mission")
    left = _once(missions, lambda m: texts(since(m, F.size(m) - 1), F.size(frames), "goal", "obs"))
    return F.concat(_once(left, system), out)


def system_frames(content: Column) -> Column:
    """A system text as goal and observation. The first of the tools markers, by rank and not by place, begins the observation."""
    pick = F.lit(None).cast("int")
    for mark in reversed(TOOLS_MARKERS):
        pick = F.when(content.contains(mark), F.instr(content, mark)).otherwise(pick)
    prefix, tools = text.strip(F.substring(content, F.lit(1), pick - 1)), text.strip(F.substring(content, pick, F.length(content)))
    marked = F.concat(F.when(prefix != "", F.array(frame("goal", prefix))).otherwise(F.array().cast(_FRAMES)), F.array(frame("obs", tools)))
    parts = F.split(content, "\n\n")
    rest = F.slice(parts, F.lit(2), F.size(parts))
    split = F.array(frame("goal", parts[0]), frame("obs", F.array_join(rest, "\n\n")))
    return F.when(pick.isNotNull(), marked).when((F.size(parts) >= 2) & F.exists(rest, lambda p: F.lower(p).contains("tools")), split).otherwise(F.array(frame("goal", content)))


def assistant_frames(m: Column) -> Column:
    """An assistant's message: its text as thought before tool calls, or else as an answer."""
    said = text.strip(m["content"])
    thought = F.when(said != "", F.array(frame("think", said))).otherwise(F.array().cast(_FRAMES))
    quoted = quote(said)
    answer = F.struct(
        F.lit("action").alias("type"), F.lit("object").alias("kind"), F.concat(F.lit("{'tool': 'answer', 'text': "), quoted, F.lit("}")).alias("text"), F.concat(F.lit('{"tool": "answer", "text": '), quoted, F.lit("}")).alias("json"),
        F.concat(F.lit('{"tool": "answer", "text": '), quoted, F.lit("}")).alias("json_utf8"), F.lit(True).alias("truthy"), F.lit("answer").alias("tool"), F.concat(F.lit('{"text": '), quoted, F.lit("}")).alias("args"), said.alias("answer"),
        F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("error"),
    ).cast(FRAME)
    answers = F.when(said != "", F.array(answer)).otherwise(F.array().cast(_FRAMES))
    return F.when(F.size(m["calls"]) > 0, F.concat(thought, F.transform(m["calls"], lambda c: c["frame"]))).otherwise(answers)


def messages_to_frames(messages: Column) -> Column:
    """struct<frames, error> of ingested messages.

    Each assistant's message sets anew which tools the next results belong to. A result that is no
    object with a tool is wrapped with the tool's name, `unknown` where none is left. In time that grows with the messages:
    they are cut at the assistants' messages, and a result takes the tool of its number in its part.
    """
    return _once(messages, _frames_of)


def _wrapped(m: Column, tool: Column) -> Column:
    """A tool message's payload beside its tool's name, as a result."""
    none = F.lit(None).cast("string")
    body = {k: F.concat(F.lit('{"tool": '), quote(tool), F.lit(', "value": '), m[k], F.lit("}")) for k in ("payload_json", "payload_utf8")}
    return F.struct(
        F.lit("result").alias("type"), F.lit("object").alias("kind"), body["payload_utf8"].alias("text"), body["payload_json"].alias("json"), body["payload_utf8"].alias("json_utf8"), F.lit(True).alias("truthy"), tool.alias("tool"),
        F.concat(F.lit('{"value": '), m["payload_json"], F.lit("}")).alias("args"), F.lit("").alias("answer"), none.alias("raw"), none.alias("error"),
    ).cast(FRAME)


def _frames_of(messages: Column) -> Column:
    placed = F.transform(messages, lambda m, i: F.struct(i.alias("at"), m.alias("m")))
    first_user = F.array_position(F.transform(messages, lambda m: F.coalesce(m["role"], F.lit(""))), "user") - 1
    is_tool = lambda x: F.coalesce(x["m"]["role"] == "tool", F.lit(False))

    def called(m: Column) -> Column:
        """Names of the tools that an assistant's message leaves to be answered; none before the first."""
        named = F.transform(F.filter(m["calls"], lambda c: F.coalesce(c["frame"]["tool"], F.lit("")) != ""), lambda c: c["frame"]["tool"])
        answered = F.when(~m["blank"], F.array(F.lit("answer"))).otherwise(F.array().cast(_STRINGS))
        return F.coalesce(F.when(F.size(m["calls"]) > 0, named).otherwise(answered), F.array().cast(_STRINGS))

    def results_of(names: Column, part: Column) -> Column:
        one = lambda x, j: F.when(x["m"]["payload_kind"] == "as_is", x["m"]["payload"]).otherwise(_wrapped(x["m"], F.coalesce(F.get(names, j), F.lit("unknown"))))
        return F.transform(F.filter(part, is_tool), lambda x, j: F.struct(x["at"].alias("at"), F.array(one(x, j)).alias("items")))

    def parts(all_: Column, heads: Column) -> Column:
        """The results of each part: after one assistant's message, up to the next."""

        def of(head: Column, k: Column) -> Column:
            part = F.slice(all_, head + 2, F.coalesce(F.get(heads, k + 1), F.size(messages)) - head - 1)
            return _once(F.when(head >= 0, called(F.get(messages, head))).otherwise(F.array().cast(_STRINGS)), lambda names: results_of(names, part))

        return F.flatten(F.transform(heads, of))

    def other(x: Column) -> Column:
        m, role = x["m"], x["m"]["role"]
        user = frame(F.when(x["at"] == first_user, "mission").otherwise("feedback"), m["content"])
        made = F.when(role == "system", system_frames(m["content"])).when(role == "user", F.array(user)).when(role == "assistant", assistant_frames(m))
        return F.struct(x["at"].alias("at"), F.coalesce(made, F.array().cast(_FRAMES)).alias("items"))

    heads = F.concat(F.array(F.lit(-1)), F.transform(F.filter(placed, lambda x: x["m"]["role"] == "assistant"), lambda x: x["at"]))
    made = _once(placed, lambda all_: _in_order(F.transform(F.filter(all_, lambda x: ~is_tool(x)), other), _once(heads, lambda h: parts(all_, h))))
    bad = F.get(F.filter(messages, lambda m: (m["role"] == "tool") & (m["payload_kind"] == "bad")), F.lit(0))
    return F.struct(made.alias("frames"), F.when(bad.isNotNull(), F.concat(F.lit("TypeError: result without keys: "), bad["payload_json"])).alias("error"))


def looks_like(first_keys: Column, shape: str) -> Column:
    """Whether a list's first element, given by its keys, is a chat message (has role) or a frame (has type and no role)."""
    role, kind = F.array_contains(first_keys, "role"), F.array_contains(first_keys, "type")
    return F.coalesce(role if shape == "messages" else kind & ~role, F.lit(False))


def first_keys(column: Column) -> Column:
    """Keys of the first element of a JSON list; null if there is none."""
    return F.json_object_keys(F.get_json_object(column, "$[0]"))


def coerce(df: DataFrame, column: str) -> DataFrame:
    """df with frames and messages of a JSON column that holds either; error where it can't be read.

    The shape follows from the first element alone. An empty list gives empty arrays.
    """
    chat = looks_like(first_keys(F.col(column)), "messages")
    read = df.withColumn("_m", F.when(chat, pyjson.ingest_messages(F.col(column)))).withColumn("_f", F.when(~chat, pyjson.ingest_frames(F.col(column))))
    read = read.withColumn("_c", messages_to_frames(F.col("_m.messages")))
    plain = F.transform(F.col("_m.messages"), _plain)
    return read.select(
        *df.columns, F.coalesce("_f.frames", "_c.frames").alias("frames"), F.when(chat, plain).otherwise(frames_to_messages(F.col("_f.frames"))).alias("messages"), F.coalesce("_f.error", "_m.error", "_c.error").alias("error")
    )


def _plain(m: Column) -> Column:
    calls = F.transform(m["calls"], lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
    return F.struct(m["role"].alias("role"), m["content"].alias("content"), m["tool_call_id"].alias("tool_call_id"), F.when(F.size(calls) > 0, calls).alias("tool_calls")).cast(MESSAGE)


def inject_tools(messages: Column, tools_json: Column) -> Column:
    """messages with the tools' JSON added to the first system text, or as a system message in front. Null tools: as they are."""
    block = F.concat(F.lit("available tools:\n"), tools_json)
    at = F.array_position(F.transform(messages, lambda m: m["role"]), "system")

    def add(m: Column, i: Column) -> Column:
        said = text.strip(F.concat(F.coalesce(m["content"], F.lit("")), F.lit("\n\n"), block))
        return F.when(i == at - 1, m.withField("content", said)).otherwise(m)

    return F.when(tools_json.isNull(), messages).when(at > 0, F.transform(messages, add)).otherwise(F.concat(F.array(message("system", block)), messages))


def has_tool_obs(frames: Column) -> Column:
    return F.exists(frames, lambda f: (f["type"] == "obs") & f["truthy"] & f["text"].contains("namespace tools {"))


def with_tool_obs(frames: Column, rendered: Column) -> Column:
    """frames with an observation of the rendered tools after the first goal, at the end without one; as they are if there is one, or no tools."""
    at = F.array_position(F.transform(frames, lambda f: f["type"]), "goal")
    place = F.when(at > 0, at + 1).otherwise(F.size(frames) + 1).cast("int")
    return F.when((F.coalesce(rendered, F.lit("")) == "") | has_tool_obs(frames), frames).otherwise(F.array_insert(frames, place, frame("obs", rendered)))


_STOP = r"<\|(?:eom_id|eot_id)\|>"


def parse_generation(df: DataFrame, column: str) -> DataFrame:
    """df with what a chat model wrote: call (a tool call's JSON), said (its text) and stop.

    A tagged call comes first, then a bare call, then the text up to the first stop token.
    """
    raw = F.coalesce(F.col(column), F.lit(""))
    tagged = F.regexp_extract(raw, rf"(?s)<\|python_tag\|>(.+?){_STOP}", 1)
    stops = raw.rlike(_STOP)
    has_tag = stops & raw.rlike(rf"(?s)<\|python_tag\|>(.+?){_STOP}")
    bare = text.strip(F.regexp_replace(text.strip(raw), r"<\|(?:eot_id|eom_id|python_tag)\|>", ""))
    body = F.when(has_tag, tagged).when(bare.startswith("{"), bare)
    out = df.withColumn("_read", read_call(body))
    call = F.when(has_tag, F.when(F.col("_read.error").isNull(), F.col("_read.call"))).when(F.col("_read.named"), F.col("_read.call"))
    # with a stop in it, the text begins where it begins: no other place need be tried
    rest = rf"(?s)\A(?:<\|start_header_id\|>assistant<\|end_header_id\|>)?{text.SPACE.replace('(?U)', '')}*(.*?)<\|(?:eot_id|eom_id)\|>"
    said = text.strip(F.when(stops, F.regexp_extract(raw, rest, 1)).otherwise(raw))
    text_only = ~has_tag & call.isNull()
    stop = F.when(has_tag & F.col("_read.error").isNotNull(), F.concat(F.lit("parse_error: "), F.col("_read.error"))).when(call.isNotNull(), "tool_call").when(said != "", "assistant_text").otherwise("parse_error: empty")
    return out.select(*df.columns, call.alias("call"), F.when(text_only, said).otherwise("").alias("said"), stop.alias("stop"))


@pyjson.arrow_udf("struct<call:string,error:string,named:boolean,name:string,args:string>")
def read_call(body: str | None):
    """JSON text of a call -> the call, whether it has a name or tool, that name, and its arguments (or parameters) decoded."""
    if body is None:
        return None
    call = tools.read(body)
    out = {"call": None, "error": call.error, "named": call.name is not None, "name": call.name, "args": None}
    if call.error is not None:
        return out
    key = "arguments" if "arguments" in call.value else "parameters"
    shown = call.value | {key: call.args} if call.name and call.args is not None and isinstance(call.value.get(key), str) else call.value
    try:
        return out | {"call": json.dumps(shown), "args": None if call.args is None else json.dumps(call.args)}
    except RecursionError:
        return out | {"error": tools.TOO_DEEP, "named": False, "name": None}
