"""Runs of an agent over recorded generations: which step ended a run, why, and what it answered.

The model's part is a table of recorded steps (run_id, step, raw_text, n_gen). A run's steps are cut
to the most iterations before they are gathered, so that a row of the gathered table is bounded.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.pyjson import arrow_udf, loads, payload, sound
from frameloom.functions.schema import RUNTIME_TYPES, SLOT, TERMINAL_TOOLS, TYPES, marker, reserved
from frameloom.functions.tools import Call, bare, read
from frameloom.operators.registry import ToolRegistry
from frameloom.operators.results import repeats

END = reserved(SLOT["end"])
_SPLIT = re.compile(rf"(?=<\|(?:{'|'.join(TYPES)})\|>)")


class ReadError(ValueError):
    """Text that is no sequence of frames."""


def read_wire(text: str, strict: bool) -> list[dict[str, Any]]:
    """Frames of one generation, as plain values; the same rules as the wire's parse over columns."""
    for kind, slot in reversed(SLOT.items()):
        text = text.replace(reserved(slot), marker(kind))
    body = text.lstrip()
    out = []
    for piece in filter(None, _SPLIT.split(body)):
        kind, _, raw = piece[2:].partition("|>") if piece.startswith("<|") else ("", "", piece)
        if kind not in TYPES:
            raise ReadError(f"expected frame marker at offset {len(text) - len(body)}, got: {body[:40]!r}")
        if strict and kind in RUNTIME_TYPES:
            raise ReadError(f"runtime-owned marker {marker(kind)!r} found in model output")
        out.append({"type": kind, "content": payload(kind, raw)[0]})
    return out


def _execute(registry: ToolRegistry, name: Any, args: dict[str, Any]) -> Any:
    """A call's value, or the reason that there is none; a value that JSON can't hold is its text."""
    out = registry.attempt(str(name), args)
    if out.reason is not None:
        return out.reason
    try:
        return loads(json.dumps(out.value))
    except (ValueError, TypeError, RecursionError):
        return sound(str(out.value))


def run_frames(steps: list[tuple[str, int]], registry: ToolRegistry, max_iterations: int, max_new_tokens: int, strict: bool) -> dict[str, Any]:
    """One run: steps are (text, generated tokens)."""
    frames: list[dict[str, Any]] = []
    for n, (text, generated) in enumerate(steps[:max_iterations], 1):
        try:
            new = read_wire(text, strict)
        except ReadError as e:
            return {"stopped_on": f"parse_error: {e}", "iterations": n, "answer": None, "frames": frames}
        frames += new
        actions = [f["content"] or {} for f in new if f["type"] == "action"]
        if not actions:
            return {"stopped_on": "no_action", "iterations": n, "answer": None, "frames": frames}
        for content in actions:
            if not isinstance(content, dict):
                return {"stopped_on": "parse_error: action is no object", "iterations": n, "answer": None, "frames": frames}
            tool = content.get("tool")
            if tool in TERMINAL_TOOLS:
                frames.append({"type": "result", "content": {"tool": tool, "value": None}})
                return {"stopped_on": "terminal_action", "iterations": n, "answer": content.get("text") if tool == "answer" else None, "frames": frames}
            frames.append({"type": "result", "content": {"tool": tool, "value": _execute(registry, tool, {k: v for k, v in content.items() if k != "tool"})}})
        if generated >= max_new_tokens and not text.endswith(END):
            return {"stopped_on": "max_tokens", "iterations": n, "answer": None, "frames": frames}
    return {"stopped_on": "max_iterations", "iterations": max_iterations if len(steps) >= max_iterations else len(steps), "answer": None, "frames": frames}


#: Fixed patterns of a chat model's tokens: a tagged call, and the text up to the first stop.
_TOOL = re.compile(r"<\|python_tag\|>(.+?)<\|(?:eom_id|eot_id)\|>", re.DOTALL)
_STOP = re.compile(r"<\|(?:eot_id|eom_id)\|>")
_TEXT = re.compile(r"\A(?:<\|start_header_id\|>assistant<\|end_header_id\|>)?\s*(.*?)<\|(?:eot_id|eom_id)\|>", re.DOTALL)


def read_chat(text: str) -> tuple[Call | None, str, str]:
    """(call, text, stop) of one generation of a chat model; the same rules as parse_generation over columns."""
    stops = _STOP.search(text)
    if stops and (found := _TOOL.search(text)):
        call = read(found[1])
        return (None, "", f"parse_error: {call.error}") if call.error is not None else (call, "", "tool_call")
    plain = bare(text)
    if plain.startswith("{") and (call := read(plain)).name:
        return call, "", "tool_call"
    found = stops and _TEXT.search(text)  # with a stop in it, from its beginning
    said = (found[1] if found else text).strip()
    return None, said, "assistant_text" if said else "parse_error: empty"


def run_chat(steps: list[tuple[str, int]], registry: ToolRegistry, max_iterations: int, before: int = 0) -> dict[str, Any]:
    """One run of a chat model, after so many messages before: a call's id is the place of its message. A call that ends the run is a message as any other; no generation is too long."""
    messages: list[dict[str, Any]] = []
    for n, (text, _) in enumerate(steps[:max_iterations], 1):
        call, said, stop = read_chat(text)
        done = {"iterations": n, "answer": None, "frames": messages}
        if stop.startswith("parse_error"):
            return done | {"stopped_on": stop}
        if call is None:
            messages.append({"role": "assistant", "content": said})
            return done | {"stopped_on": "terminal_action", "answer": said}
        if not call.name:
            return done | {"stopped_on": "parse_error: tool call missing name"}
        if not isinstance(call.args, dict):
            return done | {"stopped_on": "parse_error: arguments are no object"}
        ident = f"call_{before + len(messages)}"
        messages.append({"role": "assistant", "content": said, "tool_calls": [{"id": ident, "type": "function", "function": {"name": call.name, "arguments": json.dumps(call.args)}}]})
        if call.name in TERMINAL_TOOLS:
            return done | {"stopped_on": "terminal_action", "answer": (call.args.get("text") or said) if call.name == "answer" else None}
        messages.append({"role": "tool", "tool_call_id": ident, "content": json.dumps({"tool": call.name, "value": _execute(registry, call.name, call.args)})})
    return {"stopped_on": "max_iterations", "iterations": min(len(steps), max_iterations), "answer": None, "frames": messages}


_RUN = "struct<stopped_on:string,iterations:int,answer:string,frames:string>"


def replay(steps: DataFrame, registry: ToolRegistry, kind: str = "frames", max_iterations: int = 10, max_new_tokens: int = 512, strict: bool = True) -> DataFrame:
    """(run_id, stopped_on, iterations, answer, frames) of recorded steps(run_id, step, raw_text, n_gen).

    frames is the JSON of what the run appended: frames, or messages for kind chat, whose calls are numbered from n_given, a column
    of steps that may say how many messages came before. step counts from 0. What a model wrote that can't be read, or called with what is no object, is its run's stop reason and ends no other run.
    The registry's tools run on the executors, and must be picklable.
    """

    def run(recorded) -> dict[str, Any]:
        given = [(sound(s["raw_text"] or ""), s["n_gen"] or 0) for s in recorded]
        out = run_frames(given, registry, max_iterations, max_new_tokens, strict) if kind == "frames" else run_chat(given, registry, max_iterations, recorded[0]["n_given"] or 0)
        answer = out["answer"]
        return out | {"frames": json.dumps(out["frames"]), "answer": answer if answer is None else str(answer)}

    before = (F.col("n_given") if "n_given" in steps.columns else F.lit(0)).cast("int").alias("n_given")
    gathered = steps.where(F.col("step") < max_iterations).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("step", "raw_text", "n_gen", before))).alias("_s"))
    return gathered.withColumn("_r", arrow_udf(_RUN)(run)(F.col("_s"))).select("run_id", "_r.*")


def command_stops(steps: DataFrame, max_iterations: int = 250, limit: int = 3) -> DataFrame:
    """(run_id, stopped_on, iterations) of command steps(run_id, step, command, problem, n_calls, submitted, max_tokens).

    The first step that ends a run says why: a parse problem or a failed step before its command; a
    command come limit times in a row; a submission; no call at all; a generation cut at its limit.
    """
    marked = repeats(steps.where(F.col("step") < max_iterations), "run_id", "step", "command", limit)
    why = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("n_calls") == 0, "no_action").when(F.col("repeated"), "repeated_command").when(F.col("submitted"), "submitted").when(F.col("max_tokens"), "max_tokens")
    )
    ends = marked.withColumn("_why", why).groupBy("run_id").agg(F.min(F.when(F.col("_why").isNotNull(), F.struct("step", "_why"))).alias("_end"), F.max("step").alias("_last"))
    return ends.select("run_id", F.coalesce("_end._why", F.lit("max_iterations")).alias("stopped_on"), (F.coalesce("_end.step", "_last") + 1).alias("iterations"))


def nested_results(steps: DataFrame) -> DataFrame:
    """(id, turns array<array<string>>) of recorded steps(id, turn, step, result): the results of each turn in order, a turn up to its first that ends it (empty, or `[]`)."""
    ends = F.min(F.when(F.coalesce("result", F.lit("")).isin("", "[]"), F.col("step")))
    bound = steps.groupBy("id", "turn").agg(ends.alias("_end"))
    kept = steps.join(bound, ["id", "turn"]).where(F.col("_end").isNull() | (F.col("step") < F.col("_end")))
    turns = steps.select("id", "turn").distinct().join(kept.groupBy("id", "turn").agg(F.array_sort(F.collect_list(F.struct("step", "result"))).alias("_s")), ["id", "turn"], "left")
    told = F.coalesce(F.transform("_s", lambda s: s["result"]), F.array().cast("array<string>"))
    gathered = turns.withColumn("_t", told).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "_t"))).alias("_all"))
    return gathered.select("id", F.transform("_all", lambda t: t["_t"]).alias("turns"))


def first_calls(messages: Column) -> Column:
    """array<struct<role, name, arguments, response, text>>: a run as a chain. Leading system and user messages are left out;
    of an assistant's calls the first counts, with the tool message after it as response (blank for Finish)."""
    node = "struct<role:string,name:string,arguments:string,response:string,text:string>"
    none = F.lit(None).cast("string")

    def one(x: Column) -> Column:
        m, following = x["m"], x["next"]
        call = F.get(m["tool_calls"], F.lit(0))["function"]
        response = F.when((call["name"] != "Finish") & (following["role"] == "tool"), F.coalesce(following["content"], F.lit(""))).otherwise("")
        tool = F.struct(F.lit("tool").alias("role"), call["name"].alias("name"), call["arguments"].alias("arguments"), response.alias("response"), none.alias("text"))
        said = F.struct(F.lit("assistant").alias("role"), none.alias("name"), none.alias("arguments"), none.alias("response"), F.coalesce(m["content"], F.lit("")).alias("text"))
        return F.when(F.size(m["tool_calls"]) > 0, tool).otherwise(said)

    def chain(bound: Column) -> Column:
        followed = F.zip_with(bound, F.slice(bound, 2, F.size(bound)), lambda m, following: F.struct(m.alias("m"), following.alias("next")))
        return F.transform(F.filter(followed, lambda x: x["m"]["role"] == "assistant"), one)

    # the messages are an element of an array, so that they are made once, and each is set beside the next
    return F.get(F.transform(F.array(messages), chain), F.lit(0)).cast(f"array<{node}>")
