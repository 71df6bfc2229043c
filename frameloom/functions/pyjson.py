"""Python's JSON rules as Arrow UDFs: the only stage in which frames cross to Python.

JSON text is accepted and written as Python's json does it (whole string, NaN accepted, the last of
equal keys wins, ", " and ": " between items), which no built-in expression does. Everything after
this stage works on the typed fields.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache, wraps
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.schema import FRAME, TYPES

@cache
def _made(fn: Callable, kind: str) -> Callable[..., Column]:
    return F.udf(fn, kind, useArrow=True)


def arrow_udf(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """F.udf over Arrow batches, made at its first use: a type's text can't be read before there is a session."""

    def wrap(fn: Callable) -> Callable[..., Column]:
        return wraps(fn)(lambda *columns: _made(fn, kind)(*columns))

    return wrap


#: What JSON that can't be read, or is nested too deep to be walked, raises.
UNREADABLE = (ValueError, TypeError, KeyError, AttributeError, RecursionError)


def sound(value: Any) -> Any:
    """value with each half of a surrogate pair that stands alone as U+FFFD: no column can hold one."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    if isinstance(value, dict):
        return {sound(k): sound(v) for k, v in value.items()}
    return [sound(v) for v in value] if isinstance(value, list) else value


def loads(text: str) -> Any:
    """json.loads, without lone surrogates. A number of more digits than Python reads is no JSON either."""
    try:
        return sound(json.loads(text))
    except json.JSONDecodeError:
        raise
    except ValueError as e:
        raise json.JSONDecodeError("number too long", text, 0) from e


_NOTHING = dict.fromkeys(("tool", "args", "answer", "raw", "error"))


def content_fields(content: Any) -> dict[str, Any]:
    """The fields of a frame that follow from its content."""
    kind = "null" if content is None else "bool" if isinstance(content, bool) else {str: "string", int: "number", float: "number", dict: "object"}.get(type(content), "array")
    out = _NOTHING | {"kind": kind, "text": str(content), "json": json.dumps(content), "json_utf8": json.dumps(content, ensure_ascii=False), "truthy": bool(content)}
    if kind == "object":
        args = {k: v for k, v in content.items() if k != "tool"}
        tool = content.get("tool")
        answer = args.get("text") or args.get("reason") or ""
        out |= {"tool": tool if tool is None or isinstance(tool, str) else str(tool), "args": json.dumps(args), "answer": str(answer)}
    return out


def short_type(name: Any) -> str | None:
    """goal for goal and for <|goal|>; None for what is no frame type."""
    name = str(name)
    name = name[2:-2] if name.startswith("<|") and name.endswith("|>") else name
    return name if name in TYPES else None


def payload(kind: str, body: str) -> tuple[Any, str | None]:
    """(content, error) of the text after a marker."""
    if kind == "end":
        return None, None
    text = body.strip()
    if kind in ("action", "result"):
        if not text:
            return None, "empty json payload"
        try:
            return loads(text), None
        except json.JSONDecodeError as e:
            return None, f"invalid json: {e.msg} at pos {e.pos}"
        except RecursionError:
            return None, "invalid json: nested too deep"
    if kind == "reward":
        if not text:
            return None, "empty reward payload"
        try:
            return float(text), None
        except ValueError as e:
            return None, f"invalid number: {e}"
    return body.rstrip(), None


@arrow_udf(f"struct<frames:array<{FRAME}>,error:string>")
def ingest_frames(text: str | None):
    """JSON text of a list of {type, content} -> typed frames; what can't be read gives an error and no frames."""
    try:
        items = loads(text) if text else None
        if not isinstance(items, list):
            return {"frames": None, "error": "frames: not a list"}
        out = []
        for x in items:
            kind = short_type(x["type"])
            if kind is None:
                return {"frames": None, "error": f"construct: unknown frame type {x['type']!r}"}
            out.append({"type": kind, **content_fields(x.get("content"))})
        return {"frames": out, "error": None}
    except UNREADABLE as e:
        return {"frames": None, "error": f"{type(e).__name__}: {e}"}


@arrow_udf(f"array<{FRAME}>")
def read_payloads(pieces):
    """[(type, raw)] -> frames."""
    if pieces is None:
        return None
    out = []
    for p in pieces:
        content, error = payload(p["type"], p["raw"])
        out.append({"type": p["type"], **content_fields(content), "raw": p["raw"], "error": error})
    return out


_CALL = f"struct<id:string,name:string,arguments:string,frame:{FRAME}>"
#: payload: what a tool message's content decodes to. as_is: an object (or a string or list) that holds tool; wrap: another
#: value, to be put beside the tool's name; raw: text that is no JSON; bad: a number or null, which has no keys to look at.
INGESTED = f"struct<role:string,content:string,blank:boolean,tool_call_id:string,calls:array<{_CALL}>,payload_kind:string,payload:{FRAME},payload_json:string,payload_utf8:string>"


def _message(m: dict[str, Any]) -> dict[str, Any]:
    content = m.get("content")
    calls = []
    for c in m.get("tool_calls") or []:
        fn = c.get("function") or {}
        raw = fn.get("arguments", "{}")
        args = loads(raw) if isinstance(raw, str) else dict(raw or {})
        whole = {"tool": fn.get("name"), **args}
        calls.append({"id": c.get("id"), "name": fn.get("name"), "arguments": raw if isinstance(raw, str) else json.dumps(raw), "frame": {"type": "action", **content_fields(whole)}})
    raw = content or "{}"
    kind, value = "as_is", None
    try:
        value = loads(raw) if isinstance(raw, str) else dict(raw)
        kind = "bad" if value is None or isinstance(value, (int, float)) else "as_is" if "tool" in value else "wrap"
    except (ValueError, TypeError, RecursionError):
        kind, value = "raw", str(raw)
    text = "" if not content else str(content)
    return {
        "role": m.get("role"), "content": text, "blank": not text.strip(), "tool_call_id": m.get("tool_call_id"), "calls": calls,
        "payload_kind": kind, "payload": {"type": "result", **content_fields(value)}, "payload_json": json.dumps(value), "payload_utf8": json.dumps(value, ensure_ascii=False),
    }


@arrow_udf(f"struct<messages:array<{INGESTED}>,error:string>")
def ingest_messages(text: str | None):
    """JSON text of a list of chat messages -> typed messages, tool arguments and results decoded; what can't be read gives an error."""
    try:
        items = loads(text) if text else None
        if not isinstance(items, list):
            return {"messages": None, "error": "messages: not a list"}
        return {"messages": [_message(m) for m in items if isinstance(m, dict) and "role" in m], "error": None}
    except UNREADABLE as e:
        return {"messages": None, "error": f"{type(e).__name__}: {e}"}


@arrow_udf(f"array<{FRAME}>")
def fill_contents(pairs):
    """[(type, JSON text of the content)] -> frames."""
    return None if pairs is None else [{"type": p["type"], **content_fields(loads(p["json"]))} for p in pairs]


@arrow_udf("string")
def dumps(text: str | None):
    """JSON text as json.dumps writes it: ASCII-escaped; null where it is no JSON."""
    try:
        return None if text is None else json.dumps(loads(text))
    except (ValueError, RecursionError):
        return None


@arrow_udf("string")
def dumps_utf8(text: str | None):
    """JSON text as json.dumps writes it, not ASCII-escaped; null where it is no JSON."""
    try:
        return None if text is None else json.dumps(loads(text), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@arrow_udf("string")
def dumps_sorted(text: str | None):
    """JSON text with sorted keys; null where it is no JSON."""
    try:
        return None if text is None else json.dumps(loads(text), sort_keys=True)
    except (ValueError, RecursionError):
        return None


@arrow_udf("boolean")
def is_json(text: str | None):
    try:
        json.loads(text)
        return True
    except (ValueError, TypeError, RecursionError):
        return False
