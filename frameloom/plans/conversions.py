"""Queries that compare what conversions and replays write, not only how much: arguments, results, ids, answers and rendered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import pyjson, tools
from frameloom.operators import bridge, replay, wire
from frameloom.plans.frames_from_tables import EVENT_FRAMES_SQL, event_arrays, event_frames, table
from frameloom.plans.registry import query


def _digest(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("-")), 256)


#: Messages of the event frames in their order: m(id, k, t, event_id, said), said being the beliefs since the action before.
_MESSAGES_SQL = f"""{EVENT_FRAMES_SQL},
b AS (SELECT *, coalesce(sum((t IN ('action', 'taction'))::INT) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM t),
s AS (SELECT id, part, string_agg('e' || event_id, chr(10) ORDER BY i) AS said FROM b WHERE t = 'belief' GROUP BY ALL),
m AS (SELECT b.id, row_number() OVER (PARTITION BY b.id ORDER BY i) - 1 AS k, t, event_id, coalesce(said, '') AS said, lead(t) OVER (PARTITION BY b.id ORDER BY i) AS next, lead(event_id) OVER (PARTITION BY b.id ORDER BY i) AS next_id
  FROM b LEFT JOIN s ON b.id = s.id AND b.part = s.part WHERE t IN ('action', 'taction', 'result', 'feedback'))"""
_FINAL = "CASE WHEN said <> '' THEN said || chr(10) || chr(10) ELSE '' END || 'e' || event_id"


@query(
    f"""WITH {_MESSAGES_SQL}, g AS (SELECT id, string_agg('e' || event_id, chr(10) || chr(10) ORDER BY i) AS said FROM t WHERE t = 'goal' GROUP BY id),
o AS (
  SELECT m.id, k + (g.id IS NOT NULL)::INT AS i, CASE t WHEN 'result' THEN 'tool' WHEN 'feedback' THEN 'user' ELSE 'assistant' END AS role,
    CASE t WHEN 'action' THEN m.said WHEN 'taction' THEN {_FINAL.replace("said", "m.said")} WHEN 'result' THEN '{{"value": ' || event_id || '}}' ELSE 'e' || event_id END AS content,
    CASE WHEN t = 'result' THEN 'call_' || (k - 1) END AS answers, CASE WHEN t = 'action' THEN 'call_' || k || ' bash {{"text": "e' || event_id || '"}}' END AS call
  FROM m LEFT JOIN g ON m.id = g.id
  UNION ALL SELECT id, 0, 'system', said, NULL, NULL FROM g)
SELECT id, i::BIGINT AS i, role, sha256(content) AS content, coalesce(answers, '-') AS answers, sha256(coalesce(call, '-')) AS call FROM o"""
)
def message_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = event_arrays(spark, sf_dir).select("id", F.posexplode(bridge.frames_to_messages(F.col("frames"))).alias("i", "m"))
    call = F.get("m.tool_calls", F.lit(0))
    shown = F.when(call.isNotNull(), F.concat_ws(" ", call["id"], call["function"]["name"], call["function"]["arguments"]))
    return said.select("id", F.col("i").cast("long").alias("i"), F.col("m.role").alias("role"), _digest(F.col("m.content")).alias("content"), F.coalesce("m.tool_call_id", F.lit("-")).alias("answers"), _digest(shown).alias("call"))


@query(
    f"""WITH {_MESSAGES_SQL}
SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS i, CASE t WHEN 'action' THEN 'tool' ELSE 'assistant' END AS role, CASE t WHEN 'action' THEN 'bash' ELSE '-' END AS name,
  sha256(CASE t WHEN 'action' THEN '{{"text": "e' || event_id || '"}}' ELSE '-' END) AS arguments, CASE WHEN t <> 'action' THEN '-' WHEN next = 'result' THEN '{{"value": ' || next_id || '}}' ELSE '' END AS response,
  sha256(CASE t WHEN 'action' THEN '-' ELSE {_FINAL} END) AS text FROM m WHERE t IN ('action', 'taction')"""
)
def call_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = event_arrays(spark, sf_dir).select("id", F.posexplode(replay.first_calls(bridge.frames_to_messages(F.col("frames")))).alias("i", "c"))
    shown = [F.coalesce("c.name", F.lit("-")).alias("name"), _digest(F.col("c.arguments")).alias("arguments"), F.coalesce("c.response", F.lit("-")).alias("response"), _digest(F.col("c.text")).alias("text")]
    return chain.select("id", F.col("i").cast("long").alias("i"), "c.role", *shown)


@query(
    f"""WITH {EVENT_FRAMES_SQL}
SELECT id, i::BIGINT AS i, CASE t WHEN 'taction' THEN 'action' ELSE t END AS type, sha256(CASE t WHEN 'action' THEN '{{"tool": "bash", "text": "e' || event_id || '"}}' WHEN 'taction' THEN '{{"tool": "answer", "text": "e' || event_id || '"}}'
  WHEN 'result' THEN '{{"value": ' || event_id || '}}' WHEN 'end' THEN 'null' ELSE '"e' || event_id || '"' END) AS content FROM t"""
)
def wire_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    wired = event_arrays(spark, sf_dir).select("id", wire.render(F.col("frames")).alias("w"))
    back = wire.parse(wired, "w").where("parse_error is null").select("id", F.posexplode("frames").alias("i", "f")).where("f.error is null")
    return back.select("id", F.col("i").cast("long").alias("i"), "f.type", _digest(F.col("f.json")).alias("content"))


def _called_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, m): users' events as ingested chat messages. Clicks call one tool or two, each third with arguments that are no text; purchases are results in three spellings."""
    e, n = F.col("event_id"), F.col("event_id").cast("string")
    j = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    said = F.when(e % 2 == 0, n).otherwise(" ")
    one = j('{"id": "x", "type": "function", "function": {"name": "bash", "arguments": "{\\"x\\": ', n, '}"}}')
    two = j(', {"function": {"name": "look", "arguments": {"y": ', n, ', "s": "\\u00e9"}}}')
    spelt = F.when(e % 3 == 0, j('"{\\"tool\\": \\"own\\", \\"value\\": ', n, '}"')).when(e % 3 == 1, j('"{\\"v\\": ', n, '}"')).otherwise(j('"plain ', n, '"'))
    turn = (
        F.when(F.col("event_type") == "signup", j('{"role": "system", "content": "e', n, '"}')).when(F.col("event_type") == "view", j('{"role": "user", "content": "e', n, '"}'))
        .when(F.col("event_type") == "click", j('{"role": "assistant", "content": "', said, '", "tool_calls": [', one, F.when(e % 3 == 0, two).otherwise(""), "]}"))
        .when(F.col("event_type") == "purchase", j('{"role": "tool", "tool_call_id": "x", "content": ', spelt, "}")).otherwise(j('{"role": "assistant", "content": "', said, '"}'))
    )
    rows = event_frames(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").select("id", F.struct("i", turn.alias("j")).alias("t"))
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("id", F.concat(F.lit("["), F.array_join(F.transform("t", lambda t: t["j"]), ", "), F.lit("]")).alias("j"))
    return listed.select("id", pyjson.ingest_messages(F.col("j"))["messages"].alias("m"))


#: The frames of these chats: f(id, i, part, type, json), the parts of a message in their order.
_CALLED_SQL = """e AS (
  SELECT user_id AS id, event_id AS n, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id % 2 = 0 AS says, event_id % 3 AS k FROM events),
w AS (
  SELECT *, sum((t IN ('click', 'error'))::INT) OVER o AS head, sum((t = 'view')::INT) OVER o AS users FROM e WINDOW o AS (PARTITION BY id ORDER BY i)),
h AS (SELECT id, head, CASE WHEN t = 'click' AND k = 0 THEN ['bash', 'look'] WHEN t = 'click' THEN ['bash'] WHEN says THEN ['answer'] ELSE [] END AS names FROM w WHERE t IN ('click', 'error')),
r AS (
  SELECT w.*, coalesce(h.names[row_number() OVER (PARTITION BY w.id, w.head ORDER BY i)], 'unknown') AS tool FROM w LEFT JOIN h ON w.id = h.id AND w.head = h.head WHERE t = 'purchase'),
f AS (
  SELECT id, i, 0 AS part, 'goal' AS type, '"e' || n || '"' AS json FROM w WHERE t = 'signup'
  UNION ALL SELECT id, i, 0, CASE users WHEN 1 THEN 'mission' ELSE 'feedback' END, '"e' || n || '"' FROM w WHERE t = 'view'
  UNION ALL SELECT id, i, 0, 'think', '"' || n || '"' FROM w WHERE t = 'click' AND says
  UNION ALL SELECT id, i, 1, 'action', '{"tool": "bash", "x": ' || n || '}' FROM w WHERE t = 'click'
  UNION ALL SELECT id, i, 2, 'action', '{"tool": "look", "y": ' || n || ', "s": "\\u00e9"}' FROM w WHERE t = 'click' AND k = 0
  UNION ALL SELECT id, i, 0, 'action', '{"tool": "answer", "text": "' || n || '"}' FROM w WHERE t = 'error' AND says
  UNION ALL SELECT id, i, 0, 'result', CASE k WHEN 0 THEN '{"tool": "own", "value": ' || n || '}' WHEN 1 THEN '{"tool": "' || tool || '", "value": {"v": ' || n || '}}' ELSE '{"tool": "' || tool || '", "value": "plain ' || n || '"}' END FROM r)"""


@query(f"WITH {_CALLED_SQL} SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, part) - 1 AS i, type, sha256(json) AS json FROM f")
def called_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _called_chats(spark, sf_dir).select("id", F.posexplode(bridge.messages_to_frames(F.col("m"))["frames"]).alias("i", "f"))
    return frames.select("id", F.col("i").cast("long").alias("i"), "f.type", _digest(F.col("f.json")).alias("json"))


@query(
    """SELECT p_partkey, name, args, named, coalesce(error, '-') AS error FROM (
SELECT p_partkey, 'look' AS name, '{"x": ' || p_size || '}' AS args, true AS named, NULL AS error FROM part WHERE p_partkey % 6 IN (0, 1)
UNION ALL SELECT p_partkey, p_brand, '{}', true, NULL FROM part WHERE p_partkey % 6 = 2
UNION ALL SELECT p_partkey, '7', NULL, true, NULL FROM part WHERE p_partkey % 6 = 3
UNION ALL SELECT p_partkey, NULL, '{"a": [' || p_size || ', null]}', false, NULL FROM part WHERE p_partkey % 6 = 4
UNION ALL SELECT p_partkey, NULL, NULL, false, CASE WHEN p_size % 2 = 0 THEN 'not object' ELSE 'nested too deep' END FROM part WHERE p_partkey % 6 = 5)"""
)
def call_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    body = (
        F.when(k == 0, F.concat(F.lit('{"name": "look", "arguments": {"x": '), size, F.lit("}}"))).when(k == 1, F.concat(F.lit('{"tool": "look", "parameters": "{\\"x\\": '), size, F.lit('}"}')))
        .when(k == 2, F.concat(F.lit('{"name": "", "tool": "'), "p_brand", F.lit('"}'))).when(k == 3, F.lit('{"name": 7, "arguments": "{x"}')).when(k == 4, F.concat(F.lit('{"arguments": {"a": ['), size, F.lit(", null]}}")))
        .when(F.col("p_size") % 2 == 0, F.lit("[1]")).otherwise(F.repeat(F.lit("["), 100_000))
    )
    read = table(spark, sf_dir, "part").select("p_partkey", bridge.read_call(body).alias("c"))
    return read.select("p_partkey", "c.name", "c.args", "c.named", F.coalesce("c.error", F.lit("-")).alias("error"))


@query(
    """SELECT p_partkey, sha256('tools:' || chr(10) || 'namespace tools {' || chr(10) || CASE WHEN p_size % 2 = 0 THEN ' // ' || p_name || chr(10) ELSE '' END || CASE p_partkey % 4
  WHEN 0 THEN ' type t' || p_partkey || ' = () => any;' ELSE ' type t' || p_partkey || ' = (_: {' || chr(10) || CASE p_partkey % 4 WHEN 1 THEN '   // how' || chr(10) ELSE '' END
  || '   x: ' || CASE p_partkey % 4 WHEN 1 THEN '''a'' | ''b''' WHEN 2 THEN 'number[][]' ELSE 'any' END || ',' || chr(10) || '   y?: ' || CASE p_size % 3 WHEN 0 THEN 'boolean' WHEN 1 THEN 'object' ELSE 'string' END || ',' || chr(10) || '  }) => any;' END || chr(10) || '}') AS rendered FROM part"""
)
def rendered_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    x = F.when(k == 1, F.lit('{"type": "string", "enum": ["a", "b"], "description": "how"}')).when(k == 2, F.lit('{"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}')).otherwise(F.lit('{"type": ["string", "null"]}'))
    y = F.concat(F.lit('{"type": "'), F.when(F.col("p_size") % 3 == 0, "boolean").when(F.col("p_size") % 3 == 1, "object").otherwise("string"), F.lit('"}'))
    fields = F.when(k == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"properties": {"x": '), x, F.lit(', "y": '), y, F.lit('}, "required": ["x"]}')))
    said = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"description": "'), "p_name", F.lit('", '))).otherwise("")
    listed = F.concat(F.lit('[{"name": "t'), key, F.lit('", '), said, F.lit('"parameters": '), fields, F.lit("}]"))
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(tools.render_tools(listed), 256).alias("rendered"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'f {"a": ' || p_size || '}' WHEN 1 THEN 'f {"a": 1}, g {}' WHEN 4 THEN NULL ELSE '' END AS calls, CASE p_partkey % 5 WHEN 4 THEN 'nested too deep' ELSE '-' END AS error FROM part"""
)
def decoded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit('[{"name": "f", "parameters": {"a": '), size, F.lit("}}]<|eot_id|>"))).when(k == 1, F.lit('{"tool": "f", "arguments": "{\\"a\\": 1}"}; {"name": "g"}')).when(k == 2, F.lit("[]")).when(k == 3, F.lit('{"a": 1}')).otherwise(F.repeat(F.lit("["), 100_000))
    out = table(spark, sf_dir, "part").select("p_partkey", tools.decode_result(text).alias("r"))
    shown = F.array_join(F.transform("r.calls", lambda c: F.concat_ws(" ", c["name"], c["args"])), ", ")
    return out.select("p_partkey", shown.alias("calls"), F.coalesce("r.error", F.lit("-")).alias("error"))


#: Steps of the replays below: z(id, n, step, what), what being how a step ends its run, null if it calls a tool.
_STEPS_SQL = """z AS (
  SELECT user_id AS id, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
    CASE WHEN event_id % 23 = 0 THEN 'say' WHEN event_id % 23 = 1 THEN 'answer' WHEN event_id % 23 = 2 THEN 'fail' WHEN event_id % 23 = 3 THEN 'bad' WHEN event_id % 23 = 4 THEN 'empty' WHEN event_id % 23 = 5 THEN 'mute' WHEN event_id % 23 = 6 THEN 'long' END AS what FROM events),
"""


def _steps(spark: SparkSession, sf_dir: str, texts: dict[int, Column], other: Column) -> DataFrame:
    """The recorded steps: texts by the event's number modulo 23, each of 512 ids where that is 6, else of one."""
    raw = other
    for k, text in texts.items():
        raw = F.when(F.col("event_id") % 23 == k, text).otherwise(raw)
    long = F.when(F.col("event_id") % 23 == 6, 512).otherwise(1)
    return event_frames(spark, sf_dir).select(F.col("id").alias("run_id"), F.col("i").alias("step"), raw.alias("raw_text"), long.alias("n_gen"), F.lit(2).alias("n_given"))


def _run(steps: DataFrame, kind: str) -> DataFrame:
    from frameloom.operators.registry import Tool, ToolRegistry

    out = replay.replay(steps, ToolRegistry([Tool("double", lambda x: 2 * x)]), kind, max_iterations=8)
    return out.select("run_id", "stopped_on", F.col("iterations").cast("long").alias("iterations"), "answer", F.sha2("frames", 256).alias("appended"))


@query(
    f"""WITH {_STEPS_SQL} ends AS (SELECT id, min(step) FILTER (what IS NOT NULL AND what <> 'long') AS stop, count(*) AS n FROM z GROUP BY id),
said AS (
  SELECT z.id, z.step, what, z.n, CASE WHEN what IS NULL OR what = 'long' THEN '{{"role": "assistant", "content": "", "tool_calls": [{{"id": "call_' || (2 * z.step + 2) || '", "type": "function", "function": {{"name": "double", "arguments": "{{\\"x\\": ' || z.n || '}}"}}}}]}}, {{"role": "tool", "tool_call_id": "call_' || (2 * z.step + 2) || '", "content": "{{\\"tool\\": \\"double\\", \\"value\\": ' || 2 * z.n || '}}"}}'
    WHEN what = 'say' THEN '{{"role": "assistant", "content": "e' || z.n || '"}}'
    WHEN what IN ('answer', 'mute', 'fail') THEN '{{"role": "assistant", "content": "", "tool_calls": [{{"id": "call_' || (2 * z.step + 2) || '", "type": "function", "function": {{"name": "' || CASE what WHEN 'fail' THEN 'fail' ELSE 'answer' END || '", "arguments": "{{' || CASE what WHEN 'answer' THEN '\\"text\\": \\"e' || z.n || '\\"' ELSE '\\"reason\\": \\"r\\"' END || '}}"}}}}]}}' END AS j
  FROM z JOIN ends ON z.id = ends.id WHERE z.step < 8 AND (stop IS NULL OR z.step <= stop)),
joined AS (SELECT id, '[' || coalesce(string_agg(j, ', ' ORDER BY step), '') || ']' AS j, arg_max(what, step) AS what, arg_max(n, step) AS n FROM said GROUP BY id)
SELECT e.id AS run_id, CASE WHEN stop IS NULL OR stop >= 8 THEN 'max_iterations' WHEN what = 'bad' THEN 'parse_error: Expecting property name enclosed in double quotes' WHEN what = 'empty' THEN 'parse_error: empty' ELSE 'terminal_action' END AS stopped_on,
  least(coalesce(stop + 1, e.n), 8)::BIGINT AS iterations, CASE WHEN stop >= 8 OR stop IS NULL THEN NULL WHEN what IN ('say', 'answer') THEN 'e' || j.n WHEN what = 'mute' THEN '' END AS answer, sha256(j) AS appended
FROM ends e JOIN joined j ON e.id = j.id"""
)
def replayed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat runs whose calls are numbered after two messages: answers as text and as calls, an answer without a text, failures, text that is no call, and long generations, which end no chat."""
    n = F.col("event_id").cast("string")
    call = lambda name, args: F.concat(F.lit(f'<|python_tag|>{{"name": "{name}", "parameters": {{'), args, F.lit("}}<|eom_id|>"))
    texts = {
        0: F.concat(F.lit("e"), n, F.lit("<|eot_id|>")), 1: call("answer", F.concat(F.lit('"text": "e'), n, F.lit('"'))), 2: call("fail", F.lit('"reason": "r"')), 3: F.lit("<|python_tag|>{x<|eot_id|>"), 4: F.lit(" <|eot_id|>"), 5: call("answer", F.lit('"reason": "r"')),
    }
    return _run(_steps(spark, sf_dir, texts, call("double", F.concat(F.lit('"x": '), n))), "chat")


@query(
    f"""WITH {_STEPS_SQL} ends AS (SELECT id, min(step) FILTER (what IS NOT NULL) AS stop, count(*) AS n FROM z GROUP BY id),
said AS (
  SELECT z.id, z.step, what, z.n, CASE WHEN what IS NULL OR what = 'long' THEN '{{"type": "action", "content": {{"tool": "double", "x": ' || z.n || '}}}}, {{"type": "result", "content": {{"tool": "double", "value": ' || 2 * z.n || '}}}}'
    WHEN what = 'say' THEN '{{"type": "belief", "content": "e' || z.n || '"}}' WHEN what = 'answer' THEN '{{"type": "action", "content": {{"tool": "answer", "text": "e' || z.n || '"}}}}, {{"type": "result", "content": {{"tool": "answer", "value": null}}}}'
    WHEN what = 'fail' THEN '{{"type": "action", "content": {{"tool": "fail", "reason": "r"}}}}, {{"type": "result", "content": {{"tool": "fail", "value": null}}}}' WHEN what = 'mute' THEN '{{"type": "action", "content": {{"tool": "answer"}}}}, {{"type": "result", "content": {{"tool": "answer", "value": null}}}}' END AS j
  FROM z JOIN ends ON z.id = ends.id WHERE z.step < 8 AND (stop IS NULL OR z.step <= stop)),
joined AS (SELECT id, '[' || coalesce(string_agg(j, ', ' ORDER BY step), '') || ']' AS j, arg_max(what, step) AS what, arg_max(n, step) AS n FROM said GROUP BY id)
SELECT e.id AS run_id, CASE WHEN stop IS NULL OR stop >= 8 THEN 'max_iterations' WHEN what = 'say' THEN 'no_action' WHEN what = 'bad' THEN 'parse_error: expected frame marker at offset 0, got: ''garbage''' WHEN what = 'empty' THEN 'parse_error: runtime-owned marker ''<|result|>'' found in model output'
    WHEN what = 'long' THEN 'max_tokens' ELSE 'terminal_action' END AS stopped_on, least(coalesce(stop + 1, e.n), 8)::BIGINT AS iterations, CASE WHEN what = 'answer' THEN 'e' || j.n END AS answer, sha256(j) AS appended
FROM ends e JOIN joined j ON e.id = j.id"""
)
def replayed_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame runs that end in each of the ways that a run can end."""
    n = F.col("event_id").cast("string")
    call = lambda name, more: F.concat(F.lit(f'<|action|>{{"tool": "{name}"'), more, F.lit("}"))
    texts = {
        0: F.concat(F.lit("<|belief|>e"), n), 1: call("answer", F.concat(F.lit(', "text": "e'), n, F.lit('"'))), 2: call("fail", F.lit(', "reason": "r"')), 3: F.lit("garbage"), 4: F.lit("<|result|>{}"), 5: call("answer", F.lit("")),
    }
    return _run(_steps(spark, sf_dir, texts, call("double", F.concat(F.lit(', "x": '), n))), "frames")
