"""Frames, tasks and tokens read from the driver's tables: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions.schema import lookup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, i, type, terminal): a conversation's turns as frames. The first user's turn is the mission, later ones feedback; an assistant's is an answer."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", "role")
    w = Window.partitionBy("id").orderBy("turn")
    users = F.sum((F.col("role") == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kind = F.when(F.col("role") == "system", "goal").when(F.col("role") == "assistant", "action").when(users == 1, "mission").otherwise("feedback")
    return turns.select("id", (F.row_number().over(w) - 1).alias("i"), kind.alias("type"), (F.col("role") == "assistant").alias("terminal"))


EVENT_FRAMES = {"signup": "goal", "view": "belief", "click": "action", "purchase": "result"}


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, i, type, terminal, event_id): a user's events as frames. Each fourth click is terminal; errors are ends or feedback by turns."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("id"), "event_type")
    error = F.when(F.col("event_id") % 2 == 0, "end").otherwise("feedback")
    kind = F.coalesce(lookup(EVENT_FRAMES, F.col("event_type")), error)
    w = Window.partitionBy("id").orderBy("ts", "event_id")
    return events.select("id", (F.row_number().over(w) - 1).alias("i"), kind.alias("type"), ((F.col("event_type") == "click") & (F.col("event_id") % 4 == 0)).alias("terminal"), "event_id")


#: The same frames in SQL, as a table t(id, i, t, event_id) in which terminal actions are taction.
EVENT_FRAMES_SQL = """t AS (
  SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_id,
    CASE event_type WHEN 'signup' THEN 'goal' WHEN 'view' THEN 'belief' WHEN 'purchase' THEN 'result'
      WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'taction' ELSE 'action' END
      ELSE CASE WHEN event_id % 2 = 0 THEN 'end' ELSE 'feedback' END END AS t
  FROM events)"""

CONVERSATION_FRAMES_SQL = """u AS (
  SELECT conv_id AS id, row_number() OVER w - 1 AS i, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS users
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (
  SELECT id, i, CASE WHEN role = 'system' THEN 'goal' WHEN role = 'assistant' THEN 'taction' WHEN users = 1 THEN 'mission' ELSE 'feedback' END AS t FROM u)"""

#: Violations v(id, rule, frame_index) of the table t above.
VIOLATIONS_SQL = """
a AS (SELECT *, sum(CASE t WHEN 'action' THEN 1 WHEN 'result' THEN -1 ELSE 0 END) OVER w AS s, lag(t) OVER w AS prev, lead(t) OVER w AS nxt,
    last_value(CASE WHEN t IN ('action', 'taction', 'belief', 'plan', 'think') THEN 1 WHEN t IN ('end', 'result', 'feedback', 'reward') THEN 0 END IGNORE NULLS) OVER b AS turn,
    last_value(CASE WHEN t <> 'end' THEN t END IGNORE NULLS) OVER b AS prev_non_end,
    max(CASE WHEN t IN ('action', 'taction') THEN 1 ELSE 0 END) OVER b AS acted,
    max(CASE WHEN t IN ('action', 'taction', 'belief', 'plan', 'think') THEN 1 ELSE 0 END) OVER w AS closed
  FROM t WINDOW w AS (PARTITION BY id ORDER BY i), b AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY id ORDER BY i)) AS p FROM a),
q AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY id ORDER BY i), 0) AS pp FROM p),
r AS (SELECT *, CASE WHEN p > 0 THEN last_value(CASE WHEN t = 'action' AND pp = 0 THEN i END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i) END AS fp FROM q),
z AS (SELECT *, coalesce(nullif(fp, 0), i) AS at_, coalesce(nullif(lag(fp) OVER (PARTITION BY id ORDER BY i), 0), i) AS before_ FROM r),
v AS (
  SELECT id, 'missing_goal' AS rule, i AS frame_index FROM z WHERE i = 0 AND t <> 'goal'
  UNION ALL SELECT id, 'opening_prelude', i FROM z WHERE closed = 0 AND t NOT IN ('goal', 'mission', 'obs')
  UNION ALL SELECT id, 'misplaced_end', i FROM z WHERE t = 'end' AND (i = 0 OR prev NOT IN ('action', 'taction', 'belief', 'plan', 'think'))
  UNION ALL SELECT id, 'orphan_action', before_ FROM z WHERE t IN ('action', 'taction') AND pp > 0 AND coalesce(turn, 0) = 0
  UNION ALL SELECT id, 'unresolved_action', at_ FROM z WHERE t IN ('belief', 'plan', 'think') AND p > 0
  UNION ALL SELECT id, 'orphan_result', i FROM z WHERE t = 'result' AND pp = 0 AND coalesce(prev_non_end, '') <> 'taction'
  UNION ALL SELECT id, 'premature_runtime_frame', i FROM z WHERE t IN ('feedback', 'reward') AND coalesce(acted, 0) = 0
  UNION ALL SELECT id, 'unresolved_action', at_ FROM z WHERE nxt IS NULL AND p > 0)"""


def event_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, frames): the same frames, an array for each user."""
    from frameloom.functions.schema import FRAME

    rows = event_frames(spark, sf_dir)
    none = F.lit(None).cast("string")
    tool = F.when(F.col("type") == "action", F.when(F.col("terminal"), "answer").otherwise("bash"))
    number = F.col("event_id").cast("string")
    body = F.when(F.col("type") == "action", F.concat(F.lit('{"tool": "'), tool, F.lit('", "text": "e'), number, F.lit('"}'))).when(F.col("type") == "result", F.concat(F.lit('{"value": '), number, F.lit("}"))).otherwise(F.concat(F.lit('"e'), number, F.lit('"')))
    obj = F.col("type").isin("action", "result")
    frame = F.struct(
        F.col("type").alias("type"), F.when(obj, "object").otherwise("string").alias("kind"), F.when(obj, body).otherwise(F.concat(F.lit("e"), number)).alias("text"), body.alias("json"), body.alias("json_utf8"),
        F.lit(True).alias("truthy"), tool.alias("tool"), F.when(F.col("type") == "action", F.concat(F.lit('{"text": "e'), number, F.lit('"}'))).when(obj, body).alias("args"), F.when(F.col("type") == "action", F.concat(F.lit("e"), number)).alias("answer"),
        none.alias("raw"), none.alias("error"),
    ).cast(FRAME)
    ordered = F.array_sort(F.collect_list(F.struct("i", frame.alias("f"))))
    return rows.groupBy("id").agg(F.transform(ordered, lambda x: x["f"]).alias("frames"))


def event_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as task results: purchases succeed, errors fail, the rest is not scored."""
    e = table(spark, sf_dir, "events")
    success = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)
    return e.select(
        F.col("event_id").alias("task_id"), F.col("user_id").cast("string").alias("run_id"), (F.col("user_id") % 5).alias("domain"), success.alias("success"), (F.col("event_id") % 97).alias("prompt_tokens"), (F.col("event_id") % 31).alias("generated_tokens"),
        F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id") % 89).alias("recorded"), (F.floor(F.col("value") * 100) / 64).alias("total_sec"), (F.floor(F.col("value") * 100) / 128).alias("inference_sec"), (F.col("event_id") % 7 / 8).alias("tool_sec"),
        (F.col("value") > 10).alias("parsed_ok"), ((F.col("value") > 10) & (F.col("event_type") != "error")).alias("valid"),
    )
