"""All queries of this package and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import text
from frameloom.operators import bridge, dataset, labels, lookups, replay, results, validate, vectors, wire
from frameloom.plans.frames_from_tables import CONVERSATION_FRAMES_SQL, EVENT_FRAMES_SQL, VIOLATIONS_SQL, conversation_frames, event_arrays, event_frames, event_tasks, table

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "q_conv_violations"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[f"q_{fn.__name__}"] = fn
        if sql is not None:
            ORACLE_SQL[f"q_{fn.__name__}"] = sql
        return fn

    return add


_BY_RULE = "SELECT rule, count(DISTINCT id) AS n_trajectories, count(*) AS n_violations FROM v GROUP BY rule"


def _by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count_distinct("id").alias("n_trajectories"), F.count("*").alias("n_violations"))


@query(f"WITH {CONVERSATION_FRAMES_SQL}, {VIOLATIONS_SQL} {_BY_RULE}")
def conv_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_rule(validate.violations_of_rows(conversation_frames(spark, sf_dir)))


@query(f"WITH {EVENT_FRAMES_SQL}, {VIOLATIONS_SQL} SELECT id, rule, frame_index::INTEGER AS frame_index FROM v")
def event_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.violations_of_rows(event_frames(spark, sf_dir))


@query(f"WITH {EVENT_FRAMES_SQL}, {VIOLATIONS_SQL} {_BY_RULE}")
def event_violations_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_arrays(spark, sf_dir).select("id", F.explode(validate.violations(F.col("frames"))).alias("v"))
    return _by_rule(found.select("id", "v.rule"))


@query(f"WITH {EVENT_FRAMES_SQL}, {VIOLATIONS_SQL}, n AS (SELECT id, count(*) AS n FROM v GROUP BY id) SELECT id, n AS n_violations FROM n")
def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = event_arrays(spark, sf_dir).select("id", F.size(validate.violations(F.col("frames"))).cast("long").alias("n_violations"))
    return counted.where("n_violations > 0")


@query(
    f"WITH {EVENT_FRAMES_SQL}, {VIOLATIONS_SQL}, m AS (SELECT 'validation: [' || rule || '] frame ' || frame_index AS mode, count(*) AS n, min(id * 1000000 + frame_index) AS first FROM v GROUP BY ALL)"
    " SELECT mode, n FROM m ORDER BY n DESC, mode LIMIT 10"
)
def failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform(validate.violations(F.col("frames")), validate.shown)
    tasks = event_arrays(spark, sf_dir).select(F.col("id").alias("task_id"), F.lit(None).cast("string").alias("parse_error"), shown.alias("errors"))
    everything = results.failure_modes(tasks, limit=1_000_000)
    return everything.orderBy(F.desc("n"), "mode").limit(10)


_NORMAL = r"trim(regexp_replace(lower(text), '[\s\x1c-\x1f]+', ' ', 'g'))"


@query(f"SELECT doc_id, sha1({_NORMAL}) AS key FROM (SELECT *, row_number() OVER (PARTITION BY {_NORMAL} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def doc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dataset.deduplicate(docs, F.col("text"), "doc_id").select("doc_id", text.dedup_key(F.col("text")).alias("key"))


_WANT = "CASE WHEN count(*) OVER (PARTITION BY source) >= 10 THEN greatest(1, round_even(count(*) OVER (PARTITION BY source) * 0.05::DOUBLE, 0)) ELSE 0 END"


@query(
    f"SELECT doc_id, CASE WHEN rn <= want THEN 'eval' ELSE 'train' END AS split FROM (SELECT doc_id, {_WANT} AS want,"
    " row_number() OVER (PARTITION BY source ORDER BY substr(sha1(doc_id || '|42'), 1, 13), doc_id::VARCHAR) AS rn FROM documents)"
)
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return dataset.split(docs, domain="source", key="doc_id").select("doc_id", "split")


@query(f"SELECT source, count(*) AS n, count(*) FILTER (rn <= want) AS n_eval FROM (SELECT source, {_WANT} AS want, row_number() OVER (PARTITION BY source) AS rn FROM documents) GROUP BY source")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return dataset.split(docs, domain="source", key="doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "eval").alias("n_eval"))


@query("SELECT doc_id FROM documents ORDER BY sha1(doc_id || '|7'), doc_id::VARCHAR LIMIT 50")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.sample(table(spark, sf_dir, "documents").select("doc_id"), 50, 7, "doc_id")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.histogram(table(spark, sf_dir, "documents"), "lang")


@query(
    f"WITH {EVENT_FRAMES_SQL}, {VIOLATIONS_SQL}, bad AS (SELECT DISTINCT id FROM v), c AS (SELECT DISTINCT t.id FROM t)"
    " SELECT CASE WHEN bad.id IS NULL THEN 'kept' ELSE 'rejected' END AS verdict, count(*) AS n FROM c LEFT JOIN bad ON c.id = bad.id GROUP BY 1"
)
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = dataset.checked(event_arrays(spark, sf_dir).withColumn("error", F.lit(None).cast("string")))
    return marked.groupBy(F.when(F.col("reason").isNull(), "kept").otherwise("rejected").alias("verdict")).agg(F.count("*").alias("n"))


_TASKS_SQL = """k AS (SELECT event_id AS task_id, user_id::VARCHAR AS run_id, user_id % 5 AS domain, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS success,
  event_id % 97 AS prompt_tokens, event_id % 31 AS generated_tokens, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 89 END AS recorded, floor(value * 100) / 64 AS total_sec,
  floor(value * 100) / 128 AS inference_sec, event_id % 7 / 8 AS tool_sec, value > 10 AS parsed_ok, value > 10 AND event_type <> 'error' AS valid FROM events),
f AS (SELECT *, CASE WHEN recorded = 0 THEN prompt_tokens + generated_tokens ELSE recorded END AS total_tokens FROM k)"""


@query(
    f"""WITH {_TASKS_SQL} SELECT count(*) AS n, round(avg(total_tokens), 6) AS avg_total_tokens, round(avg(generated_tokens), 6) AS avg_generated_tokens, round(avg(total_sec), 6) AS avg_wall_sec,
  round(avg(inference_sec), 6) AS avg_inference_sec, round(avg(total_tokens) FILTER (success), 6) AS tokens_per_success, round(avg(total_sec) FILTER (success), 6) AS sec_per_success,
  count(*) FILTER (success) AS n_success, round(avg(success::INT), 6) AS success_rate FROM f"""
)
def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = event_tasks(spark, sf_dir).withColumn("total_tokens", results.total_tokens(F.col("prompt_tokens"), F.col("generated_tokens"), F.col("recorded")))
    out = results.efficiency(tasks)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(
    f"""WITH {_TASKS_SQL} SELECT domain, grouping(domain) = 1 AS whole, count(*) AS n, count(*) FILTER (parsed_ok) AS parsed, count(*) FILTER (valid) AS valid,
  round(count(*) FILTER (parsed_ok) / count(*), 6) AS parse_rate, round(count(*) FILTER (valid) / count(*), 6) AS valid_rate FROM f GROUP BY GROUPING SETS ((), (domain))"""
)
def format_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = results.format_rates(event_tasks(spark, sf_dir))
    return out.withColumn("parse_rate", F.round("parse_rate", 6)).withColumn("valid_rate", F.round("valid_rate", 6))


@query(f"WITH {_TASKS_SQL} SELECT run_id, count(*) AS steps, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(generated_tokens)::BIGINT AS generated_tokens, round(sum(inference_sec), 5) AS inference_sec, round(sum(tool_sec), 5) AS tool_sec FROM f GROUP BY run_id")
def accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = results.accumulate(event_tasks(spark, sf_dir))
    return out.withColumn("inference_sec", F.round("inference_sec", 5)).withColumn("tool_sec", F.round("tool_sec", 5))


@query(f"WITH {_TASKS_SQL} SELECT task_id, round(CASE WHEN recorded <= 0 THEN 1000.0 / count(*) OVER () ELSE recorded END, 6)::DOUBLE AS load_sec FROM f")
def share_load_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = event_tasks(spark, sf_dir).select("task_id", F.col("recorded").cast("double").alias("load_sec"))
    return results.share_load_time(tasks, 1000.0).withColumn("load_sec", F.round("load_sec", 6))


@query("SELECT round(sum(a * n) / sum(n), 6) AS \"primary\" FROM (SELECT c_nationkey, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM customer GROUP BY c_nationkey)")
def weighted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_nation = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg((F.col("c_acctbal") > 0).cast("int")).alias("accuracy"), F.count("*").alias("n"))
    return results.weighted_accuracy(by_nation).select(F.round("primary", 6).alias("primary"))


@query(
    """SELECT s.n_name AS suite, f.o AS format FROM nation s CROSS JOIN (SELECT DISTINCT c_mktsegment AS o FROM customer) f
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.n_nationkey AND c.c_mktsegment = f.o AND c.c_acctbal > 9000)"""
)
def matrix_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    formats = sorted(r[0] for r in customers.select("c_mktsegment").distinct().collect())
    suites = [r[0] for r in nations.orderBy("n_nationkey").select("n_name").collect()]
    there = customers.where("c_acctbal > 9000").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("suite"), F.col("c_mktsegment").alias("format"))
    return lookups.missing_cells(lookups.cells(spark, suites, formats, dict.fromkeys(formats, "m")), there).select("suite", "format")


@query(
    f"WITH {EVENT_FRAMES_SQL} SELECT event_id, CASE WHEN coalesce(last_value(CASE WHEN t IN ('goal', 'result', 'feedback') THEN 0 WHEN t IN ('belief', 'action', 'taction', 'end') THEN 1 END IGNORE NULLS)"
    " OVER (PARTITION BY id ORDER BY i), 0) = 1 THEN t ELSE '-100' END AS label FROM t"
)
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_frames(spark, sf_dir).withColumn("token", F.when(F.col("terminal"), "taction").otherwise(F.col("type")))
    return labels.mask_rows(rows, "id", "i", "token", ["belief", "action", "taction", "end"], ["goal", "result", "feedback"]).select("event_id", "label")


_TOKEN_SQL = "CASE t WHEN 'goal' THEN 128002 WHEN 'belief' THEN 128011 WHEN 'action' THEN 128014 WHEN 'taction' THEN 128014 WHEN 'end' THEN 128015 WHEN 'result' THEN 128016 ELSE 128017 END"


@query(
    f"WITH {EVENT_FRAMES_SQL}, o AS (SELECT id, {_TOKEN_SQL} AS tok, last_value(CASE WHEN t IN ('goal', 'result', 'feedback') THEN 0 ELSE 1 END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i) AS on_ FROM t)"
    " SELECT id, count(*) AS n, count(*) FILTER (on_ = 1) AS supervised, sum(CASE WHEN on_ = 1 THEN tok ELSE -100 END)::BIGINT AS total FROM o GROUP BY id"
)
def label_mask_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.functions.schema import TOKEN, lookup

    ids = event_arrays(spark, sf_dir).select("id", F.transform("frames", lambda f: lookup(TOKEN, f["type"])).alias("ids"))
    masked = ids.withColumn("labels", labels.mask_runtime(F.col("ids")))
    kept = F.size(F.filter("labels", lambda x: x != labels.IGNORED)).cast("long")
    return masked.select("id", F.size("ids").cast("long").alias("n"), kept.alias("supervised"), F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    "WITH s AS (SELECT user_id, event_id, ts, event_id % 8 AS batch FROM events), l AS (SELECT user_id, batch, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT batch, max(n) AS most FROM l GROUP BY batch)"
    " SELECT user_id, l.batch, most AS padded, n AS attended FROM l JOIN m ON l.batch = m.batch"
)
def collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 8).alias("batch")).agg(F.collect_list(F.col("event_id").cast("int")).alias("input_ids"))
    rows = rows.withColumn("labels", F.col("input_ids")).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
    out = labels.collate(rows, "batch")
    return out.select("user_id", "batch", F.size("input_ids").cast("long").alias("padded"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"))


@query(
    """WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS cmd FROM events),
b AS (SELECT *, last_value(nullif(cmd, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
g AS (SELECT *, sum(CASE WHEN cmd <> '' AND cmd IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b),
s AS (SELECT event_id, CASE WHEN cmd = '' THEN 0 ELSE count(*) FILTER (cmd <> '') OVER (PARTITION BY user_id, island ORDER BY ts, event_id) END AS streak FROM g)
SELECT event_id, streak::BIGINT AS streak, streak >= 3 AS repeated FROM s"""
)
def repeat_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("command"))
    return results.repeats(rows, "user_id", "at", "command").select("event_id", F.col("streak").cast("long").alias("streak"), "repeated")


@query(
    """WITH c AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_type AS cmd FROM events),
b AS (SELECT *, lag(cmd) OVER (PARTITION BY user_id ORDER BY step) AS p1, lag(cmd, 2) OVER (PARTITION BY user_id ORDER BY step) AS p2 FROM c WHERE step < 250),
y AS (SELECT user_id, step, CASE WHEN cmd = p1 AND p1 = p2 THEN 'repeated_command' WHEN event_id % 101 = 0 THEN 'submitted' END AS why FROM b),
e AS (SELECT user_id, min(step) FILTER (why IS NOT NULL) AS s, arg_min(why, step) FILTER (why IS NOT NULL) AS w, max(step) AS last FROM y GROUP BY user_id)
SELECT user_id AS run_id, coalesce(w, 'max_iterations') AS stopped_on, coalesce(s, last) + 1 AS iterations FROM e"""
)
def command_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = event_frames(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    steps = frames.select(F.col("id").alias("run_id"), F.col("i").alias("step"), F.col("event_type").alias("command"), F.lit(None).cast("string").alias("problem"), F.lit(1).alias("n_calls"), (F.col("event_id") % 101 == 0).alias("submitted"), F.lit(False).alias("max_tokens"))
    return replay.command_stops(steps).select("run_id", "stopped_on", F.col("iterations").cast("long").alias("iterations"))


@query("SELECT conv_id, count(*) FILTER (turn < first) AS prompt, count(*) AS n FROM (SELECT *, coalesce(min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id), 1e9) AS first FROM conversations) GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0")
def eval_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("messages"))
    good = turns.where(dataset.evaluable_messages(F.col("messages")))
    return good.select("conv_id", F.size(dataset.prompt_messages(F.col("messages"))).cast("long").alias("prompt"), F.size("messages").cast("long").alias("n"))


@query(f"WITH {EVENT_FRAMES_SQL}, c AS (SELECT id, min(i) FILTER (t IN ('belief', 'action', 'taction')) AS first, count(*) AS n FROM t GROUP BY id) SELECT id, coalesce(first, n) AS cut FROM c")
def cut_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_arrays(spark, sf_dir).select("id", validate.cut_index(F.col("frames")).cast("long").alias("cut"))


@query("SELECT doc_id AS id, NOT coalesce(bool_or(quality = 0), false) AS valid FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id")
def entry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("valid"))
    return results.entry_validity(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), scores)


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def wanted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.wanted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("doc_id", "source")


@query(
    """WITH k AS (SELECT n_name AS key FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT p_size::VARCHAR FROM part UNION ALL SELECT 'none')
SELECT key, coalesce((SELECT max(n_nationkey) FROM nation WHERE n_name = key AND n_nationkey % 2 = 0), (SELECT max(r_regionkey) FROM region WHERE r_name = key),
  CASE WHEN regexp_full_match(key, '[0-9]+') AND TRY_CAST(key AS BIGINT) < 25 THEN TRY_CAST(key AS BIGINT) END)::BIGINT AS index FROM k"""
)
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, part = (table(spark, sf_dir, t) for t in ("nation", "region", "part"))
    keys = nation.select(F.col("n_name").alias("key")).union(region.select("r_name")).union(part.select(F.col("p_size").cast("string"))).union(spark.createDataFrame([("none",)], "key string"))
    return lookups.resolve(keys, nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("index")), region.select(F.col("r_name").alias("key"), F.col("r_regionkey").alias("index")), 25)


_FUNCTIONS = ["ring", "big widget", "widget", "small ring", "gear"]


@query("SELECT p_partkey, (SELECT arg_min(f, i) FROM (VALUES (0, 'ring'), (1, 'big widget'), (2, 'widget'), (3, 'small ring'), (4, 'gear')) v(i, f) WHERE ends_with(f, regexp_extract(p_name, '[a-z]+$'))) AS found FROM part")
def suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = F.array(*map(F.lit, _FUNCTIONS))
    return table(spark, sf_dir, "part").select("p_partkey", lookups.by_suffix(F.regexp_extract("p_name", "[a-z]+$", 0), functions).alias("found"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit(0).alias("pos"))
    new = old.where("o_orderkey % 7 = 0").select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"), F.lit("new").alias("o_orderstatus"), "pos")
    return results.upsert(old, new, "o_orderkey", "pos").drop("pos")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT user_id::VARCHAR AS instance_id, 'm' AS model_name_or_path, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS model_patch FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("instance_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("model_patch"), F.col("event_id").alias("pos"))
    return results.predictions(rows, "m")


@query("SELECT label, i AS dim, round(avg(embedding[i]::DOUBLE), 5) AS mean FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY label, i")
def meanpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = vectors.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("mean").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("dim"), F.round("x", 5).alias("mean"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE - 0.1::DOUBLE))), 5) AS error FROM embeddings")
def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(v), 5).alias("norm"), F.round(vectors.max_abs_error(v, F.transform(v, lambda _: F.lit(0.1))), 5).alias("error"))


@query(
    """SELECT doc_id, sha256(CASE WHEN len(text) > 1024 THEN left(text, 1024) || '...' ELSE text END) AS cut, sha256(CASE WHEN len(line) > 300 THEN left(line, 300) || '...' ELSE line END) AS preview,
  sha256('<returncode>' || doc_id % 3 || '</returncode>' || chr(10) || CASE WHEN len(text) < 10000 THEN '<output>' || chr(10) || text || '</output>' ELSE
    '<warning>The output of your last command was too long. Try a more selective command.</warning>' || chr(10) || '<output_head>' || chr(10) || left(text, 5000) || '</output_head>' || chr(10)
    || '<elided_chars>' || (len(text) - 10000) || ' characters elided</elided_chars>' || chr(10) || '<output_tail>' || chr(10) || right(text, 5000) || '</output_tail>' END) AS output
FROM (SELECT doc_id, text, replace(text, chr(10), '\\n') AS line FROM documents)"""
)
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(text.cut(t), 256).alias("cut"), F.sha2(text.preview(t), 256).alias("preview"), F.sha2(text.command_output(t, F.col("doc_id") % 3), 256).alias("output"))


@query(f"WITH {EVENT_FRAMES_SQL} SELECT CASE t WHEN 'taction' THEN 'action' ELSE t END AS type, count(*) AS n, count(DISTINCT id) AS n_trajectories FROM t GROUP BY 1")
def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wired = event_arrays(spark, sf_dir).select("id", wire.render(F.col("frames")).alias("w"))
    back = wire.parse(wired, "w").where("parse_error is null").select("id", F.explode("frames").alias("f")).where("f.error is null")
    return back.groupBy(F.col("f.type").alias("type")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_trajectories"))


@query(
    f"""WITH {EVENT_FRAMES_SQL}, g AS (SELECT id, bool_or(t = 'goal') AS goal FROM t GROUP BY id)
SELECT role, n FROM (SELECT CASE t WHEN 'action' THEN 'assistant' WHEN 'taction' THEN 'assistant' WHEN 'result' THEN 'tool' ELSE 'user' END AS role, count(*) AS n FROM t WHERE t IN ('action', 'taction', 'result', 'feedback') GROUP BY 1
UNION ALL SELECT 'system', count(*) FROM g WHERE goal HAVING count(*) > 0)"""
)
def messages_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = event_arrays(spark, sf_dir).select(F.explode(bridge.frames_to_messages(F.col("frames"))).alias("m"))
    return said.groupBy(F.col("m.role").alias("role")).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT user_id, event_id % 5 AS turn, count(*) AS n FROM events GROUP BY ALL)
SELECT round(avg(c), 6) AS avg_retry_count, sum(c)::DOUBLE AS total_retry_count FROM (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN sum(n - 1) ELSE 0 END AS c FROM s GROUP BY user_id)"""
)
def retry_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("user_id") % 2 == 0, "multi_turn_").otherwise("simple_"), F.col("user_id").cast("string")).alias("id"), (F.col("event_id") % 5).alias("turn"), F.col("event_id").alias("step"), F.col("event_type").alias("result"))
    out = results.retry_metrics(replay.nested_results(steps))
    return out.withColumn("avg_retry_count", F.round("avg_retry_count", 6))


@query(
    """SELECT p_partkey, sha256('{"api_name": "' || p_type || '", "category": "' || p_brand || '", "tool_input": "{\\"k\\": ' || p_size || '}", "tool_name": "' || p_name || '"}') AS key FROM part"""
)
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool_input = F.concat(F.lit('{"k": '), F.col("p_size").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", lookups.cache_key(F.col("p_brand"), F.col("p_name"), F.col("p_type"), tool_input).alias("key"))


@query(
    r"""SELECT p_partkey, CASE WHEN regexp_matches(n, '^[0-9]') THEN 'get_' || n ELSE n END AS name, replace('a/' || p_brand, '/', '_') AS folder, regexp_replace('k_' || p_type || '_' || p_size, '_[^_]*$', '') AS category
FROM (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(p_size || ' ' || p_name || '-' || p_brand || '!', '[^a-zA-Z0-9_^]', '_', 'g'), '_+', '_', 'g')), '^_+|_+$', '', 'g') AS n FROM part)"""
)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit("-"), "p_brand", F.lit("!"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.identifier(raw).alias("name"), text.directory_name(F.concat(F.lit("a/"), "p_brand")).alias("folder"), results.category(F.concat_ws("_", F.lit("k"), "p_type", F.col("p_size").cast("string"))).alias("category")
    )


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS reward, round(100.0 * (event_id % 10) / nullif(event_id % 4, 0), 6)::DOUBLE AS percent FROM events")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.concat((F.col("event_id") % 10).cast("string"), F.lit("/"), (F.col("event_id") % 4).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", text.to_float(F.concat(F.lit(" "), F.regexp_extract("props", "[0-9]+", 0), F.lit("\n"))).alias("reward"), F.round(text.fraction(part), 6).alias("percent"))


@query(
    """WITH r AS (SELECT user_id AS id, list(DISTINCT event_type) AS called, bool_or(event_type = 'purchase') AS finished, CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 7 = 0 THEN 'give_up_and_restart' ELSE 'x' END AS answer FROM events GROUP BY user_id)
SELECT id, CASE WHEN NOT finished THEN 'no finish' WHEN answer IN ('', 'give_up_and_restart') THEN 'empty final answer' WHEN list_contains(called, 'error') AND id % 2 = 0 THEN 'hallucination' ELSE 'structural pass' END AS reason FROM r"""
)
def structural_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_set("event_type").alias("called"), F.bool_or(F.col("event_type") == "purchase").alias("finished"))
    answer = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 7 == 0, "give_up_and_restart").otherwise("x")
    offered = F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, ("click", "view", "purchase", "signup")))).otherwise(F.col("called"))
    return runs.select("id", results.structural_pass(F.col("called"), offered, answer, F.col("finished"))["reason"].alias("reason"))


@query(
    """WITH f(i, f) AS (VALUES (0, 'ring'), (1, 'big widget'), (2, 'widget'), (3, 'small ring'), (4, 'gear')),
c AS (SELECT p_partkey, regexp_extract(p_name, '[a-z]+$') AS action, CASE p_size % 3 WHEN 0 THEN 'Message error...' ELSE '' END AS error, p_type || p_brand AS response FROM part),
k AS (SELECT *, (SELECT arg_min(f, i) FROM f WHERE ends_with(f, action)) AS found FROM c)
SELECT p_partkey, CASE WHEN found IS NULL THEN '{"error": "No such function name: ' || action || '", "response": ""}' ELSE '{"error": "' || error || '", "response": "' || response || '"}' END AS observation,
  CASE WHEN found IS NULL THEN 1 WHEN error = '' THEN 0 ELSE 11 END AS code FROM k"""
)
def tool_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.regexp_extract("p_name", "[a-z]+$", 0)
    found = lookups.by_suffix(action, F.array(*map(F.lit, _FUNCTIONS)))
    error = F.when(F.col("p_size") % 3 == 0, "Message error...").otherwise("")
    step = lookups.tool_step(action, found, error, F.concat("p_type", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", step.alias("s")).select("p_partkey", "s.observation", "s.code")


@query(
    """SELECT 'simple_' || o_orderkey AS task_id, 'simple' AS domain, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS success, '0' AS retry_steps,
  (o_orderkey % 50 + o_custkey % 9)::BIGINT AS total_tokens, o_orderkey % 8 / 8 AS total_sec FROM orders"""
)
def task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.operators import suites

    orders = table(spark, sf_dir, "orders").withColumn("id", F.concat(F.lit("simple_"), F.col("o_orderkey").cast("string")))
    rows = orders.select("id", F.col("o_orderpriority").alias("result"), F.lit(None).cast("array<array<string>>").alias("turns"), (F.col("o_orderkey") % 50).alias("input_token_count"), (F.col("o_custkey") % 9).alias("output_token_count"), (F.col("o_orderkey") % 8 / 8).alias("latency"))
    verdicts = orders.where(F.col("o_orderstatus").isin("F", "O")).select("id", (F.col("o_orderstatus") == "F").alias("valid"))
    tasks = suites.function_calls(rows, verdicts)
    return tasks.select("task_id", "domain", "success", F.col("metrics")["retry_steps"].alias("retry_steps"), "tokens.total_tokens", "timing.total_sec")


@query(
    """WITH s AS (SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'swe' WHEN 1 THEN 'bfcl' ELSE 'mine' END AS suite, n_name AS format FROM nation)
SELECT suite, format, CASE WHEN suite = 'swe' AND k % 2 = 0 THEN 0.0 WHEN suite = 'swe' THEN 0.5 WHEN suite = 'bfcl' THEN k / 32 ELSE 2.0 END::DOUBLE AS "primary",
  CASE suite WHEN 'swe' THEN 'resolved_rate' WHEN 'bfcl' THEN 'accuracy' ELSE suite END AS primary_label, CASE WHEN suite = 'bfcl' THEN 1.5 END::DOUBLE AS secondary, CASE WHEN k % 4 = 0 THEN 42 ELSE k END::INTEGER AS sample_seed, (k + 1)::INTEGER AS num_run FROM s"""
)
def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.plans import matrix

    k = F.col("n_nationkey")
    suite = F.when(k % 3 == 0, "swe").when(k % 3 == 1, "bfcl").otherwise("mine")
    metrics = F.when(k % 3 == 1, F.create_map(F.lit("accuracy"), (k / 32).cast("string"), F.lit("avg_retry_count"), F.lit("1.5"), F.lit("n"), (k + 1).cast("string")))
    metrics = metrics.when(k % 3 == 2, F.create_map(F.lit("mine_primary"), F.lit("2"), F.lit("n"), (k + 1).cast("string"))).when(k % 2 == 0, F.create_map(F.lit("n"), (k + 1).cast("string")))
    metrics = metrics.otherwise(F.create_map(F.lit("resolved_rate"), F.lit("0.5"), F.lit("n"), (k + 1).cast("string")))
    meta = F.create_map(F.lit("model"), F.lit("m"), F.lit("sample_seed"), F.when(k % 4 == 0, 0).otherwise(k).cast("string"))
    runs = table(spark, sf_dir, "nation").select(suite.alias("suite"), F.col("n_name").alias("format"), meta.alias("meta"), metrics.alias("metrics"), F.lit("").alias("path"))
    return matrix.rows(runs).select("suite", "format", "primary", "primary_label", "secondary", "sample_seed", "num_run")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey % 5 = 0")
def pinned_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    ids = [r[0] for r in nation.where("n_nationkey % 5 = 0").orderBy(F.desc("n_nationkey")).select("n_name").collect()]
    return lookups.subset(nation, lookups.pinned(spark, ids, "n_name"), "n_name").select("n_name", "n_regionkey")


@query(f"WITH {EVENT_FRAMES_SQL}, n AS (SELECT id, count(*) AS n FROM t GROUP BY id) SELECT t.id, count(*) FILTER (i >= n - 3) AS last_frames, count(*) FILTER (t IN ('belief', 'action', 'taction', 'end')) AS of_model, 2 * count(*) AS doubled FROM t JOIN n ON t.id = n.id GROUP BY t.id")
def trajectory_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.operators import trajectory

    f = F.col("frames")
    of_model = F.size(F.filter(trajectory.owners(f), lambda o: o == "model"))
    return event_arrays(spark, sf_dir).select("id", *(c.cast("long").alias(n) for n, c in (("last_frames", F.size(trajectory.part(f, -3))), ("of_model", of_model), ("doubled", F.size(trajectory.extend(f, f))))))


@query("SELECT key, error, response FROM (SELECT p_partkey::VARCHAR AS key, '' AS error, p_type AS response FROM part) WHERE key::BIGINT % 2 = 0")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    calls = part.select(F.col("p_partkey").cast("string").alias("category"), F.lit("t").alias("tool"), F.lit("a").alias("api"), F.lit("").alias("tool_input"), "p_type")
    key = lookups.cache_key(*(F.col(c) for c in ("category", "tool", "api", "tool_input")))
    known = calls.where("category % 2 = 1").select(key.alias("key"), F.lit("").alias("error"), F.lit("r").alias("response"))
    _, missing = lookups.cached(calls, known)
    return missing.select(F.col("category").alias("key"), F.lit("").alias("error"), F.col("p_type").alias("response"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, j): each conversation as JSON of chat messages."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("j"))


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.functions import pyjson

    return _conversations(spark, sf_dir).withColumn("m", pyjson.ingest_messages(F.col("j"))["messages"])


#: Turns as frames x(conv_id, i, type, text): an assistant's blank text gives none; white space at the ends of an assistant's text goes.
_CHAT_FRAMES_SQL = r"""y AS (SELECT conv_id, turn, role, text, CASE role WHEN 'assistant' THEN regexp_replace(regexp_replace(coalesce(text, ''), '^[\s\x1c-\x1f]+', ''), '[\s\x1c-\x1f]+$', '') ELSE coalesce(text, '') END AS said,
  sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS users FROM conversations),
x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE role WHEN 'system' THEN 'goal' WHEN 'assistant' THEN 'action' ELSE CASE WHEN users = 1 THEN 'mission' ELSE 'feedback' END END AS type,
  role, said AS text FROM y WHERE role IN ('system', 'user') OR said <> '')"""


@query(f"WITH {_CHAT_FRAMES_SQL} SELECT conv_id, i, type, sha256(text) AS digest FROM x")
def chat_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _chat(spark, sf_dir).select("conv_id", F.posexplode(bridge.messages_to_frames(F.col("m"))["frames"]).alias("i", "f"))
    said = F.when(F.col("f.type") == "action", F.col("f.answer")).otherwise(F.col("f.text"))
    return frames.select("conv_id", F.col("i").cast("long").alias("i"), F.col("f.type").alias("type"), F.sha2(said, 256).alias("digest"))


@query(f"WITH {_CHAT_FRAMES_SQL} SELECT conv_id, i, role, sha256(text) AS digest FROM x")
def chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _chat(spark, sf_dir).select("conv_id", F.posexplode(bridge.frames_to_messages(bridge.messages_to_frames(F.col("m"))["frames"])).alias("i", "m"))
    return back.select("conv_id", F.col("i").cast("long").alias("i"), F.col("m.role").alias("role"), F.sha2("m.content", 256).alias("digest"))


@query(f"WITH {_CHAT_FRAMES_SQL}, f AS (SELECT conv_id, count(*) AS frames FROM x GROUP BY conv_id) SELECT c.conv_id, coalesce(frames, 0) AS frames, count(*) AS messages, false AS failed FROM conversations c LEFT JOIN f USING (conv_id) GROUP BY ALL")
def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bridge.coerce(_conversations(spark, sf_dir), "j")
    return out.select("conv_id", F.size("frames").cast("long").alias("frames"), F.size("messages").cast("long").alias("messages"), F.col("error").isNotNull().alias("failed"))


_TOOLS = '[{"name": "look", "parameters": {}}]'


@query(
    f"""WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role, coalesce(text, '') AS said, min(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS first, turn FROM conversations),
o AS (SELECT conv_id, CASE WHEN first IS NULL THEN i + 1 ELSE i END AS i, role, CASE WHEN turn = first THEN trim(said || chr(10) || chr(10) || 'available tools:' || chr(10) || '{_TOOLS}', ' ' || chr(10) || chr(9)) ELSE said END AS said FROM m
  UNION ALL SELECT DISTINCT conv_id, 1, 'system', 'available tools:' || chr(10) || '{_TOOLS}' FROM m WHERE first IS NULL)
SELECT conv_id, i::BIGINT AS i, role, sha256(said) AS digest FROM o"""
)
def injected_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.transform(F.col("m"), bridge._plain)
    out = _chat(spark, sf_dir).select("conv_id", F.posexplode(bridge.inject_tools(plain, F.lit(_TOOLS))).alias("i", "m"))
    return out.select("conv_id", (F.col("i") + 1).cast("long").alias("i"), F.col("m.role").alias("role"), F.sha2("m.content", 256).alias("digest"))


@query(f"WITH {EVENT_FRAMES_SQL}, g AS (SELECT id, min(i) FILTER (t = 'goal') AS goal, count(*) AS n FROM t GROUP BY id) SELECT id, n + 1 AS n, coalesce(goal + 1, n) AS place, true AS there FROM g")
def tool_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.functions import tools

    rendered = tools.render_tools(F.lit(_TOOLS))
    out = event_arrays(spark, sf_dir).withColumn("r", rendered).select("id", bridge.with_tool_obs(F.col("frames"), F.col("r")).alias("f"))
    place = F.array_position(F.transform("f", lambda x: x["type"]), "obs") - 1
    return out.select("id", F.size("f").cast("long").alias("n"), place.cast("long").alias("place"), bridge.has_tool_obs(F.col("f")).alias("there"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '{"name": "look", "arguments": {"x": ' || p_size || '}}' WHEN 2 THEN '{"tool": "' || p_brand || '"}' END AS call, CASE p_partkey % 5 WHEN 1 THEN p_name ELSE '' END AS said,
  CASE p_partkey % 5 WHEN 0 THEN 'tool_call' WHEN 1 THEN 'assistant_text' WHEN 2 THEN 'tool_call' ELSE 'parse_error: empty' END AS stop, p_partkey % 5 < 2 OR p_partkey % 5 = 3 AS parsed_ok,
  CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1 END AS n_errors FROM part WHERE p_partkey % 5 < 4
UNION ALL SELECT p_partkey, NULL, '', 'parse_error: Expecting value', true, 1 FROM part WHERE p_partkey % 5 = 4"""
)
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('<|python_tag|>{"name": "look", "arguments": {"x": '), size, F.lit("}}<|eom_id|>"))).when(k == 1, F.concat(F.lit(" "), "p_name", F.lit("\n<|eot_id|>")))
        .when(k == 2, F.concat(F.lit('{"tool": "'), "p_brand", F.lit('"}'))).when(k == 3, F.lit(" <|eot_id|>")).otherwise(F.lit("<|python_tag|>look<|eom_id|>"))
    )
    read = bridge.parse_generation(table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), "raw")
    check = results.check_chat(F.col("raw"), F.col("call"), F.col("stop"))
    return read.select("p_partkey", "call", "said", "stop", check["parsed_ok"].alias("parsed_ok"), F.size(check["errors"]).alias("n_errors"))


@query("SELECT user_id AS run_id, CASE WHEN s < 8 THEN 'terminal_action' ELSE 'max_iterations' END AS stopped_on, least(coalesce(s + 1, n), 8)::BIGINT AS iterations, CASE WHEN s < 8 THEN 'e' || e END AS answer, least(2 * coalesce(s + 1, n), 16)::BIGINT AS n_frames FROM (SELECT user_id, count(*) AS n, coalesce(min(step) FILTER (event_type = 'purchase'), NULL) AS s, arg_min(event_id, step) FILTER (event_type = 'purchase') AS e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events) GROUP BY user_id)")
def replayed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, "frames")


@query("SELECT user_id AS run_id, CASE WHEN s < 8 THEN 'terminal_action' ELSE 'max_iterations' END AS stopped_on, least(coalesce(s + 1, n), 8)::BIGINT AS iterations, CASE WHEN s < 8 THEN 'e' || e END AS answer, CASE WHEN s < 8 THEN 2 * s + 1 ELSE 2 * least(n, 8) END::BIGINT AS n_frames FROM (SELECT user_id, count(*) AS n, min(step) FILTER (event_type = 'purchase') AS s, arg_min(event_id, step) FILTER (event_type = 'purchase') AS e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events) GROUP BY user_id)")
def replayed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, "chat")


def _replayed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Runs over recorded steps: a purchase answers, any other event calls a tool."""
    from frameloom.operators.registry import Tool, ToolRegistry

    events = event_frames(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    number, buys = F.col("event_id").cast("string"), F.col("event_type") == "purchase"
    if kind == "frames":
        raw = F.when(buys, F.concat(F.lit('<|action|>{"tool": "answer", "text": "e'), number, F.lit('"}'))).otherwise(F.concat(F.lit('<|action|>{"tool": "double", "x": '), number, F.lit("}")))
    else:
        raw = F.when(buys, F.concat(F.lit("e"), number, F.lit("<|eot_id|>"))).otherwise(F.concat(F.lit('<|python_tag|>{"name": "double", "parameters": {"x": '), number, F.lit("}}<|eom_id|>")))
    steps = events.select(F.col("id").alias("run_id"), F.col("i").alias("step"), raw.alias("raw_text"), F.lit(1).alias("n_gen"))
    out = replay.replay(steps, ToolRegistry([Tool("double", lambda x: 2 * x)]), kind, max_iterations=8)
    return out.select("run_id", "stopped_on", F.col("iterations").cast("long").alias("iterations"), "answer", F.json_array_length("frames").cast("long").alias("n_frames"))


@query(f"WITH {EVENT_FRAMES_SQL} SELECT id, sum(CASE t WHEN 'action' THEN len(event_id::VARCHAR) + 30 WHEN 'taction' THEN len(event_id::VARCHAR) + 32 WHEN 'result' THEN len(event_id::VARCHAR) + 12 WHEN 'end' THEN 1 ELSE len(event_id::VARCHAR) + 2 END)::BIGINT AS n_ids,"
    " sum(CASE t WHEN 'action' THEN len(event_id::VARCHAR) + 30 WHEN 'taction' THEN len(event_id::VARCHAR) + 32 WHEN 'end' THEN 1 WHEN 'belief' THEN len(event_id::VARCHAR) + 2 ELSE 0 END)::BIGINT AS learnt FROM t GROUP BY id"
    " HAVING count(*) FILTER (t IN ('action', 'taction', 'belief', 'end')) > 0")
def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.tokenize(event_arrays(spark, sf_dir), _marker_ids, max_length=1 << 30)
    kept = F.size(F.filter("labels", lambda x: x != labels.IGNORED))
    return out.select("id", F.size("input_ids").cast("long").alias("n_ids"), kept.cast("long").alias("learnt"))


def _marker_ids(wire: str) -> list[int]:
    """A marker's own id for each reserved token, and a code point for all else."""
    import re

    from frameloom.functions.schema import FRAME_TYPES

    ids = {slot: token for _, slot, token, *_ in FRAME_TYPES}
    out: list[int] = []
    for part in re.split(r"(<\|reserved_special_token_\d+\|>)", wire):
        slot = re.fullmatch(r"<\|reserved_special_token_(\d+)\|>", part)
        out += [ids[int(slot[1])]] if slot else map(ord, part)
    return out


@query("SELECT conv_id, 5 * count(*) AS n, 2 * count(*) FILTER (role = 'assistant') AS kept, coalesce(sum(len(coalesce(text, '')) + 103) FILTER (role = 'assistant'), 0)::BIGINT AS total FROM conversations GROUP BY conv_id")
def assistant_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length(F.coalesce("text", F.lit(""))) + 100
    part = F.array(F.lit(1), F.when(F.col("role") == "assistant", 7).otherwise(8), F.lit(2), size, F.lit(3))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("ids")))).alias("t"))
    masked = turns.select("conv_id", labels.mask_assistant(F.flatten(F.transform("t", lambda x: x["ids"])), [1], [2], [3], [7]).alias("l"))
    kept = F.filter("l", lambda x: x != labels.IGNORED)
    return masked.select("conv_id", F.size("l").cast("long").alias("n"), F.size(kept).cast("long").alias("kept"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH {EVENT_FRAMES_SQL}, {VIOLATIONS_SQL}, f AS (SELECT id, arg_min(rule, CASE rule WHEN 'missing_goal' THEN 0 WHEN 'opening_prelude' THEN 1 WHEN 'misplaced_end' THEN 2 ELSE 3 END) AS rule FROM v GROUP BY id) SELECT CASE WHEN rule IN ('missing_goal', 'opening_prelude', 'misplaced_end') THEN rule ELSE 'walk' END AS reason, count(*) AS n FROM f GROUP BY 1")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = dataset.checked(event_arrays(spark, sf_dir).withColumn("error", F.lit(None).cast("string")))
    rule = F.regexp_extract("reason", r"^validation: \[(\w+)", 1)
    return dataset.histogram(marked.where("reason is not null").withColumn("reason", F.when(rule.isin("missing_goal", "opening_prelude", "misplaced_end"), rule).otherwise("walk")), "reason")


@query(f"WITH {EVENT_FRAMES_SQL} SELECT id, CASE n WHEN 0 THEN '[]' WHEN 1 THEN calls ELSE '[' || calls || ']' END AS encoded FROM (SELECT id, count(*) FILTER (t = 'action') AS n, string_agg('{{\"name\": \"bash\", \"parameters\": {{\"text\": \"e' || event_id || '\"}}}}', ', ' ORDER BY i) FILTER (t = 'action') AS calls FROM t GROUP BY id)")
def encoded_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = F.filter("frames", lambda f: f["type"] == "action")
    return event_arrays(spark, sf_dir).select("id", results.encode_actions(actions).alias("encoded"))


@query("SELECT p_partkey, 'look' AS tool, nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END, '') AS value FROM part UNION ALL SELECT p_partkey, 'unknown', p_brand FROM part WHERE p_size % 3 > 0")
def executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = F.when(F.col("p_size") % 3 > 0, F.array(F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_name")), F.col("p_brand"))).otherwise(F.array(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name"))))
    calls = F.array(F.concat(F.lit("look(x="), F.col("p_size").cast("string"), F.lit(")")), F.lit("(y)"), F.lit("third()"))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(results.execution_results(calls, outputs)))


@query("SELECT count(*) AS n, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END)::DOUBLE AS structural_pass_rate, avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS cache_pass_rate, avg(CASE WHEN event_id % 5 > 0 THEN CASE WHEN event_id % 5 = 1 THEN 1.0 ELSE 0.0 END END)::DOUBLE AS gpt_pass_rate, avg(event_id % 7)::DOUBLE AS avg_steps, count(*) FILTER (event_type = 'purchase') AS structural_pass FROM events")
def tool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select((F.col("event_type") == "purchase").alias("structural"), (e % 3 == 0).alias("cache"), F.when(e % 5 > 0, e % 5 == 1).alias("gpt"), (e % 7).alias("steps"))
    return results.tool_scores(rows)


@query("SELECT p_partkey, p_name || ' ' || p_size AS mission FROM part WHERE p_size % 4 > 0")
def instance_missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.operators import suites

    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("\n"), F.col("p_size").cast("string"), F.lit(" "))).otherwise(" ").alias("problem_statement"), "p_name")
    good, _ = suites.instances(rows, "{task}")
    return good.select("p_partkey", F.concat_ws(" ", "p_name", "mission").alias("mission"))


@query(f"WITH {EVENT_FRAMES_SQL} SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS i, CASE t WHEN 'taction' THEN 'assistant' ELSE 'tool' END AS t FROM t WHERE t IN ('action', 'taction')")
def first_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = event_arrays(spark, sf_dir).select("id", F.posexplode(replay.first_calls(bridge.frames_to_messages(F.col("frames")))).alias("i", "c"))
    return chain.select("id", F.col("i").cast("long").alias("i"), F.col("c.role").alias("t"))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS passed FROM orders")
def tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.operators import suites

    return suites.tally(table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("success")))


@query("SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS resolved, (SELECT avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END) FROM orders)::DOUBLE AS \"primary\" FROM orders")
def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    known = results.resolved_of(orders, orders.where("id % 3 = 0"))
    report = orders.agg(F.count("*").alias("submitted_instances"), F.count_if(F.col("id") % 3 == 0).alias("resolved_instances"), F.array().cast("array<bigint>").alias("resolved_ids"))
    # one row of the report's rate, beside each id
    rate = results.resolved(orders.agg(F.min("id").alias("id")), report).select("primary")
    return known.crossJoin(F.broadcast(rate))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY 'k_' || s_nationkey || '_', s_suppkey) AS place FROM supplier")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.plans.sinks import scratch

    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark, "places"))
    ids = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("k_"), F.col("s_nationkey").cast("string"), F.lit("_"), F.col("s_suppkey").cast("string")).alias("id"))
    return results.places(ids, results.natural_order(F.col("id"))).select("s_suppkey", "place")
