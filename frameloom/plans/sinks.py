"""Queries that write what a user writes and read it back: keyed files, appended lines, merged tables, caches; and the lookups beside them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import pyjson, schema
from frameloom.operators import bridge, checks, lookups, suites, trajectory, validate, vectors
from frameloom.plans.frames_from_tables import EVENT_FRAMES_SQL, event_arrays, event_frames, table
from frameloom.plans.registry import query
from frameloom.sources import keyed, readers, writers
from frameloom.streaming import append


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own in the folder that driver and executors share, deleted when the session's JVM ends; only in local mode a temporary folder stands in."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='frameloom-')}"
        sc.setCheckpointDir(base)
    at = f"{base.rstrip('/')}/frameloom-{tag}-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def _json(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query(
    """SELECT 's_' || s_suppkey AS id, sha256('{' || chr(10) || '  "id": "s_' || s_suppkey || '",' || chr(10) || '  "success": ' || (s_suppkey % 2 = 0)::VARCHAR || ',' || chr(10) || '  "tools": [' || chr(10) || '    {' || chr(10)
  || '      "n": ' || s_nationkey || chr(10) || '    }' || chr(10) || '  ],' || chr(10) || '  "final_answer": ' || CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE '"' || s_name || '\\u00e9"' END || chr(10) || '}') AS written FROM supplier"""
)
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        _json("s_", n.cast("string")).alias("id"), (n % 2 == 0).alias("success"), _json('[{"n": ', F.col("s_nationkey").cast("string"), "}]").alias("tools"), F.when(n % 3 > 0, _json(F.col("s_name"), "é")).alias("final_answer")
    )
    at = scratch(spark, "results")
    writers.result_files(rows, at, json_columns=("tools",))
    back = spark.read.text(at, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("id"), F.sha2("value", 256).alias("written"))
    return back


@query(
    """WITH o AS (SELECT 'c_' || c_custkey AS id, '    "nation": ' || c_nationkey AS a, '    "said": "' || c_name || ' \\"x\\""' AS b FROM customer),
l AS (SELECT '{' AS line UNION ALL SELECT '}' UNION ALL SELECT '  "' || id || '": {' FROM o UNION ALL SELECT a || ',' FROM o UNION ALL SELECT b FROM o UNION ALL SELECT CASE WHEN id = (SELECT max(id) FROM o) THEN '  }' ELSE '  },' END FROM o)
SELECT line, count(*) AS n FROM l GROUP BY line"""
)
def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = _json('{"nation": ', F.col("c_nationkey").cast("string"), ', "said": "', F.col("c_name"), ' \\"x\\""}')
    rows = table(spark, sf_dir, "customer").select(_json("c_", F.col("c_custkey").cast("string")).alias("id"), value.alias("value"))
    at = f"{scratch(spark, 'converted')}/G1.json"
    writers.converted(rows, at)
    return spark.read.text(at).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(
    """SELECT line, count(*) AS n FROM (SELECT unnest(['  "i_' || s_suppkey || '": {', '    "model_name_or_path": "m",', '    "instance_id": "i_' || s_suppkey || '",', '    "model_patch": "' || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name END || '"',
  CASE WHEN 'i_' || s_suppkey = (SELECT max('i_' || s_suppkey) FROM supplier) THEN '  }' ELSE '  },' END]) AS line FROM supplier UNION ALL SELECT unnest(['{', '}'])) GROUP BY line"""
)
def prediction_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(_json("i_", F.col("s_suppkey").cast("string")).alias("instance_id"), F.when(F.col("s_suppkey") % 2 > 0, F.col("s_name")).alias("model_patch"))
    at = f"{scratch(spark, 'predictions')}/preds.json"
    writers.predictions(rows, at, "m")
    return spark.read.text(at).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


_FRAMES_JSON = """string_agg('{"type": "' || CASE t WHEN 'taction' THEN 'action' ELSE t END || '", "content": ' || CASE t WHEN 'action' THEN '{"tool": "bash", "text": "e' || event_id || '"}' WHEN 'taction' THEN '{"tool": "answer", "text": "e' || event_id || '"}'
  WHEN 'result' THEN '{"value": ' || event_id || '}' ELSE '"e' || event_id || '"' END || '}', ', ' ORDER BY i)"""


@query(f"WITH {EVENT_FRAMES_SQL} SELECT id::VARCHAR AS id, CASE id % 3 WHEN 0 THEN 'unknown' ELSE 'd' || id % 3 END AS domain, count(*)::INTEGER AS num_frames, sha256('[' || {_FRAMES_JSON} || ']') AS frames FROM t WHERE id % 4 = 0 GROUP BY id")
def dataset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories as JSON lines, loaded, written as a dataset, and one split of it read."""
    i = F.col("id")
    domain = F.when(i % 3 == 0, F.lit("null")).otherwise(_json('"d', (i % 3).cast("string"), '"'))
    lines = event_arrays(spark, sf_dir).select(_json('{"id": ', i.cast("string"), ', "domain": ', domain, ', "frames": ', trajectory.to_json(F.col("frames")), "}").alias("line"))
    raw, kept = scratch(spark, "raw"), scratch(spark, "dataset")
    writers.append_lines(lines, raw)
    rows, _ = readers.trajectories(spark, raw)
    writers.dataset(rows.withColumn("split", F.when(F.col("id").cast("long") % 4 == 0, "eval").otherwise("train")), kept)
    return readers.dataset(spark, kept, "eval").select("id", "domain", "num_frames", F.sha2("frames", 256).alias("frames"))


@query("SELECT least(700, count(*))::BIGINT AS n_lines, least(700, count(*))::BIGINT AS n_known, least(700, count(*))::BIGINT AS n_named FROM events")
def appended_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of lines, appended up to 700; a second run finds nothing left to do."""
    at, checkpoint = scratch(spark, "lines"), scratch(spark, "checkpoint")
    events = table(spark, sf_dir, "events")
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        append.append_until(stream.select(_json("e", F.col("event_id").cast("string")).alias("line")), at, checkpoint, 700).awaitTermination()
    written = spark.read.text(at).select("value", F.col("lines"))
    known = events.select(_json("e", F.col("event_id").cast("string")).alias("value")).distinct().withColumn("_known", F.lit(True))
    return written.join(known, "value", "left").agg(F.count("*").alias("n_lines"), F.count("_known").alias("n_known"), F.max("lines").cast("long").alias("n_named"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' ELSE 'old ' END || s_name AS value FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def merged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is merged into in place, the last time with the same rows again."""
    at = scratch(spark, "merged")
    rows = lambda said, step: table(spark, sf_dir, "supplier").where(f"s_suppkey % {step} = 0").select(F.col("s_suppkey").alias("id"), _json(f"{said} ", F.col("s_name")).alias("value"), F.col("s_suppkey").alias("pos"))
    writers.merge_at(rows("old", 2), at)
    writers.merge_at(rows("new", 3), at)
    return writers.merge_at(rows("new", 3), at).select("id", "value")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS response, p_partkey % 3 = 0 AS hit FROM part WHERE p_size % 2 = 0")
def cache_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers kept in folders by their keys' hash; calls read the folders that theirs fall into."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit("c").alias("category"), F.col("p_brand").alias("tool"), F.col("p_type").alias("api"), _json("{", F.col("p_partkey").cast("string"), "}").alias("tool_input"), "p_name")
    at = scratch(spark, "cache")
    key = lookups.cache_key(*(F.col(c) for c in ("category", "tool", "api", "tool_input")))
    for rest in (0, 3):  # the second run adds what is there already
        lookups.keep_answers(part.where(f"p_partkey % 6 = {rest} or p_partkey % 9 = 0").select(key.alias("key"), F.lit("").alias("error"), F.col("p_name").alias("response")), at)
    hits, misses = lookups.looked_up(part.where("p_size % 2 = 0").drop("p_name"), at)
    return hits.select("p_partkey", "response", F.lit(True).alias("hit")).union(misses.select("p_partkey", F.lit(None).cast("string"), F.lit(False)))


@query(
    """WITH f AS (SELECT p_name || '_for_' || p_brand AS function, p_partkey AS rank FROM part),
n AS (SELECT DISTINCT unnest(['_for_' || p_brand, p_name || '_for_Brand#' || p_size, '#' || p_size, '']) AS name FROM part)
SELECT name, (SELECT arg_min(function, rank) FROM f WHERE ends_with(function, name)) AS found FROM n"""
)
def suffix_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    functions = part.select(_json(F.col("p_name"), "_for_", F.col("p_brand")).alias("function"), F.col("p_partkey").alias("rank"))
    size = F.col("p_size").cast("string")
    names = part.select(F.explode(F.array(_json("_for_", F.col("p_brand")), _json(F.col("p_name"), "_for_Brand#", size), _json("#", size), F.lit(""))).alias("name")).distinct()
    return lookups.suffix_join(names, functions)


@query(
    """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
v AS (SELECT piece, row_number() OVER (ORDER BY piece) AS row_id FROM (SELECT ' ' || word AS piece FROM w WHERE len(word) % 2 = 0 UNION SELECT ' ' || left(word, 2) FROM w UNION SELECT substr(word, 3) FROM w)),
t AS (SELECT p_partkey AS target, string_split(p_name, ' ') AS words FROM part),
u AS (SELECT target, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t),
s AS (SELECT u.target, v.row_id FROM u JOIN v ON v.piece = ' ' || u.word),
f AS (SELECT target, (SELECT arg_max(row_id, len(piece)) FROM v WHERE starts_with(' ' || words[1], piece)) AS row_id FROM t WHERE target NOT IN (SELECT target FROM s))
SELECT target, sum(row_id)::BIGINT AS rows, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM f WHERE row_id IS NOT NULL) GROUP BY target"""
)
def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part")
    words = part.select(F.col("p_partkey").alias("target"), F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    word = words.select("word").distinct()
    pieces = word.where(F.length("word") % 2 == 0).select(_json(" ", F.col("word")).alias("piece")).union(word.select(_json(" ", F.expr("left(word, 2)")))).union(word.select(F.expr("substring(word, 3)"))).distinct()
    # the names' words are few
    vocabulary = pieces.withColumn("row_id", F.row_number().over(Window.orderBy("piece")))
    return vectors.seeds(words, vocabulary).groupBy("target").agg(F.sum("row_id").alias("rows"), F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, o_orderpriority AS category, o_orderkey % 7 AS result FROM orders WHERE o_orderpriority NOT IN (SELECT min(o_orderpriority) FROM orders) AND o_orderkey % 7 <> 3")
def checked_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the categories that are not excluded; their number is checked by the job that writes them."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 7).alias("result"))
    first = orders.agg(F.min("category").alias("c")).first()["c"]
    kept = checks.kept_categories(orders, F.col("category"), [first] if first is not None else [], also=F.col("result") == 3)
    pins = kept.select("id", F.lit(0).alias("pos"))
    wanted, at = checks.pinned(kept, pins), scratch(spark, "entries")
    wanted.table().select("id", "category", "result").write.parquet(at)
    wanted.verify()
    return spark.read.parquet(at)


@query(
    """SELECT 'bfcl' AS suite, 'chat' AS format, 'n_' || n_nationkey AS task_id, n_regionkey % 2 = 0 AS success, n_name AS said, (SELECT count(*) FROM nation)::VARCHAR AS n FROM nation"""
)
def benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's envelope, written and read: the tasks that the summary lists, and the number that its metrics have."""
    nation = table(spark, sf_dir, "nation")
    tasks = nation.select(_json("n_", F.col("n_nationkey").cast("string")).alias("task_id"), (F.col("n_regionkey") % 2 == 0).alias("success"), F.col("n_name").alias("said"))
    root = scratch(spark, "runs")
    writers.benchmark({"model": "m", "sample_seed": 7}, tasks.agg(F.count("*").alias("n")), tasks, f"{root}/bfcl/chat")
    listed = readers.summary_tasks(spark, root, "task_id string, success boolean, said string")
    runs = readers.summaries(spark, root).select("suite", "format", F.col("metrics")["n"].alias("n"))
    return listed.join(runs, ["suite", "format"]).select("suite", "format", "task_id", "success", "said", "n")


@query(f"WITH {EVENT_FRAMES_SQL} SELECT 'k_' || id % 5 AS tool, sum((t = 'action')::INT)::BIGINT AS n_calls, count(DISTINCT id) AS n_runs FROM t GROUP BY 1")
def written_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that were written as JSON in a dataset, read and counted again."""
    rows = event_arrays(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.lit("d").alias("domain"), "frames", bridge.frames_to_messages(F.col("frames")).alias("messages"), F.lit("train").alias("split"))
    at = scratch(spark, "messages")
    writers.dataset(rows, at)
    back = readers.dataset(spark, at).select("id", pyjson.ingest_messages(F.col("messages"))["messages"].alias("m"))
    calls = F.aggregate("m", F.lit(0), lambda n, m: n + F.size(m["calls"]))
    return back.select("id", calls.alias("n")).groupBy(_json("k_", (F.col("id").cast("long") % 5).cast("string")).alias("tool")).agg(F.sum("n").cast("long").alias("n_calls"), F.count_distinct("id").alias("n_runs"))


#: A user's rule, for the query below and its stream.
TWICE = validate.OwnRule("same_twice", lambda previous, kind, index, terminal: (previous == kind) & ~terminal & (index % 2 == 1), "the same twice")


@query(
    f"""WITH {EVENT_FRAMES_SQL}, p AS (SELECT id, i, CASE t WHEN 'taction' THEN 'action' ELSE t END AS kind, t = 'taction' AS terminal FROM t),
q AS (SELECT *, lag(kind) OVER (PARTITION BY id ORDER BY i) AS previous FROM p), v AS (SELECT id, i FROM q WHERE previous = kind AND NOT terminal AND i % 2 = 1)
SELECT form, id, i::INTEGER AS frame_index FROM v, (VALUES ('fold'), ('window')) AS f(form)"""
)
def own_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's rule as a fold and over windows."""
    fold = event_arrays(spark, sf_dir).select("id", F.inline(TWICE.as_fold(F.col("frames"))))
    rows = validate.violations_of_rows(event_frames(spark, sf_dir), own=[TWICE]).where(F.col("rule") == TWICE.name)
    return fold.select(F.lit("fold").alias("form"), "id", "frame_index").union(rows.select(F.lit("window"), "id", "frame_index"))


@query("SELECT 's_tool_' || s_suppkey AS standard_tool_name, 'S Tool-' || s_suppkey AS tool_name, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS description FROM supplier")
def tool_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools' files by category; of two with one standard name the last by path counts."""
    n = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(n.cast("string").alias("id"), _json("S Tool-", n.cast("string")).alias("tool_name"), F.when(n % 2 == 0, F.col("s_name")).alias("tool_description"))
    at = scratch(spark, "tools")
    keyed.files(rows.withColumn("tool_description", F.lit("earlier")), f"{at}/a")
    keyed.files(rows, f"{at}/b")
    return readers.tool_files(spark, at)


@query("SELECT p_partkey % 5 AS kind, count(*) AS n, min(p_partkey) AS first FROM part WHERE p_partkey % 5 > 1 GROUP BY 1")
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no trajectory are set aside with their reason, and end no load."""
    k, key = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    good = _json('{"id": ', key, ', "domain": "d", "frames": [{"type": "goal", "content": "g"}]}')
    line = F.when(k == 0, good).when(k == 1, "  ").when(k == 2, _json('{"id": ', key, "}")).when(k == 3, _json("[", key, "]")).otherwise(_json('{"id": ', key, ", "))
    at = scratch(spark, "lines")
    writers.append_lines(table(spark, sf_dir, "part").select(line.alias("line")), at)
    _, bad = readers.trajectories(spark, at)
    kind = F.when(F.col("error").startswith("no frames, domain"), 2).when(F.col("error") == "not an object", 3).when(F.col("error").startswith("json: "), 4)
    return bad.select(kind.cast("long").alias("kind"), F.regexp_extract("line", r"(\d+)", 1).cast("long").alias("key")).groupBy("kind").agg(F.count("*").alias("n"), F.min("key").alias("first"))


@query(
    f"""WITH {EVENT_FRAMES_SQL}, k AS (SELECT CASE t WHEN 'taction' THEN 'action' ELSE t END AS type, count(*) AS n FROM t GROUP BY 1),
w(type, token_id, owner, marker) AS (VALUES ('goal', 128002, 'runtime', '<|goal|>'), ('belief', 128011, 'model', '<|belief|>'), ('action', 128014, 'model', '<|action|>'), ('end', 128015, 'model', '<|end|>'), ('result', 128016, 'runtime', '<|result|>'), ('feedback', 128017, 'runtime', '<|feedback|>'))
SELECT k.type, token_id, owner, marker, n FROM k JOIN w ON k.type = w.type"""
)
def counted_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = event_frames(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    return kinds.join(schema.frame_types(spark), "type").select("type", "token_id", "owner", "marker", "n")


@query("SELECT p_partkey, unnest(['goal', 'mission']) AS type, unnest(['\"' || p_brand || '\"', '\"' || p_name || '\"']) AS json FROM part")
def preludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(suites.prelude(F.col("p_brand"), F.col("p_name"))).alias("f"))
    return rows.select("p_partkey", "f.type", "f.json")


@query(f"WITH {EVENT_FRAMES_SQL} SELECT id, string_agg('{{\"tool\": \"' || CASE t WHEN 'taction' THEN 'answer' ELSE 'bash' END || '\", \"text\": \"e' || event_id || '\"}}', ' ' ORDER BY i) AS said FROM t WHERE t IN ('action', 'taction') GROUP BY id")
def acted_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = event_arrays(spark, sf_dir).select("id", F.array_join(suites.action_contents(F.col("frames")), " ").alias("said"))
    return said.where("said <> ''")


@query("SELECT p_partkey, '{\"a\": [' || p_size || ', {\"x\": null, \"y\": 1.5}], \"b\": \"\\u00e9' || p_brand || '\"}' AS said FROM part")
def sorted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _json('{"b":"é', F.col("p_brand"), '", "a" : [', F.col("p_size").cast("string"), ',{"y":1.50,"x":null}]}')
    return table(spark, sf_dir, "part").select("p_partkey", pyjson.dumps_sorted(given).alias("said"))


@query(
    """WITH c AS (SELECT o_orderkey, o_orderkey % 3 > 0 AS good FROM orders)
SELECT (SELECT count(*) FROM c) AS n, (SELECT count(*) FILTER (good) FROM c) AS fit, least(40, (SELECT count(*) FILTER (good) FROM c)) AS chosen, o_orderkey AS id FROM c WHERE good ORDER BY sha1(o_orderkey || '|42'), o_orderkey::VARCHAR LIMIT 40"""
)
def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of the rows that can be evaluated, with the counts that a report names; a sampling operator."""
    rows, n, fit, chosen = suites.evaluation_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), F.col("id") % 3 > 0, 40)
    return rows.select(F.lit(n).cast("long").alias("n"), F.lit(fit).cast("long").alias("fit"), F.lit(chosen).cast("long").alias("chosen"), "id")


@query(
    """SELECT 'i_' || o_orderkey AS task_id, 'swe_bench_lite' AS domain, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 2 = 1 END AS success, o_orderkey % 9 AS total_tokens, (o_orderkey % 3)::VARCHAR AS iterations, (o_orderkey % 5 > 0)::VARCHAR AS submitted FROM orders"""
)
def suite_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite's rows and their report as task results."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        _json("i_", k.cast("string")).alias("instance_id"), F.lit("submitted").alias("stopped_on"), (k % 3).alias("iterations"), F.when(k % 5 > 0, "diff").alias("model_patch"), (k % 9).alias("prompt_tokens"), F.lit(0).alias("generated_tokens"), F.lit(1.0).alias("inference_sec")
    )
    report = table(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").select(_json("i_", k.cast("string")).alias("id"), (k % 2 == 1).alias("resolved"))
    tasks, _ = suites.Suite("swe", lambda _: report, suites.patches).run(rows)
    return tasks.select("task_id", "domain", "success", "tokens.total_tokens", F.col("metrics")["iterations"].alias("iterations"), F.col("metrics")["submitted"].alias("submitted"))
