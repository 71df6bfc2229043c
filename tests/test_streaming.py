"""Streaming forms against their batch forms."""

from pyspark.sql import functions as F

from frameloom.operators import validate
from frameloom.streaming import validate as streaming


def rows():
    return [(f"t{k}", i, c) for k in range(4) for i, c in enumerate(["goal", "mission", "action", "belief", "result", "result", "end"][: 3 + k])]


def write(spark, tmp_path, parts, schema):
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def drain(df, spark, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table("out").collect()


def test_violations_over_batches(spark, tmp_path):
    data = [(a, i, c, False) for a, i, c in rows()]
    schema = "id string, ts int, type string, terminal boolean"
    stream = write(spark, tmp_path, [[d for d in data if d[1] < 3], [d for d in data if d[1] >= 3]], schema)
    got = sorted(map(tuple, drain(streaming.violations(stream), spark, tmp_path)))
    batch = validate.violations_of_rows(spark.createDataFrame(data, schema), "id", "ts", allow_unresolved=True)
    assert got == sorted(map(tuple, batch.collect())) and got


def test_a_users_rule_is_the_same_in_all_forms(spark, tmp_path):
    """Previous frames of an earlier batch count, first frames have none, and a null condition breaks nothing."""
    twice = validate.OwnRule("twice", lambda previous, kind, index, terminal: (previous == kind) | terminal, "again")
    first = validate.OwnRule("first", lambda previous, kind, index, terminal: previous.isNull() & (index == 0) & (kind != "goal"))
    data = [(f"t{k}", i, c, c == "action" and i % 2 == 0) for k, kinds in enumerate(["goal goal action action result result", "result", "belief belief belief end end", "goal mission action action"]) for i, c in enumerate(kinds.split())]
    schema = "id string, ts int, type string, terminal boolean"
    stream = write(spark, tmp_path, [[d for d in data if d[1] < 1], [d for d in data if 1 <= d[1] < 4], [d for d in data if d[1] >= 4]], schema)
    spark.sql("DROP VIEW IF EXISTS out")
    got = sorted(map(tuple, drain(streaming.violations(stream, own=[twice, first]), spark, tmp_path)))
    df = spark.createDataFrame(data, schema)
    batch = sorted(map(tuple, validate.violations_of_rows(df, "id", "ts", allow_unresolved=True, own=[twice, first]).collect()))
    assert got == batch and {r for _, r, _ in got} >= {"twice", "first", "missing_goal"}
    tool = F.when(F.col("terminal"), "answer")
    frames = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ts", F.struct("type", tool.alias("tool")).alias("f")))).alias("o")).select("id", F.transform("o", lambda x: x["f"]).alias("frames"))
    fold = frames.select("id", F.explode(validate.violations(F.col("frames"), True, [*validate.STRUCTURAL_RULES, twice.as_fold, first.as_fold])).alias("v")).select("id", "v.rule", "v.frame_index")
    assert sorted(map(tuple, fold.collect())) == batch


def test_windows_and_first_mentions(spark, tmp_path):
    data = [(f"2024-01-01 0{h}:{m}0:00", k, t) for h, m, k, t in [(0, 1, "a", "X y"), (0, 2, "a", "x  Y"), (1, 0, "b", "z"), (3, 0, "a", "q")]]
    df = spark.createDataFrame(data, "s string, event_type string, text string").select(F.to_timestamp("s").alias("ts"), "event_type", "text")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {(str(r["start"]), r["kind"]): r["n"] for r in drain(streaming.counts(stream), spark, tmp_path, "complete")}
    assert got == {("2024-01-01 00:00:00", "a"): 2, ("2024-01-01 01:00:00", "b"): 1, ("2024-01-01 03:00:00", "a"): 1}
    spark.sql("DROP VIEW IF EXISTS out")
    (tmp_path / "b").mkdir()
    assert len(drain(streaming.first_mentions(stream, "text"), spark, tmp_path / "b")) == 3
