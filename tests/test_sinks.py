"""What is written, and lookups that read no more than they need."""

import json
import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import checks, lookups, vectors
from frameloom.sources import keyed, writers
from frameloom.streaming import append

ROWS = [{"id": f"i{n}", "ok": n % 2 == 0, "said": None if n % 3 == 0 else f"é\n\"{n}\"", "tools": [{"n": n, "x": [1.5, None]}]} for n in range(23)]


def rows(spark, given=ROWS):
    data = [(r["id"], r["ok"], r["said"], json.dumps(r["tools"])) for r in given]
    return spark.createDataFrame(data, "id string, ok boolean, said string, tools string").repartition(4)


def listing(path):
    return sorted(p.name for p in path.iterdir() if not p.name.endswith(".crc")) if path.exists() else []


@pytest.mark.parametrize("newline", [False, True])
def test_a_file_for_each_id(spark, tmp_path, newline):
    at = tmp_path / "out" / "m"
    writers.result_files(rows(spark), str(at), json_columns=("tools",), newline=newline)
    assert {p.name: p.read_text() for p in at.iterdir()} == {f"{r['id']}.json": json.dumps(r, indent=2) + "\n" * newline for r in ROWS}
    changed = [ROWS[0] | {"said": "new"}]
    writers.result_files(rows(spark, changed + changed), str(at), json_columns=("tools",), newline=newline)
    assert len(listing(at)) == 23 and json.loads((at / "i0.json").read_text())["said"] == "new"
    assert listing(tmp_path / "out") == ["m"]


@pytest.mark.parametrize("bad", ["a/b", "", ".x", None])
def test_a_write_that_fails_leaves_nothing(spark, tmp_path, bad):
    with pytest.raises(Exception, match="can't be a file's name"):
        keyed.files(rows(spark, [*ROWS, ROWS[0] | {"id": bad}]), str(tmp_path / "out" / "m"))
    assert listing(tmp_path / "out") == []


def test_one_object(spark, tmp_path):
    at = tmp_path / "o" / "G1.json"
    keyed.one_object(rows(spark), str(at), json_columns=("tools",), newline=True)
    assert at.read_text() == json.dumps({r["id"]: r for r in sorted(ROWS, key=lambda r: r["id"])}, indent=2) + "\n"
    values = {"b": [1, {"x": "é"}], "a": None, "c": "7", "d": {}}
    writers.converted(spark.createDataFrame([(k, json.dumps(v)) for k, v in values.items()], "id string, value string"), str(at))
    assert at.read_text() == json.dumps(dict(sorted(values.items())), indent=2)
    writers.converted(spark.createDataFrame([], "id string, value string"), str(at))
    assert at.read_text() == "{}" and listing(tmp_path / "o") == ["G1.json"]


def test_predictions(spark, tmp_path):
    at = tmp_path / "p" / "preds.json"
    writers.predictions(spark.createDataFrame([("b", "diff"), ("a", None)], "instance_id string, model_patch string"), str(at), "m")
    want = {k: {"model_name_or_path": "m", "instance_id": k, "model_patch": v} for k, v in (("a", ""), ("b", "diff"))}
    assert at.read_text() == json.dumps(want, indent=2) + "\n"


def test_merges_in_place(spark, tmp_path):
    at = str(tmp_path / "t")
    make = lambda *r: spark.createDataFrame(list(r), "id string, v int, pos int")
    got = lambda df: sorted((r["id"], r["v"]) for r in df.collect())
    assert writers.current(spark, at) is None
    assert got(writers.merge_at(make(("a", 1, 0), ("b", 2, 1), ("a", 3, 2)), at)) == [("a", 3), ("b", 2)]
    new = make(("b", 9, 0), ("c", 4, 1))
    for _ in range(3):  # a rerun changes nothing
        assert got(writers.merge_at(new, at)) == [("a", 3), ("b", 9), ("c", 4)]
    broken = tmp_path / "t" / "version=9"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("half")
    assert got(writers.current(spark, at)) == [("a", 3), ("b", 9), ("c", 4)] and len(listing(tmp_path / "t")) == 3
    (tmp_path / "t" / "version=4").mkdir()
    (tmp_path / "t" / "version=4" / "part-0.parquet").write_text("half")
    assert got(writers.merge_at(make(("d", 5, 0)), at)) == [("a", 3), ("b", 9), ("c", 4), ("d", 5)]


def test_lines_are_appended_until_there_are_so_many(spark, tmp_path):
    source, at, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    source.mkdir()

    def run(target):
        append.append_until(spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(source)).withColumnRenamed("value", "line"), at, checkpoint, target).awaitTermination()
        return [r["value"] for r in spark.read.text(at).collect()]

    for n in range(3):
        (source / f"{n}.txt").write_text("".join(f"{n}-{i}\n" for i in range(10)))
    assert sorted(run(25)) and len(run(25)) == 25 and append.appended(spark, at) == {0: 10, 1: 10, 2: 5}
    (source / "3.txt").write_text("late\n")
    assert len(run(25)) == 25
    # a batch that the stream has not committed, but that has been written, is not written again
    (source / "4.txt").write_text("x\ny\n")
    (tmp_path / "out" / "batch=4" / "lines=2").mkdir(parents=True)
    (tmp_path / "out" / "batch=4" / "lines=2" / "part-0.txt").write_text("x\ny\n")
    assert len(run(40)) == 27
    (source / "5.txt").write_text("z\n")
    (tmp_path / "out" / ".batch-5").mkdir()  # left by a run that was broken off
    assert len(run(None)) == 28 and append.appended(spark, at)[5] == 1


def test_cache_lookups_read_their_folders_alone(spark, tmp_path):
    at = str(tmp_path / "cache")
    calls = spark.range(400).select(F.lit("c").alias("category"), F.lit("t").alias("tool"), F.lit("a").alias("api"), F.format_string('{"n": %d}', "id").alias("tool_input"), "id")
    key = lookups.cache_key(*(F.col(c) for c in ("category", "tool", "api", "tool_input")))
    lookups.keep_answers(calls.where("id < 300").select(key.alias("key"), F.lit(None).cast("string").alias("error"), F.col("id").cast("string").alias("response")), at)
    some = calls.where("id in (5, 7, 350)")
    hits, misses = lookups.looked_up(some, at)
    assert {(r["id"], r["error"], r["response"]) for r in hits.collect()} == {(5, "", "5"), (7, "", "7")} and [r["id"] for r in misses.collect()] == [350]
    read = lookups.cache_at(spark, at, some.select(key.alias("key")))
    plan = read._jdf.queryExecution().executedPlan().toString()
    scan = read._jdf.queryExecution().sparkPlan().collectLeaves().head()
    assert "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0]
    read.collect()
    assert scan.selectedPartitions().totalNumberOfFiles() <= 3 < len(spark.read.parquet(at).inputFiles())


def test_suffixes(spark):
    rng = random.Random(2)
    functions = ["".join(rng.choices("ab_", k=rng.randint(0, 6))) for _ in range(300)]
    names = list({"".join(rng.choices("ab_", k=rng.randint(0, 4))) for _ in range(60)} | {"zz", ""}) + ["a", "a"]
    ranked = spark.createDataFrame([*((f, i) for i, f in enumerate(functions)), (None, -1)], "function string, rank int")
    out = lookups.suffix_join(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), ranked)
    want = {n: next((f for f in functions if f.endswith(n)), None) for n in names}
    got = [tuple(r) for r in out.collect()]
    assert dict(got) == want | {None: None} and len(got) == len(names) + 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_many_functions(spark):
    functions = spark.range(100_000).select(F.concat(F.lit("tool_"), F.col("id").cast("string"), F.lit("_for_api_"), (F.col("id") % 1000).cast("string")).alias("function"), F.col("id").alias("rank"))
    names = spark.range(2000).select(F.concat(F.lit("_for_api_"), F.col("id").cast("string")).alias("name"))
    got = lookups.suffix_join(names, functions)
    assert got.where("found is not null").count() == 1000 and got.where("name = '_for_api_7'").first()["found"] == "tool_7_for_api_7"


def test_seeds(spark):
    vocabulary = spark.createDataFrame([(" think", 1), (" rea", 2), (" r", 3), ("son", 4), ("rea", 5), ("s", 6), ("think", 7), (" ", 8), ("er", 9), ("think", 70)], "piece string, row_id int")
    targets = spark.createDataFrame([("one", "think", 0), ("one", "think", 1), ("one", "reason", 2), ("none", "reason", 0), ("none", "rest", 1), ("lost", "qqq", 0), ("gone", "", 0)], "target string, word string, pos int")
    rows_of = lambda df: sorted((r["target"], r["row_id"]) for r in df.collect())
    assert rows_of(vectors.seeds(targets, vocabulary)) == [("gone", 8), ("lost", 8), ("none", 2), ("one", 1), ("one", 1)]
    assert rows_of(vectors.seeds(targets, vocabulary, single=False)) == [("none", 4), ("none", 5), ("none", 6), ("one", 4), ("one", 5), ("one", 7), ("one", 7)]
    cut = {r["word"]: r["row_ids"] for r in vectors.longest_match(spark.createDataFrame([("reasoner",), ("xthinks",), ("",), (None,), ("reason",)], "word string"), vocabulary).collect()}
    assert cut == {"reasoner": [5, 4, 9], "xthinks": [7, 6], "": [], "reason": [5, 4]}


def test_expectations_ride_along(spark, tmp_path):
    given = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, v int")
    pins = lookups.pinned(spark, ["b", "a"])
    wanted = checks.pinned(given, pins, order="v")
    assert sorted((r["id"], r["v"]) for r in wanted.table().select("id", "v").collect()) == [("a", 1), ("b", 3)] and wanted.verify() == 2
    lost = checks.pinned(given, lookups.pinned(spark, ["z", "a", "y"]))
    lost.table().write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="missing ids: 2 rows, 'y' to 'z'"):
        lost.verify()
    few = checks.Expected(given, count=45)
    few.table().count()
    with pytest.raises(ValueError, match="expected 45 rows, got 3"):
        few.verify()
    kept = checks.kept_categories(given, F.col("id"), ["a"], also=F.col("v") == 3)
    assert [tuple(r) for r in kept.collect()] == [("b", 2)] and checks.kept_categories(given, F.col("id")).count() == 3
    (tmp_path / "here").write_text("")
    assert checks.present(spark, str(tmp_path), "here") == str(tmp_path)
    with pytest.raises(FileNotFoundError, match="gone"):
        checks.present(spark, str(tmp_path), "here", "gone")
    assert [r[0] for r in spark.createDataFrame([("chatml",), ("x",)], "f string").select(checks.method_name(F.col("f"), "A", "B")).collect()] == ["A", "B"]
