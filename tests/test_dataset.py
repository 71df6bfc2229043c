"""S01-S05, K01-K09, P01-P06, W01, W02, A04, A05, O01-O03, F01, F02, F19-F29."""

import json

import pytest
from helpers import frame_table, frames_of
from pyspark.sql import functions as F

from frameloom.functions import text
from frameloom.operators import dataset
from frameloom.sources import readers, writers


def column(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r["x"] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_python_white_space(spark):
    odd = ["A  b", " a B ", "a b", "a \u0085b", "a\x1cb", "İ x", "ΑΣ"]
    assert column(spark, odd, text.collapse) == [" ".join(x.lower().split()) for x in odd]
    assert column(spark, [" a \n", "\x1fb ", ""], text.strip) == ["a", "b", ""] and column(spark, ["  a \n"], text.rstrip) == ["  a"]


def test_python_numbers(spark):
    given = ["1_000", " 1.5\n", ".5", "5.", "1e3", "-inf", "1.5d", "0x1p3", "1__0", "_1", "", "+2", "Infinity", "1e"]

    def python(x):
        try:
            return float(x)
        except ValueError:
            return None

    assert column(spark, given, text.to_float) == [python(x) for x in given]
    assert column(spark, ["3/4", "1/0", "x"], text.fraction) == [75.0, None, None]


def test_small_texts(spark):
    assert column(spark, ["Get-Weather!!", "2nd Tool", "a__b", "工具^x"], text.identifier) == ["get_weather", "get_2nd_tool", "a_b", "工具^x"]
    assert column(spark, ["class", "klass"], text.safe_name) == ["is_class", "klass"]
    assert column(spark, ["f(x)", "", " (", None], text.called_tool) == ["f", "unknown", "unknown", "unknown"]
    assert column(spark, ["Rate limit error...", "Message error...", "", None], text.status_code) == [10, 11, 0, 0]
    assert column(spark, ["a\nb", "x" * 301], text.preview) == ["a\\nb", "x" * 300 + "..."]
    long = "a" * 5000 + "b" * 15000
    shown = column(spark, [long, "ok"], lambda t: text.command_output(t, F.lit(None), F.lit(" ")))
    assert shown[0].split("\n")[2:6] == ["<output_head>", "a" * 5000 + "</output_head>", "<elided_chars>10000 characters elided</elided_chars>", "<output_tail>"] and shown[1] == "<returncode>-1</returncode>\n<output>\nok</output>"


def test_deduplicate_keeps_the_first(spark):
    rows = [(3, "A  b"), (1, " a B "), (2, "a b"), (4, "c"), (5, None), (6, None)]
    got = dataset.deduplicate(spark.createDataFrame(rows, "pos int, t string").repartition(3), F.col("t"), "pos")
    assert sorted(r["pos"] for r in got.collect()) == [1, 4, 5, 6]


@pytest.mark.parametrize("sizes", [{"a": 9, "b": 10, "c": 30, "d": 50, "e": 70, None: 12}])
def test_split_sizes(spark, sizes):
    rows = [(f"{d}{i}", d) for d, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, domain string")
    got = dataset.split(df.repartition(5)).collect()
    n_eval = {d: sum(r["domain"] == d and r["split"] == "eval" for r in got) for d in sizes}
    assert n_eval == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 4, None: 1} and len(got) == len(rows)
    again = dataset.split(df.repartition(2))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got), key=str)
    assert {tuple(r) for r in dataset.split(df, seed=1).collect()} != {tuple(r) for r in got}


def test_split_of_a_large_domain(spark):
    df = spark.range(30_000).select(F.col("id").cast("string").alias("id"), F.lit("one").alias("domain"))
    got = dataset.split(df)
    assert got.where("split = 'eval'").count() == 1500 and got.count() == 30_000
    import hashlib

    smallest = sorted(range(30_000), key=lambda i: (hashlib.sha1(f"{i}|42".encode()).hexdigest()[:13], str(i)))[:1500]
    assert {int(r["id"]) for r in got.where("split = 'eval'").collect()} == set(smallest)


def test_sample(spark):
    df = spark.createDataFrame([(str(i),) for i in range(20)], "id string")
    a = [r["id"] for r in dataset.sample(df, 5, 99).collect()]
    assert a == sorted(a) and len(a) == 5 and a == [r["id"] for r in dataset.sample(df.repartition(4), 5, 99).collect()]
    assert dataset.sample(df, None).count() == dataset.sample(df, 50).count() == 20 and dataset.sample(df, 0).count() == 0
    with pytest.raises(ValueError):
        dataset.sample(df, -1)


def test_mission_and_prompts(spark):
    df = frame_table(spark, {"a": frames_of("gomkt"), "none": frames_of("g"), "odd": [{"type": "mission", "content": 5}, {"type": "mission", "content": "x"}]})
    got = {r["id"]: r for r in df.select("id", dataset.mission(F.col("frames")).alias("m"), F.size(dataset.prompt_frames(F.col("frames"))).alias("p"), dataset.evaluable(F.col("frames")).alias("e")).collect()}
    assert [got[k]["m"] for k in ("a", "none", "odd")] == ["mission text", None, None] and [got[k]["p"] for k in ("a", "none")] == [3, 1] and [got[k]["e"] for k in ("a", "none")] == [True, False]


LINES = [
    json.dumps({"id": 1, "domain": "a", "frames": frames_of("gmt"), "extra": 1}), "", "{bad", json.dumps({"id": "2", "frames": []}), json.dumps({"id": "3", "domain": "", "frames": frames_of("gma")}), "[]",
    json.dumps({"id": "4", "domain": None, "frames": frames_of("gmtr"), "messages": [{"role": "user", "content": "own"}]}), json.dumps({"id": "5", "domain": "b", "frames": [{"type": "zz"}]}), " ".join(["x", json.dumps({"id": "6", "domain": "b", "frames": frames_of("Gmt".lower())}, ensure_ascii=False)]),
]


def test_from_json_lines_to_a_dataset(spark, tmp_path):
    path = tmp_path / "raw.jsonl"
    path.write_text("\n".join(LINES), encoding="utf-8")
    rows, bad = readers.trajectories(spark, str(path))
    assert {r["error"].split(":")[0] for r in bad.collect()} == {"json", "no domain", "not an object"} and bad.count() == 4
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {"1", "3", "4", "5", "6"} and got["3"]["domain"] == got["4"]["domain"] == "unknown" and got["5"]["error"]
    assert [m["content"] for m in got["4"]["messages"]] == ["own"] and [m["role"] for m in got["1"]["messages"]] == ["system", "user", "assistant"]
    kept, rejected = dataset.clean(rows, "pos")
    assert sorted(r["id"] for r in kept.collect()) == ["1"]  # 4 and 6 repeat its mission
    assert {r["id"]: r["reason"][:30] for r in rejected.collect()} == {"3": "validation: [unresolved_action", "5": "construct: unknown frame type "}
    writers.dataset(kept, str(tmp_path / "out"))
    back = readers.dataset(spark, str(tmp_path / "out"), "train").first()
    assert json.loads(back["frames"]) == [f for f in frames_of("gmt")] and back["num_frames"] == 3 and json.loads(back["messages"])[0]["role"] == "system"


def test_histogram(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(["b", "a", "a", "b", "c", None])], "pos int, reason string")
    assert [tuple(r) for r in dataset.histogram(df, "reason", "pos", 2).collect()] == [("b", 2), ("a", 2)]


def test_lines_of_generated_text(spark, tmp_path):
    df = spark.createDataFrame([('x\n {"a": 1} \n{"a": 1} x\n[1]\n{"n": NaN}',)], "t string")
    assert sorted(r["line"] for r in readers.trajectory_lines(df, "t").collect()) == ['{"a": 1}', '{"n": NaN}']
    out = str(tmp_path / "lines")
    assert readers.count_lines(spark, out) == 0
    more = spark.createDataFrame([(f"l{i}",) for i in range(5)], "line string")
    assert writers.append_lines(more, out, target=8) == 3 and writers.append_lines(more, out, target=8) == 0 and readers.count_lines(spark, out) == 8
    assert writers.append_lines(more, out, target=8) == 0 and readers.count_lines(spark, out) == 8
