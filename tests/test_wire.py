"""C02-C04, F03-F07."""

import json

from helpers import frame_table, frames_of, one
from pyspark.sql import functions as F

from frameloom.functions import pyjson, schema
from frameloom.operators import wire


def parsed(spark, texts, **options):
    df = spark.createDataFrame(list(texts.items()), "id string, w string")
    return {r["id"]: r for r in wire.parse(df, "w", **options).collect()}


def test_cases(spark):
    got = parsed(spark, {
        "one": "<|goal|>Hello world", "json": '  <|action|> {"tool": "x", "b": 1} <|end|>', "n": "<|reward|>0.75<|reward|> -1.5 ", "bad": "<|action|>{x", "nan": "<|reward|>not_a_number", "empty": "<|result|> <|reward|> ",
        "before": "hi <|goal|>x", "blank": " \n", "none": None, "reserved": "<|reserved_special_token_0|>a<|reserved_special_token_10|>1<|reserved_special_token_1|>b", "lead": "<|goal|>  kept \n", "quote": "it's \n x",
    })
    kinds = {k: [f["type"] for f in r["frames"]] for k, r in got.items()}
    assert kinds == {"one": ["goal"], "json": ["action", "end"], "n": ["reward", "reward"], "bad": ["action"], "nan": ["reward"], "empty": ["result", "reward"], "before": [], "blank": [], "none": [], "reserved": ["goal", "reward", "mission"], "lead": ["goal"], "quote": []}
    assert got["json"]["frames"][0]["tool"] == "x" and got["json"]["frames"][0]["args"] == '{"b": 1}'
    assert [f["json"] for f in got["n"]["frames"]] == ["0.75", "-1.5"]
    assert got["bad"]["frames"][0]["kind"] == "null" and got["bad"]["frames"][0]["error"].startswith("invalid json: ") and "at pos 1" in got["bad"]["frames"][0]["error"]
    assert [f["error"] for f in got["empty"]["frames"]] == ["empty json payload", "empty reward payload"] and got["nan"]["frames"][0]["error"].startswith("invalid number")
    assert got["before"]["parse_error"] == "expected frame marker at offset 0, got: 'hi <|goal|>x'" and got["quote"]["parse_error"].endswith('got: "it\'s \\\\n x"')
    assert got["blank"]["parse_error"] is None and got["none"]["parse_error"] is None and got["lead"]["frames"][0]["text"] == "  kept"


def test_strict(spark):
    got = parsed(spark, {"r": "<|think|>a<|result|>{}", "m": "<|think|>a<|end|>"}, strict=True)
    assert got["r"]["parse_error"] == "runtime-owned marker '<|result|>' found in model output" and got["m"]["parse_error"] is None and len(got["m"]["frames"]) == 2


def test_render_and_back(spark):
    rows = {"all": frames_of("gmobpkaterf"), "falsy": [{"type": "reward", "content": 0.0}, {"type": "goal", "content": None}, {"type": "reward", "content": 0.75}], "json": [{"type": "action", "content": {"z": "é<", "a": 1.0}}]}
    text = one(frame_table(spark, rows).withColumn("w", wire.render(F.col("frames"))), "w")
    assert text["falsy"] == "<|reserved_special_token_10|><|reserved_special_token_0|><|reserved_special_token_10|>0.75"
    assert text["json"] == '<|reserved_special_token_6|>{"z": "é<", "a": 1.0}'
    back = parsed(spark, {"all": text["all"]})["all"]["frames"]
    assert [f["type"] for f in back] == [f["type"] for f in rows["all"]] and json.loads(back[6]["json"]) == rows["all"][6]["content"]


def test_ingest(spark):
    df = spark.createDataFrame([(k,) for k in ('[{"type": "<|goal|>", "content": "x"}]', '[{"type": "nope"}]', "[{}]", "{}", None, '[{"type": "action", "content": {"a": 1, "a": 2, "n": NaN}}]', '[{"type":"goal","content":"a"}] x')], "j string")
    got = [r["x"] for r in df.select(pyjson.ingest_frames(F.col("j")).alias("x")).collect()]
    assert got[0]["frames"][0]["type"] == "goal" and "nope" in got[1]["error"] and got[2]["error"] and got[3]["error"] and got[4]["error"] and got[6]["error"]
    assert json.loads(got[5]["frames"][0]["args"])["a"] == 2


def test_frame_types(spark):
    assert schema.frame_types(spark).count() == 11 and schema.reserved(3) == "<|reserved_special_token_3|>"
    f = spark.range(1).select(schema.frame("goal", F.lit('a"b\n')).alias("f")).first()["f"]
    assert json.loads(f["json"]) == 'a"b\n' and f["truthy"]
    odd = [chr(i) for i in range(1, 0x180)] + ["\\", "日本", "😀", "\u2028"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    assert all(json.loads(r["q"]) == r["t"] for r in df.select("t", schema.quote(F.col("t")).alias("q")).collect())
    assert spark.range(1).select(schema.quote(F.lit(None).cast("string")).alias("q")).first()["q"] is None


def test_trajectories_as_arrays(spark):
    from frameloom.operators import trajectory as t

    df = frame_table(spark, {"a": frames_of("gmkt")})
    f = F.col("frames")
    r = df.select(
        t.types(t.extend(f, t.part(f, -1), F.lit(None).cast(df.schema["frames"].dataType))).alias("x"), t.types(t.append(f, schema.frame("end"))).alias("y"), *(t.types(t.part(f, *p)).alias(n) for n, p in {"p": (1, 3), "q": (-2,), "r": (3, 1), "s": (0, -1), "u": (9,)}.items()),
        t.owners(f).alias("o"), t.same(f, t.part(f)).alias("same"), t.same(f, t.part(f, 1)).alias("other"), t.to_json(f).alias("j"),
    ).first()
    all_types = ["goal", "mission", "think", "action"]
    assert r["x"] == [*all_types, "action"] and r["y"] == [*all_types, "end"] and (r["p"], r["q"], r["r"], r["s"], r["u"]) == (all_types[1:3], all_types[2:], [], all_types[:-1], [])
    assert r["o"] == ["runtime", "runtime", "model", "model"] and r["same"] is True and r["other"] is False and json.loads(r["j"]) == frames_of("gmkt")
