"""V00-V09, W05-W07, P01, F30."""

import random

import pytest
from helpers import BASH, frame_table, frames_of
from pyspark.sql import functions as F

from frameloom.operators import validate
from frameloom.streaming.validate import START, walk

CASES = {
    "": [], "gmt": [], "gmtr": [], "gmarbt": [], "gomt": [], "gmtmt": [], "gma": [("unresolved_action", 2)], "gmab": [("unresolved_action", 2)] * 2, "gmr": [("opening_prelude", 2), ("orphan_result", 2)],
    "gmaaarrrbtr": [], "gmaaarr": [("unresolved_action", 2)], "gmatr": [], "gmaarrr": [("orphan_result", 6)], "gmwtr": [("opening_prelude", 2), ("premature_runtime_frame", 2)],
    "gmftr": [("opening_prelude", 2), ("premature_runtime_frame", 2)], "mtr": [("missing_goal", 0)], "ogmtr": [("missing_goal", 0)], "gmaerte": [], "gemt": [("opening_prelude", 1), ("misplaced_end", 1)],
    "bgmt": [("missing_goal", 0)], "gmaea": [("orphan_action", 2), ("unresolved_action", 2)], "ab": [("missing_goal", 0), ("unresolved_action", 1), ("unresolved_action", 1)], "gmtrr": [("orphan_result", 4)], "gmaeer": [("misplaced_end", 4)],
}


def found(spark, sequences, **options):
    df = frame_table(spark, {s: frames_of(s) for s in sequences})
    return {r["id"]: [(v["rule"], v["frame_index"]) for v in r["v"]] for r in df.select("id", validate.violations(F.col("frames"), **options).alias("v")).collect()}


def test_rules_one_by_one(spark):
    assert found(spark, CASES) == CASES


def test_actions_may_stay_open_at_the_end(spark):
    assert found(spark, ["gma", "gmab"], allow_unresolved=True) == {"gma": [], "gmab": [("unresolved_action", 2)]}


def test_messages_and_their_text(spark):
    df = frame_table(spark, {"x": frames_of("mwe")})
    shown = df.select(F.transform(validate.violations(F.col("frames")), validate.shown).alias("v")).first()["v"]
    assert shown == [
        "[missing_goal] frame 0: trajectory must begin with <|goal|>, got <|mission|>",
        "[opening_prelude] frame 1: unexpected <|reward|> before any model frame (expected goal/mission/obs)",
        "[opening_prelude] frame 2: end frame before any model frame",
        "[misplaced_end] frame 2: end must follow a model turn frame, got <|reward|>",
        "[premature_runtime_frame] frame 1: <|reward|> appears before any action",
    ]


def test_null_frames_and_added_rules(spark):
    df = spark.createDataFrame([("a",)], "id string").withColumn("frames", F.lit(None).cast(frame_table(spark, {"a": []}).schema["frames"].dataType))
    assert df.select(validate.violations(F.col("frames")).alias("v")).first()["v"] == []
    extra = lambda frames: F.array(F.struct(F.lit("mine").alias("rule"), F.lit(7).alias("frame_index"), F.lit("").alias("message")))
    assert [v["rule"] for v in frame_table(spark, {"a": frames_of("gmt")}).select(validate.violations(F.col("frames"), rules=(*validate.STRUCTURAL_RULES, extra)).alias("v")).first()["v"]] == ["mine"]


@pytest.mark.parametrize("content, crashes", [(5, True), ([], False), ("x", True), (None, False), (BASH, False), (0, False)])
def test_actions_without_keys_crash(spark, content, crashes):
    df = frame_table(spark, {"a": [{"type": "action", "content": content}]})
    assert df.select(validate.crashes(F.col("frames")).alias("c")).first()["c"] is crashes


def test_fold_windows_and_stream_agree(spark):
    rng = random.Random(2)
    sequences = {"".join(rng.choices("gmobpkaaatrrrefw", k=rng.randint(1, 14))) for _ in range(800)}
    fold = {(s, *v) for s, vs in found(spark, sequences).items() for v in vs}
    rows = [(s, i, f["type"], c == "t") for s in sequences for i, (c, f) in enumerate(zip(s, frames_of(s), strict=True))]
    windows = {tuple(r) for r in validate.violations_of_rows(spark.createDataFrame(rows, "id string, i int, type string, terminal boolean")).collect()}
    assert fold == windows
    for s in sequences:
        kinds = [(f["type"], c == "t") for c, f in zip(s, frames_of(s), strict=True)]
        half = len(kinds) // 2
        state, first = walk(START, kinds[:half])
        _, second = walk(state, kinds[half:])
        assert {(s, *v) for v in first + second} == {(s, *v) for v in found_open(s)}


def found_open(s):
    """The rules over one sequence with actions left open at the end, by a walk of its own."""
    kinds, out, pending, since, acted, turn = [f["type"] for f in frames_of(s)], [], 0, None, False, False
    closers = {"belief", "plan", "think", "action"}
    if kinds[0] != "goal":
        out.append(("missing_goal", 0))
    for i, k in enumerate(kinds):
        if k in closers:
            break
        if k not in ("goal", "mission", "obs"):
            out.append(("opening_prelude", i))
    out += [("misplaced_end", i) for i, k in enumerate(kinds) if k == "end" and (i == 0 or kinds[i - 1] not in closers)]
    for i, k in enumerate(kinds):
        terminal = s[i] == "t"
        if k == "action":
            if pending and not turn:
                out.append(("orphan_action", since or i))
            turn = acted = True
            if not terminal:
                since, pending = (i if not pending else since), pending + 1
        elif k in closers:
            turn = True
            if pending:
                out.append(("unresolved_action", since or i))
        elif k == "result":
            turn = False
            if pending:
                pending -= 1
                since = since if pending else None
            elif s[:i].rstrip("e")[-1:] != "t":
                out.append(("orphan_result", i))
        elif k in ("feedback", "reward"):
            turn = False
            if not acted:
                out.append(("premature_runtime_frame", i))
        elif k == "end":
            turn = False
    return out
