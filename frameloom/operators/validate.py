"""Rules over the order of frames, in two forms that agree: a fold over an array column, and windows over exploded rows.

Both walk a trajectory once. The fold needs no shuffle and is the one to use where a trajectory is a
row; the windows serve rows that are stored one frame each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.schema import TERMINAL_TOOLS, TURN_CLOSERS, VIOLATION, lookup, marker

PRELUDE = ["goal", "mission", "obs"]
REASONING = ["belief", "plan", "think"]
_NONE = f"array<{VIOLATION}>"


def is_terminal(frame: Column) -> Column:
    """An action whose tool ends the run. Falsy content counts as an empty object."""
    return (frame["type"] == "action") & F.coalesce(frame["tool"].isin(TERMINAL_TOOLS), F.lit(False))


def crashes(frames: Column) -> Column:
    """Whether an action has content that is neither an object nor falsy, so that it has no tool to ask for."""
    return F.exists(frames, lambda f: (f["type"] == "action") & f["truthy"] & (f["kind"] != "object"))


def _violation(rule: str, index: Column, *message: Column | str) -> Column:
    text = F.concat(*(F.lit(m) if isinstance(m, str) else m for m in message))
    return F.struct(F.lit(rule).alias("rule"), index.cast("int").alias("frame_index"), text.alias("message"))


def _indexed(frames: Column) -> Column:
    return F.transform(frames, lambda f, i: F.struct(i.alias("i"), f["type"].alias("type"), is_terminal(f).alias("terminal")))


def _shown(kind: Column) -> Column:
    return F.concat(F.lit("<|"), kind, F.lit("|>"))


def missing_goal(frames: Column) -> Column:
    first = frames[0]["type"]
    found = F.array(_violation("missing_goal", F.lit(0), f"trajectory must begin with {marker('goal')}, got ", _shown(first)))
    return F.when(first != "goal", found).otherwise(F.array().cast(_NONE))


def cut_index(frames: Column, types: Sequence[str] = TURN_CLOSERS) -> Column:
    """Index of the first frame of these types; the number of frames if there is none."""
    at = F.array_position(F.transform(frames, lambda f: f["type"].isin(list(types))), True)
    return F.when(at > 0, at - 1).otherwise(F.size(frames)).cast("int")


def opening_prelude(frames: Column) -> Column:
    wrong = F.filter(F.slice(_indexed(frames), F.lit(1), cut_index(frames)), lambda x: ~x["type"].isin(PRELUDE))

    def say(x: Column) -> Column:
        text = F.when(x["type"] == "end", "end frame before any model frame").otherwise(F.concat(F.lit("unexpected "), _shown(x["type"]), F.lit(" before any model frame (expected goal/mission/obs)")))
        return _violation("opening_prelude", x["i"], text)

    return F.transform(wrong, say)


def misplaced_end(frames: Column) -> Column:
    before = lambda x: F.get(frames, x["i"] - 1)["type"]
    wrong = F.filter(_indexed(frames), lambda x: (x["type"] == "end") & ((x["i"] == 0) | ~before(x).isin(TURN_CLOSERS)))
    return F.transform(
        wrong, lambda x: _violation("misplaced_end", x["i"], F.when(x["i"] == 0, "trajectory cannot begin with end").otherwise(F.concat(F.lit("end must follow a model turn frame, got "), _shown(before(x)))))
    )


def _or_own(index: Column, own: Column) -> Column:
    """index, but own where it is null or 0: the first place counts as none."""
    return F.coalesce(F.nullif(index, F.lit(0)), own)


def action_walk(frames: Column, allow_unresolved: bool = False) -> Column:
    """Actions and results in one walk: what is pending, since when, and whether the model is at turn."""
    zero = F.struct(
        F.lit(0).alias("pending"), F.lit(None).cast("int").alias("since"), F.lit(False).alias("acted"), F.lit(False).alias("turn"), F.lit(False).alias("after_terminal"), F.array().cast(_NONE).alias("found"),
    )

    def step(s: Column, x: Column) -> Column:
        kind, i = x["type"], x["i"]
        action, result = kind == "action", kind == "result"
        opens = action & ~x["terminal"]
        at = _or_own(s["since"], i)
        one = (
            F.when(action & (s["pending"] > 0) & ~s["turn"], _violation("orphan_action", at, "non-terminal action emitted while previous batch unresolved"))
            .when(kind.isin(REASONING) & (s["pending"] > 0), _violation("unresolved_action", at, f"non-terminal action(s) not followed by {marker('result')} before next ", _shown(kind)))
            .when(result & (s["pending"] == 0) & ~s["after_terminal"], _violation("orphan_result", i, "result with no preceding unresolved non-terminal action"))
            .when(kind.isin("feedback", "reward") & ~s["acted"], _violation("premature_runtime_frame", i, _shown(kind), " appears before any action"))
        )
        pending = F.when(opens, s["pending"] + 1).when(result, F.greatest(s["pending"] - 1, F.lit(0))).otherwise(s["pending"])
        return F.struct(
            pending.alias("pending"),
            F.when(opens & (s["pending"] == 0), i).when(pending > 0, s["since"]).alias("since"),
            (s["acted"] | action).alias("acted"),
            F.when(kind.isin(TURN_CLOSERS), True).when(kind.isin("end", "result", "feedback", "reward"), False).otherwise(s["turn"]).alias("turn"),
            F.when(kind == "end", s["after_terminal"]).otherwise(x["terminal"]).alias("after_terminal"),
            F.when(one.isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(one))).alias("found"),
        )

    def finish(s: Column) -> Column:
        if allow_unresolved:
            return s["found"]
        last = _violation("unresolved_action", _or_own(s["since"], F.size(frames) - 1), s["pending"].cast("string"), " non-terminal action(s) without matching result(s) by end of trajectory")
        return F.when(s["pending"] > 0, F.concat(s["found"], F.array(last))).otherwise(s["found"])

    return F.aggregate(_indexed(frames), zero, step, finish)


@dataclass(frozen=True)
class OwnRule:
    """A user's rule about a frame and the one before it: wrong(previous, kind, index, terminal) builds the condition that breaks it.

    previous is null before the first frame; terminal says that an action ends the run. One rule serves all forms: a fold
    (as_fold), windows (violations_of_rows) and streams (streaming.validate.violations). A null condition breaks nothing.
    """

    name: str
    wrong: Callable[[Column, Column, Column, Column], Column]
    message: str = ""

    def breaks(self, previous: Column, kind: Column, index: Column, terminal: Column) -> Column:
        return F.coalesce(self.wrong(previous, kind, index, terminal), F.lit(False))

    def as_fold(self, frames: Column) -> Column:
        """array<violation> of a frames column: a rule for violations(rules=...)."""
        each = _indexed(frames)
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(frames, lambda f: f["type"]))
        paired = F.zip_with(each, F.slice(before, F.lit(1), F.size(frames)), lambda x, previous: F.struct(x.alias("x"), previous.alias("previous")))
        found = F.filter(paired, lambda p: self.breaks(p["previous"], p["x"]["type"], p["x"]["i"], p["x"]["terminal"]))
        return F.transform(found, lambda p: _violation(self.name, p["x"]["i"], self.message))


Rule = Callable[[Column], Column]
#: The rules that come before the walk, in the order of their violations; a caller may add to them.
STRUCTURAL_RULES: tuple[Rule, ...] = (missing_goal, opening_prelude, misplaced_end)


def violations(frames: Column, allow_unresolved: bool = False, rules: Sequence[Rule] = STRUCTURAL_RULES) -> Column:
    """array<violation> of a frames column; no frames (or null): none."""
    found = F.concat(*(rule(frames) for rule in rules), action_walk(frames, allow_unresolved)).cast(_NONE)
    return F.when(F.coalesce(F.size(frames), F.lit(0)) > 0, found).otherwise(F.array().cast(_NONE))


def is_valid(frames: Column, allow_unresolved: bool = False) -> Column:
    return F.size(violations(frames, allow_unresolved)) == 0


def shown(violation: Column) -> Column:
    return F.concat(F.lit("["), violation["rule"], F.lit("] frame "), violation["frame_index"].cast("string"), F.lit(": "), violation["message"])


def violations_of_rows(rows: DataFrame, by: str = "id", order: str = "i", kind: str = "type", terminal: str = "terminal", allow_unresolved: bool = False, own: Sequence[OwnRule] = ()) -> DataFrame:
    """(by, rule, frame_index) for rows that hold one frame each; order numbers the frames of a trajectory from 0. own: further rules.

    What is pending after a row is a running sum that never falls below zero: S - min(0, least S so far).
    """
    w = Window.partitionBy(by).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = F.when(F.col(terminal) & (F.col(kind) == "action"), "taction").otherwise(F.col(kind))
    df = rows.select(by, F.col(order).cast("int").alias("i"), t.alias("t"))
    df = df.withColumn("s", F.sum(lookup({"action": 1, "result": -1}, F.col("t"))).over(upto)).withColumn("s", F.coalesce("s", F.lit(0)))
    df = df.withColumn("p", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
    turn = F.when(F.col("t").isin("action", "taction", *REASONING), True).when(F.col("t").isin("end", "result", "feedback", "reward"), False)
    closer = F.col("t").isin("action", "taction", *REASONING)
    df = df.select(
        "*", F.coalesce(F.lag("p").over(w), F.lit(0)).alias("pp"), turn.alias("_turn"), F.lag("t").over(w).alias("prev"), F.last(F.when(F.col("t") != "end", F.col("t")), ignorenulls=True).over(before).alias("prev_non_end"),
        F.coalesce(F.max(F.col("t").isin("action", "taction")).over(before), F.lit(False)).alias("acted"), F.coalesce(F.max(closer).over(upto), F.lit(False)).alias("closed"), F.lead("t").over(w).isNull().alias("last"),
    )
    df = df.select("*", F.coalesce(F.last("_turn", ignorenulls=True).over(before), F.lit(False)).alias("turn"), F.last(F.when((F.col("t") == "action") & (F.col("pp") == 0), F.col("i")), ignorenulls=True).over(upto).alias("opened"))
    df = df.withColumn("since", F.when(F.col("p") > 0, F.col("opened"))).withColumn("since_before", F.lag("since").over(w))
    i, at_before, at = F.col("i"), _or_own(F.col("since_before"), F.col("i")), _or_own(F.col("since"), F.col("i"))
    t = F.col("t")
    rules = [
        (F.lit("missing_goal"), (i == 0) & (t != "goal"), i),
        (F.lit("opening_prelude"), ~F.col("closed") & ~t.isin(PRELUDE), i),
        (F.lit("misplaced_end"), (t == "end") & ((i == 0) | ~F.col("prev").isin("action", "taction", *REASONING)), i),
        (F.lit("orphan_action"), t.isin("action", "taction") & (F.col("pp") > 0) & ~F.col("turn"), at_before),
        (F.lit("unresolved_action"), t.isin(REASONING) & (F.col("p") > 0), at),
        (F.lit("orphan_result"), (t == "result") & (F.col("pp") == 0) & (F.coalesce("prev_non_end", F.lit("")) != "taction"), i),
        (F.lit("premature_runtime_frame"), t.isin("feedback", "reward") & ~F.col("acted"), i),
    ]
    plain = lambda c: F.when(c == "taction", "action").otherwise(c)
    rules += [(F.lit(rule.name), rule.breaks(plain(F.col("prev")), plain(t), i, t == "taction"), i) for rule in own]
    if not allow_unresolved:
        rules.append((F.lit("unresolved_action"), F.col("last") & (F.col("p") > 0), at))
    found = F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(rule.alias("rule"), index.alias("frame_index"))) for rule, when, index in rules)))
    return df.select(by, F.explode(found).alias("v")).select(by, "v.rule", "v.frame_index")
