"""Streaming forms: rules over frames as they arrive, counts in time windows, first mentions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from frameloom.functions.schema import TURN_CLOSERS
from frameloom.functions.text import dedup_key
from frameloom.operators.validate import PRELUDE, REASONING, OwnRule

_STATE = "n int, open int, least int, opened int, turn int, acted boolean, closed boolean, previous string, previous_not_end string"
_OUT = "id string, rule string, frame_index int"
#: Of a trajectory without frames: how many frames, the running sum of actions and results, its least, where the pending actions began, whose turn (-1: nobody's yet).
START = (0, 0, 0, -1, -1, False, False, None, None)
_ENDS_TURN = ["end", "result", "feedback", "reward"]


def _filled(values: np.ndarray, there: np.ndarray, before: Any) -> np.ndarray:
    """values[there], carried on to the places after; before is what comes first."""
    at = np.maximum.accumulate(np.where(there, np.arange(1, len(values) + 1), 0))
    return np.concatenate(([before], values))[at]


def walk(state: tuple, kinds: list[tuple[str, bool]]) -> tuple[tuple, list[tuple[str, int]]]:
    """The rules over further frames of a trajectory: (state after, [(rule, index)]).

    The running sums of violations_of_rows(), as vectors: what is pending after a frame is the sum of actions and results
    less its least value so far, which the state carries from batch to batch.
    """
    if not kinds:
        return state, []
    n, total, least, opened, turn, acted, closed, previous, previous_not_end = state
    kind = np.array([k for k, _ in kinds], object)
    terminal = np.array([k == "action" and t for k, t in kinds])
    action, result = (kind == "action") & ~terminal, kind == "result"
    model, ends = np.isin(kind, TURN_CLOSERS), np.isin(kind, _ENDS_TURN)
    i = n + np.arange(len(kind))
    sums = total + np.cumsum(action.astype(int) - result)
    lows = np.minimum.accumulate(np.minimum(sums, least))
    pending = sums - lows
    shifted = lambda x, first: np.concatenate(([first], x[:-1]))
    was_pending = shifted(pending, total - least)
    began = _filled(i, action & (was_pending == 0), opened)
    since, since_before = np.where(pending > 0, began, -1), shifted(np.where(pending > 0, began, -1), opened if total > least else -1)
    own = lambda x: np.where(x > 0, x, i)  # noqa: E731  the first place counts as none
    turns = _filled(model.astype(int), model | ends, turn)
    turn_before = shifted(turns, turn) == 1
    acted_before = shifted(acted | np.maximum.accumulate(kind == "action"), acted)
    closed_now = closed | np.maximum.accumulate(model)
    before, not_end = shifted(kind, previous), _filled(np.where(terminal, "terminal", kind), kind != "end", previous_not_end)
    after_terminal = shifted(not_end, previous_not_end) == "terminal"
    rules = [
        ("missing_goal", (i == 0) & (kind != "goal"), i),
        ("opening_prelude", ~closed_now & ~np.isin(kind, PRELUDE), i),
        ("misplaced_end", (kind == "end") & ~np.isin(before.astype(str), TURN_CLOSERS), i),
        ("orphan_action", (kind == "action") & (was_pending > 0) & ~turn_before, own(since_before)),
        ("unresolved_action", np.isin(kind, REASONING) & (pending > 0), own(since)),
        ("orphan_result", result & (was_pending == 0) & ~after_terminal, i),
        ("premature_runtime_frame", np.isin(kind, ["feedback", "reward"]) & ~acted_before, i),
    ]
    found = sorted((int(at), k, rule, int(index[at])) for k, (rule, wrong, index) in enumerate(rules) for at in np.flatnonzero(wrong))
    done = acted_before[-1] or kind[-1] == "action"
    after = (int(i[-1]) + 1, int(sums[-1]), int(lows[-1]), int(began[-1]), int(turns[-1]), bool(done), bool(closed_now[-1]), kind[-1], not_end[-1])
    return after, [(rule, index) for _, _, rule, index in found]


def violations(frames: DataFrame, by: str = "id", order: str = "ts", forget_ms: int | None = None, own: Sequence[OwnRule] = ()) -> DataFrame:
    """(id, rule, frame_index) as frames(by, order, type, terminal) arrive. A trajectory's end is not known in a stream, so that nothing is said of actions still pending.

    Frames of one batch are put in their order; a batch is expected not to hold frames older than those of earlier ones.
    With forget_ms, a trajectory without a frame for so long a processing time is forgotten, and what comes later begins a new
    one: so the state stays bounded, but such a query never says that all is processed, as it always waits for timeouts.
    own: further rules, over each frame and the one before it, which may have come in an earlier batch.
    """

    def run(key: tuple[Any], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        before = tuple(None if pd.isna(x) else x for x in state.get) if state.exists else START
        kinds = list(zip(rows["type"], rows["terminal"].astype(bool), strict=True))
        after, found = walk(before, kinds)
        state.update(after)
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        out = [(str(key[0]), rule, at, None, None, None) for rule, at in found]
        if own:  # and each frame with the one before it, for the rules below
            last = [before[7], *(k for k, _ in kinds)]
            out += [(str(key[0]), None, before[0] + i, last[i], k, k == "action" and bool(t)) for i, (k, t) in enumerate(kinds)]
        yield pd.DataFrame(out, columns=["id", "rule", "frame_index", "previous", "type", "terminal"]).astype({"previous": object, "type": object, "terminal": object})

    walked = frames.groupBy(by).applyInPandasWithState(run, f"{_OUT}, previous string, type string, terminal boolean", _STATE, "append", "NoTimeout" if forget_ms is None else "ProcessingTimeTimeout")
    broken = [F.when(rule.breaks(F.col("previous"), F.col("type"), F.col("frame_index"), F.col("terminal")), F.lit(rule.name)) for rule in own]
    names = F.when(F.col("rule").isNotNull(), F.array("rule")).otherwise(F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))
    return walked.select("id", F.explode(names).alias("rule"), "frame_index")


def counts(events: DataFrame, kind: str = "event_type", ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) in tumbling windows; rows later than the watermark don't count."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def first_mentions(df: DataFrame, text: str, ts: str = "ts", within: str = "1 day") -> DataFrame:
    """The first row of each normalised text within the watermark."""
    return df.withColumn("_key", dedup_key(F.col(text))).withWatermark(ts, within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
