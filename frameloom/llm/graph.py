"""Connected components by alternating large-star and small-star steps, with joins and aggregates only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from frameloom.llm.common import materialize, release, rows_of

#: So many edges between numbers, 16 bytes each, are united in one task, in place of many small jobs.
FEW_EDGES = 200_000


def _round(edges: DataFrame, most_rows: int | None) -> tuple[DataFrame, tuple]:
    """(the edges as a written table, (their number, a hash of them)): both in one job."""
    seen = Observation()
    written = materialize(edges.observe(seen, F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("h")), "edges", most_rows)
    return written, (rows_of(written), seen.get["h"])


def united(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of edges between numbers: each node that is not the least that it reaches, with the least."""
    nodes, ends = np.unique(np.concatenate((hi, lo)), return_inverse=True)
    a, b = ends[: len(hi)], ends[len(hi) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in united(*map(np.concatenate, zip(*got, strict=True)))], ["node", "root"])

    return edges.where("hi is not null and lo is not null").select("hi", "lo").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, most_rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """edges(hi, lo), hi > lo -> (node, root): each node that has an edge, but for the roots, with the least node it reaches.

    No neighbourhood is ever gathered: each step takes a minimum per node (combined before the
    shuffle) and joins it back, so that a hub with any number of neighbours only skews a join,
    which adaptive execution splits. Each round is written to the shared folder, and the one before it deleted.
    most_rows: the number of edges, or more, where it is known; FEW_EDGES of them, between numbers, are united in one task.
    Null ends and self loops are ignored; an empty input gives an empty result.
    """
    if most_rows is not None and most_rows <= FEW_EDGES and {edges.schema[c].dataType.simpleString() for c in ("hi", "lo")} == {"bigint"}:
        return materialize(_in_one_task(edges), "components", most_rows)
    e, state = _round(edges.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), most_rows)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        own = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(own, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        old, before = e, state
        e, state = _round(small.union(own.select("hi", F.col("m").alias("lo"))).distinct(), state[0])
        release(old)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
