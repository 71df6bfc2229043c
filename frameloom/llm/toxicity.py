"""Toxicity from confirmed toxic texts and unlabelled ones: non-negative positive-unlabelled learning.

A linear classifier over counts of words and word beginnings (inflected forms share them) is
trained in numpy. Its risk is
prior * R+(positives as 1) + |R-|, R- = R(unlabelled as 0) - prior * R(positives as 0): the unlabelled
texts stand for the negatives once the positives among them, whose share the class prior gives, are
taken out. A risk is not negative: an estimate of R- below zero is a fit to the unlabelled texts' toxic part,
and from there steps lead back to zero, while the risk of the positives still falls.

All texts that may be learnt from are the unlabelled ones. Each worker sums the risk and its slope over its
rows; the driver gets a few numbers for each weight, and steps along them (L-BFGS).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import bounded_batches, fold, map_batches, materialize, release, sample_share
from frameloom.llm.ngrams import LONGEST, word_parts, words

#: Bound, about, of the confirmed toxic texts fitted to; a hash of the ids decides which. All texts are the unlabelled ones.
POSITIVES = 4000
#: Words and beginnings that enter the classifier: those that tell positives from unlabelled texts most, of the
#: CANDIDATES that most positives have.
PARTS, CANDIDATES = 256, 1 << 16
#: Passes over the texts' counts at most, the decay of the weights times the number of positives, the least gain of a step that is followed by another, and the steps remembered.
STEPS, DECAY, GAIN, MEMORY = 60, 1.0, 1e-6, 8
#: Below this, the estimated risk of the negatives counts as zero.
ZERO = 1e-3
#: Parts of a step that are tried in one pass.
TRIED = (1.0, 0.5, 0.2, 0.05)
#: Where no labels give a prior.
PRIOR = 0.1
SEED = 4


class Counts(dict):
    """word -> numbers of its parts among the known ones; words longer than LONGEST are not kept, and all are let go when it has grown to its bound."""

    bound = 200_000

    def __init__(self, known: list[str]):
        super().__init__()
        self.number = {part: i for i, part in enumerate(known)}

    def __missing__(self, word: str) -> bytes:
        number = self.number
        found = b"".join([number[p].to_bytes(4, "little") for p in word_parts(word) if p in number])
        if len(word) <= LONGEST:
            if len(self) >= self.bound:
                self.clear()
            self[word] = found
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(numbers of the known parts that the text has, how often each, how many words there are)."""
        found = words(text)
        hits = np.frombuffer(b"".join(map(self.__getitem__, found)), np.int32)
        return *np.unique(hits, return_counts=True), len(found)


def _log(n: np.ndarray) -> np.ndarray:
    return np.log2(1 + n).astype(np.float32)


class Rows(NamedTuple):
    """Texts as sparse rows: of each value its row, its part's number and itself; and the length of each row.

    The length is a value too: a long clean text meets a telling part by chance.
    """

    row: np.ndarray
    part: np.ndarray
    value: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(parts: pa.ListArray, values: pa.ListArray, length: pa.Array) -> Rows:
        return Rows(np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False)), parts.flatten().to_numpy(), values.flatten().to_numpy(), length.to_numpy())

    def times(self, w: np.ndarray) -> np.ndarray:
        """Each row's product with weights of the parts, the length, and 1."""
        return np.bincount(self.row, self.value * w[self.part], len(self.length)) + self.length * w[-2] + w[-1]

    def sums(self, of_row: np.ndarray, size: int) -> np.ndarray:
        """The rows, each times its number, summed."""
        return np.concatenate((np.bincount(self.part, self.value * of_row[self.row], size - 2), [of_row @ self.length, of_row.sum()]))


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def risk_sums(rows: Rows, positive: np.ndarray, at: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For each tried part of the step: loss of all rows as 0, of positives as 0, of positives as 1; then the slopes of the three.

    The log loss of a 0 is softplus(score), its slope sigmoid(score); of a 1, softplus(-score) and sigmoid(score) - 1.
    """
    s0, ds, out = rows.times(at), rows.times(step), []
    for t in TRIED:
        s = s0 + t * ds
        p = _sigmoid(s)
        as0, as1 = np.logaddexp(0, s), np.logaddexp(0, -s[positive])
        pos = np.where(positive, p, 0.0)
        out.append(np.concatenate(([as0.sum(), as0[positive].sum(), as1.sum()], *(rows.sums(x, len(at)) for x in (p, pos, pos - positive)))))
    return np.array(out)


def fit(sums: Callable[[np.ndarray, np.ndarray], np.ndarray], n_positive: int, n_all: int, n_parts: int, prior: float) -> np.ndarray:
    """Weights of the parts, of the length, and the intercept; sums(at, step) gives risk_sums() over all rows.

    Without positives or without rows: zeros and the prior's log odds. A step is shortened until the risk falls; where no
    part of it does, the fit ends.
    """
    size = n_parts + 2
    w = np.zeros(size)
    if not n_positive or not n_all:
        w[-1] = np.log(prior / (1 - prior))
        return w
    w[-1] = -1.0
    decay = np.append(np.full(size - 1, DECAY / n_positive), 0.0)

    def risk(x: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray]:
        """(risk, its slope) from one row of sums; the corner of |R-| is rounded, so that a slope can be followed past it."""
        all0, pos0, pos1 = x[0] / n_all, x[1] / n_positive, x[2] / n_positive
        g_all, g_pos0, g_pos1 = x[3:].reshape(3, size) / np.array([[n_all], [n_positive], [n_positive]])
        negatives = all0 - prior * pos0
        size_of = np.hypot(negatives, ZERO)
        return prior * pos1 + size_of + 0.5 * decay @ (at * at), prior * g_pos1 + negatives / size_of * (g_all - prior * g_pos0) + decay * at

    now, g = risk(sums(w, np.zeros(size))[0], w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        d, coefficients = -g, []
        for s, y in reversed(past):
            c = (s @ d) / (s @ y)
            coefficients.append(c)
            d = d - c * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), c in zip(past, reversed(coefficients), strict=True):
            d = d + (c - (y @ d) / (s @ y)) * s
        found = None
        for t, x in zip(TRIED, sums(w, d), strict=True):
            after, slope = risk(x, w + t * d)
            if after < now + 1e-4 * t * float(g @ d):
                found = t, after, slope
                break
        if found is None:
            if not past:
                break
            past.clear()  # once more along the slope itself
            continue
        t, after, slope = found
        step = t * d
        if step @ (slope - g) > 1e-12:
            past = [*past[-MEMORY + 1 :], (step, slope - g)]
        gained, w, now, g = now - after, w + step, after, slope
        if gained < GAIN:
            break
    return w


def telling_parts(texts: DataFrame, n_positive: int, n_all: int, n: int = PARTS) -> list[str]:
    """The n parts, sorted, that positives among texts(positive, text) have more than all texts, by the difference in standard errors.

    Candidates are parts that two positives have, or one if there are few; of these, all texts are counted.
    Words longer than LONGEST are no candidates, but their beginnings are. Each worker counts its texts before counts are shuffled;
    CANDIDATES words and n rows at most reach the driver.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for text in batch.column(0).to_pylist():
                found.update({p for w in set(words(text)) for p in word_parts(w) if len(p) <= LONGEST})
            yield pa.RecordBatch.from_pydict({"part": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    bounded_batches(texts.sparkSession)
    asked = texts.where("positive").select("text").mapInArrow(ask, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    rows = asked.where(F.col("n") >= (2 if n_positive >= 20 else 1)).orderBy(F.desc("n"), "part").limit(CANDIDATES).collect()
    if not rows:
        return []
    given = sorted((r["part"], r["n"]) for r in rows)
    shared = texts.sparkSession.sparkContext.broadcast([p for p, _ in given])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = Counts(shared.value), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hits = np.frombuffer(b"".join(map(counts.__getitem__, set(words(text)))), np.int32)
                total[np.unique(hits)] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"part": pa.array(there, pa.int32()), "n": pa.array(total[there], pa.int64())})

    seen = np.zeros(len(given), np.int64)
    for r in texts.select("text").mapInArrow(count, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():
        seen[r["part"]] = r["n"]
    shared.destroy()
    p, u = np.array([k for _, k in given]) / n_positive, seen / n_all
    error = np.sqrt(np.maximum(u * (1 - u), 1 / n_all) * (1 / n_positive + 1 / n_all))
    best = np.argsort(-(p - u) / error, kind="stable")[:n]
    return sorted(given[i][0] for i in best if p[i] > u[i])


def counted(texts: DataFrame, parts: list[str]) -> DataFrame:
    """texts(doc_id, held_out, positive, text) with the known parts' logarithmic counts (parts, values) and length, without the texts."""
    shared = texts.sparkSession.sparkContext.broadcast(parts)
    columns = ["doc_id", "held_out", "positive"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = Counts(shared.value)
        found = [counts.of(t) for t in batch.column(3).to_pylist()]
        part, times = pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([_log(f[1]) for f in found], pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], part, times, pa.array(_log(np.array([f[2] for f in found])), pa.float32())], [*columns, "parts", "values", "length"])

    texts = texts.select(*columns, "text")
    return map_batches(texts, run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, held_out boolean, positive boolean, parts array<int>, values array<float>, length float")


def summed(rows: DataFrame, size: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """risk_sums() over rows(positive, parts, values, length): a row of numbers for each partition, added up on the way to the driver."""
    rows = rows.select("positive", "parts", "values", "length")
    width = 3 + 3 * size

    def sums(at: np.ndarray, step: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(TRIED), width))
            for b in batches:
                total += risk_sums(Rows.of(b.column(1), b.column(2), b.column(3)), b.column(0).to_numpy(zero_copy_only=False).astype(bool), at, step)
            yield pa.RecordBatch.from_pydict({"tried": pa.array(range(len(TRIED)), pa.int32()), "x": pa.array(list(total), pa.list_(pa.float64()))})

        parts = rows.mapInArrow(run, "tried int, x array<double>").select("tried", F.posexplode("x").alias("i", "x"))
        # whole multiples of a small unit, so that the sum does not depend on its order
        added = parts.groupBy("tried", "i").agg(F.sum(F.col("x").cast("decimal(38,9)")).cast("double").alias("x"))
        out = np.zeros((len(TRIED), width))
        for r in added.toArrow().to_batches():
            out[r.column("tried").to_numpy(), r.column("i").to_numpy()] = r.column("x").to_numpy()
        return out

    return sums


def score(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score) of counted rows: the classifier's probability; a text without words has the intercept's."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _sigmoid(Rows.of(*(batch.column(i) for i in (2, 3, 4))).times(shared.value))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows.select("doc_id", "held_out", "parts", "values", "length"), run, f"doc_id {kind}, held_out boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text, ...); the held-out fold is not learnt from.

    Positives are documents with a label 1, at most about POSITIVES of them; the unlabelled are all rows outside the held-out
    fold, whatever their labels. The prior is the share of label 1 among labelled documents there; null labels don't
    count, of several labels the larger does. Null and empty texts have the intercept's score. Null ids count as the
    empty text for their fold and have no label. Texts are read whole. Repeated rows count and stay each. Other columns
    are not read. An empty table gives no rows.
    """
    named = docs.select("doc_id", (fold("doc_id", modulus) == held).alias("held_out"), "text")
    given = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label_col).alias("_y"))
    known = named.where("not held_out").select(F.col("doc_id").alias("_id")).distinct().join(given, "_id")
    seen = known.agg(F.count("*").alias("n"), F.count_if(F.col("_y") == 1).alias("p")).first()
    prior = min(0.5, max(0.001, seen["p"] / seen["n"])) if seen["p"] else PRIOR
    chosen = sample_share(known.where("_y = 1"), "_id", POSITIVES / max(1, seen["p"]), SEED).limit(int(1.2 * POSITIVES)).select("_id")
    # the list is bounded: 1.2 * POSITIVES ids
    chosen = materialize(chosen, "positives")
    flagged = named.join(F.broadcast(chosen.withColumn("_chosen", F.lit(True))), (named["doc_id"] == F.col("_id")) & ~F.col("held_out"), "left")
    flagged = flagged.select("doc_id", "held_out", F.coalesce("_chosen", F.lit(False)).alias("positive"), "text")
    learnt = flagged.where("not held_out")
    sizes = learnt.agg(F.count("*").alias("n"), F.count_if("positive").alias("p")).first()
    parts = telling_parts(learnt, sizes["p"], sizes["n"]) if sizes["p"] else []
    rows = materialize(counted(flagged, parts), "counts")
    release(chosen)
    w = fit(summed(rows.where("not held_out"), len(parts) + 2), sizes["p"], sizes["n"], len(parts), prior)
    return score(rows, w).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
