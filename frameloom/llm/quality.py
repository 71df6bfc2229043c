"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import fold, map_batches, materialize, release, sample_share, with_fields
from frameloom.llm.ngrams import BITS, features

#: At most about so many labelled texts are fitted to; which, a hash of their ids decides.
TRAIN_ROWS = 8000
#: And at most so many bytes of their vectors: texts come in order of the hash until it is reached.
TRAIN_BYTES = 256 << 20
#: In so many parts the vectors reach the driver.
PARTS = 16
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
#: Of a feature's share of the text; such a multiple is its value.
SCALE = 30.0
SEED = 8
THRESHOLD = 0.7


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values): each feature's share of the text's n-grams, times SCALE."""
    f = features(text)
    if not len(f):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found, counts = np.unique(f, return_counts=True)
    return found, (counts * (SCALE / len(f))).astype(np.float32)


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal: (weights, intercept). No examples: zeros; of one class alone: an intercept towards it."""
    size = 1 << BITS
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    bias = bias_n = 0.0
    order = np.random.default_rng(SEED)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            idx, x = vectors[i]
            zi, ni = z[idx], n[idx]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(float(wi @ x) + bias, -35, 35)))
            err = p - labels[i]
            g = err * x
            g2 = g * g
            z[idx] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / ALPHA * wi
            n[idx] = ni + g2
            bias_n += err * err
            bias -= 0.1 * err / (1 + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, float]:
    """Fits to the labelled rows of docs, a bounded sample of them where they are more than rows.

    Null labels don't count; of several labels of a document the larger does. Null texts have no n-grams. Of rows that
    share an id, the one whose text has the least hash counts. The sampled ids are limited to 1.2 * rows before they are
    broadcast; only the samples' sparse vectors, of most_bytes at most, reach the driver. Other columns are not read.
    Without labels, or on an empty table, the model is the empty one.
    """
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    known = docs.select(F.col(id_col).alias("_id")).distinct().join(given, "_id")
    chosen = sample_share(known, "_id", rows / max(1, known.count()), SEED).limit(int(1.2 * rows))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "text", "_y")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vs = [vector(t) for t in batch.column(1).to_pylist()]
        hashed = [xxhash.xxh64_intdigest(t or "", SEED) >> 1 for t in batch.column(1).to_pylist()]
        cells = [pa.array([x.tobytes() for x in part], pa.binary()) for part in zip(*vs, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(hashed, pa.int64()), *cells], ["id", "y", "hash", "idx", "x"])

    vectors = materialize(map_batches(texts, run, "id string, y int, hash long, idx binary, x binary"), "vectors")
    first = vectors.groupBy("id").agg(F.min_by(F.struct((F.length("idx") + F.length("x")).alias("n"), "hash"), "hash").alias("first"))
    order = sorted(first.select("id", "first.hash", "first.n").collect(), key=lambda r: (r["hash"], r["id"]))
    fits = int(np.searchsorted(np.cumsum([r["n"] for r in order]), most_bytes, "right"))
    last = order[min(fits, len(order)) - 1] if fits else None
    taken = [(r["hash"], r["id"]) for r in order[:fits]]
    idx, x, y = [], [], []
    if taken:
        hash_, id_ = taken[-1]
        within = vectors.where(F.struct("hash", "id") <= F.struct(F.lit(hash_).alias("hash"), F.lit(id_).alias("id"))).dropDuplicates(["id", "hash"])
        # part by part: the driver's JVM never holds all
        got = {(r["hash"], r["id"]): r for r in within.coalesce(PARTS).toLocalIterator()}
        idx, x = ([np.frombuffer(got[key][c], kind) for key in taken] for c, kind in (("idx", np.int32), ("x", np.float32)))
        y = [got[key]["y"] for key in taken]
    release(vectors)
    return fit(list(zip(idx, x, strict=True)), np.array(y, float))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """docs' columns plus, as name, the probability of label 1; a null text, and one without words, has the intercept's. Repeated rows stay; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, bias = shared.value
        out = []
        for text in batch.column(at).to_pylist():
            f = features(text)
            s = bias + (float(w[f].sum(dtype=np.float64)) * SCALE / len(f) if len(f) else 0.0)
            out.append(1 / (1 + np.exp(-np.clip(s, -35, 35))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    return map_batches(docs, run, with_fields(docs, **{name: "double"}))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; labels of the held-out fold are not learnt from.

    Null and empty texts have the intercept's score. Without labels every score is 0.5. Null ids count as the
    empty text for their fold and have no label. Texts are scored whole. Repeated rows stay. Other columns are
    not read. An empty table gives no rows.
    """
    named = docs.select("doc_id", "text")
    out = fold("doc_id", modulus) == held
    model = train(named.where(~out), labels)
    scored = score(named.select("doc_id", out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
