"""Language identification with hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. An n-gram is the product of its letters' vectors,
each rotated by its place; a text is the sum of its n-grams; a language is the sum of its training
texts, each at unit length. A text has the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import fold, map_batches, with_fields

N = 3
DIM = 2048
SEED = 20
#: Letters below it (Latin, Greek, Cyrillic, Armenian, Hebrew) have a class of their own, the rest share the classes up to CLASSES.
OWN_CLASS, CLASSES = 0x600, 2048
#: More languages than these are refused: each is a row that reaches the driver.
MOST_LANGS = 2000
UNDETERMINED = "und"
#: Training texts of each language, about; all if there are fewer.
TRAIN_PER_LANG = 2000
#: Units in which a training text's vector is summed: whole numbers, so that the sum has no order.
UNIT = 1 << 15
_CHUNK = 1 << 20


@cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 for all but letters."""
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    code = np.arange(0x110000)
    return np.where(letters, np.where(code < OWN_CLASS, code, OWN_CLASS + code % (CLASSES - OWN_CLASS)), 0).astype(np.uint16)


@cache
def _letters() -> list[np.ndarray]:
    """The letter vectors, rotated for each place of an n-gram."""
    v = (np.random.default_rng(SEED).integers(0, 2, (CLASSES, DIM), np.int8) * 2 - 1).astype(np.int8)
    return [np.ascontiguousarray(np.roll(v, N - 1 - place, axis=1)) for place in range(N)]


def n_grams(text: str | None) -> int:
    """How many n-grams the text's profile sums."""
    return len(_marks(text)) - N + 1 if text and _classes()[_codes(text)].any() else 0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def _marks(text: str) -> np.ndarray:
    """Classes of the text's letters, with one 0 for each run of other characters and at both ends."""
    c = np.concatenate(([0], _classes()[_codes(text)], [0])).astype(np.int64)
    return c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]


def profile(text: str | None) -> np.ndarray | None:
    """The text's vector at unit length; None if it has no letter.

    Letter case is ignored, and each run of other characters counts as one word end. Very long texts are summed in chunks.
    """
    c = _marks(text) if text else np.zeros(0, np.int64)
    if not c.any():
        return None
    total = np.zeros(DIM, np.float32)
    at = _letters()
    for i in range(0, len(c) - N + 1, _CHUNK):
        part = c[i : i + _CHUNK + N - 1]
        code = part[: len(part) - 2] * (CLASSES * CLASSES) + part[1:-1] * CLASSES + part[2:]
        grams, counts = np.unique(code, return_counts=True)
        v = at[0][grams // (CLASSES * CLASSES)]
        v *= at[1][grams // CLASSES % CLASSES]
        v *= at[2][grams % CLASSES]
        total += counts.astype(np.float32) @ v.astype(np.float32)
    norm = float(np.linalg.norm(total))
    return total / norm if norm else None


def _sample(docs: DataFrame, text_col: str, lang_col: str, key_col: str, per_lang: int) -> DataFrame | None:
    """(text, lang) of about per_lang texts of each language; None without any."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(key_col).cast("string").alias("key")).where("lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not counts:
        return None
    if max(counts.values()) > per_lang:
        share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_lang / n))))
        rows = rows.where(F.pmod(F.xxhash64(F.lit(SEED), F.col("key")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    return rows.select("text", "lang")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_lang: int = TRAIN_PER_LANG) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from rows with a language; of each, about per_lang texts, chosen by a hash of the key.

    What reaches the driver is a vector for each language. Null languages, and rows without a letter, don't count.
    Rows that share a key are taken or left together. Without languages, or on an empty table, there are no prototypes.
    """
    rows = _sample(docs, text_col, lang_col, key_col, per_lang)
    if rows is None:
        return [], np.zeros((0, DIM), np.float32)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (v := profile(text)) is not None:
                sums[lang] = sums.get(lang, 0) + np.rint(v * UNIT).astype(np.int64)
        return pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))})

    sums = map_batches(rows, run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    per_lang = sums.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).getField("x").alias("v"))
    found = {r["lang"]: np.array(r["v"], float) for r in per_lang.collect()}
    langs = sorted(found)
    protos = np.array([found[x] / max(np.linalg.norm(found[x]), 1e-9) for x in langs], np.float32).reshape(len(langs), DIM)
    return langs, protos


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns plus, under these names, the language, its score (the cosine, 0 at least) and, if there is a third name, the number of n-grams.

    Null, empty and letterless texts, and all texts if no language was learnt: `und` with score 0. Ties go to the first language by name.
    Repeated rows stay. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    kinds = dict(zip(names, ("string", "double", "long"), strict=False))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, protos = shared.value
        texts = batch.column(at).to_pylist()
        found, scores = [], []
        for text in texts:
            v = profile(text) if langs else None
            cos = protos @ v if v is not None else None
            found.append(UNDETERMINED if cos is None else langs[int(cos.argmax())])
            scores.append(0.0 if cos is None else float(min(1, max(0, cos.max()))))
        cells = [pa.array(found, pa.string()), pa.array(scores, pa.float64())]
        if len(names) == 3:
            cells.append(pa.array(map(n_grams, texts), pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns, *cells], [*batch.schema.names, *names])

    return map_batches(docs, run, with_fields(docs, **kinds))


#: Of the likeness that texts of a language usually have at their length, the share below which a text is unlike it;
#: and the least likeness that counts, in standard deviations of what unlike texts reach by chance.
USUAL_SHARE, CHANCE = 0.25, 1.0


def least_likeness(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_lang: int = TRAIN_PER_LANG) -> Callable[[Column], Column]:
    """Number of n-grams -> the cosine that a text of so many must reach to count as one of a learnt language.

    A cosine c / sqrt(1 + k / m) is expected of m n-grams: the sum of a text's own chances grows as sqrt(m), its likeness
    as m. c and k are fitted to the medians, by powers of two of m, of the training texts that are recognised.
    """
    floor = CHANCE / np.sqrt(DIM)
    rows = _sample(docs, text_col, lang_col, key_col, per_lang)
    if rows is None:
        return lambda m: F.lit(floor)
    seen = predict(rows, model, "text", ("_pred", "_cos", "_m")).where("_pred = lang and _cos > 0")
    bins = seen.groupBy(F.floor(F.log2("_m")).alias("bin")).agg(F.median("_cos").alias("cos"), F.median("_m").alias("m"), F.count("*").alias("n")).collect()
    if not bins:
        return lambda m: F.lit(floor)
    x, y, w = (np.array(v, float) for v in zip(*((1 / r["m"], r["cos"] ** -2, np.sqrt(r["n"]) * r["cos"] ** 2) for r in bins), strict=True))
    slope, base = np.polyfit(x, y, 1, w=w) if len(bins) > 1 else (0.0, y[0])
    base, slope = max(1.0, float(base)), max(0.0, float(slope))
    return lambda m: F.greatest(F.lit(floor), USUAL_SHARE / F.sqrt(F.lit(base) + F.lit(slope) / m))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; rows of fold 0 of the modulus are held out of the training.

    Null, empty and letterless texts are `und` with score 0. Null languages teach nothing. A null id counts
    as the empty text for its fold. Texts of any length are profiled whole. Repeated rows stay. Other columns
    are not read. An empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(named.where(fold("doc_id", modulus) != 0))
    ids = named.select("doc_id", (fold("doc_id", modulus) == 0).alias("held_out"), "text")
    return predict(ids, model).select("doc_id", "held_out", "lang_pred", "score")
