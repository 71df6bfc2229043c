"""Fill-in-middle: a text is cut into prefix, middle and suffix at unit bounds, and its middle moved to the end.

One Arrow-batched pandas UDF cuts a batch's texts into units, keeps where each ends in a compact array, and slices at two
of these ends; which, and in which form, the SHA-256 of seed and id says. So a row is cut alike in each run, task and order of rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import bounded_batches

SEED = 42
#: A unit: a word with the white space before it, or white space at the end of the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: What marks the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Rates:
    """Percent of the texts that are rearranged, and of these, percent whose suffix comes first."""

    fim: int = 50
    spm: int = 80


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


@cache
def _unit() -> regex.Pattern:
    return regex.compile(UNIT)


def unit_ends(text: str) -> np.ndarray:
    """Where each unit of the text ends, in code points; units leave nothing out."""
    return np.fromiter((m.end() for m in _unit().finditer(text)), np.uint32)


def draws(doc_id: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the SHA-256 of seed and id."""
    return tuple(np.frombuffer(hashlib.sha256(f"{seed}:{doc_id}".encode()).digest(), ">u4", 4).tolist())


def cut(text: str, doc_id: str, seed: int = SEED, rates: Rates = Rates()) -> Cut:
    """A text in the form that its id draws; empty texts, and those that hold a mark, stay plain."""
    ends, (one, other, whether, first) = unit_ends(text), draws(doc_id, seed)
    n = len(ends)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or whether % 100 >= rates.fim:
        return Cut(n, PLAIN, None, None, text)
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((one % (n + 1), other % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if first % 100 < rates.spm:
        return Cut(n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Cut(n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restore(output: str, form: str) -> str:
    """The text that cut() was given. No text that is rearranged holds a mark, and marks can't overlap, so that the first of each is its own."""
    if form == PLAIN:
        return output
    opened, between = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    head, _, rest = output.removeprefix(opened).partition(between)
    tail, _, middle = rest.partition(MIDDLE)
    return head + middle + tail if form == PSM else tail + middle + head


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_CUT = "n long, form string, prefix_chars long, middle_chars long"


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column]:
    bounded_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return named, F.col("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _frame(rows: list[Cut], **more: list) -> pd.DataFrame:
    numbers = {c: pd.array([getattr(r, c) for r in rows], "Int64") for c in ("n", "prefix_chars", "middle_chars")}
    return pd.DataFrame({"n": numbers["n"], "form": [r.form for r in rows], "prefix_chars": numbers["prefix_chars"], "middle_chars": numbers["middle_chars"], **more})


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rates: Rates = Rates()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs: the training text and how it was cut.

    n: units of the text. prefix_chars and middle_chars are code points, null where the form is plain. Null text counts as
    empty, and is plain. A null id draws as the empty text does. Rows of equal ids draw alike; repeated rows stay, and are
    equal. Texts of any length are cut whole. Other columns are not read. An empty table gives no rows.
    """

    @F.pandas_udf(f"{_CUT}, output string")
    def run(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        rows = [cut(t, i, seed, rates) for t, i in zip(texts, ids, strict=True)]
        return _frame(rows, output=[r.output for r in rows])

    named, text, doc_id = _named(docs, id_col, text_col)
    return named.select("doc_id", run(text, doc_id).alias("cut")).select("doc_id", "cut.*")


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "text") -> DataFrame:
    """df's columns plus, as name, the text that each output was made of. A null output gives null, a null form counts as plain."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return df.withColumn(name, run(F.col(output_col), F.coalesce(F.col(form_col), F.lit(PLAIN))))


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rates: Rates = Rates()) -> DataFrame:
    """fill_in_middle() with, in place of the output, its SHA-256 and that of the text that restore() makes of it: an audit that moves no text out of the workers.

    Nulls, empty and long texts, repeated rows, other columns and the empty table: as there.
    """

    @F.pandas_udf(f"{_CUT}, output_sha256 string, restored_sha256 string")
    def run(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        rows, digests = [], []
        for text, doc_id in zip(texts, ids, strict=True):
            made = cut(text, doc_id, seed, rates)
            digests.append((_sha256(made.output), _sha256(restore(made.output, made.form))))
            rows.append(made._replace(output=""))  # outputs are let go one by one
        return _frame(rows, output_sha256=[d[0] for d in digests], restored_sha256=[d[1] for d in digests])

    named, text, doc_id = _named(docs, id_col, text_col)
    return named.select("doc_id", run(text, doc_id).alias("cut")).select("doc_id", "cut.*")
