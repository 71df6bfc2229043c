"""SpotSigs fingerprints: chains of content words that follow common words.

Each occurrence of a common word (anchor) gives a signature: the anchor and the next content words.
A text's fingerprint is its set of signatures; texts are alike as far as their sets are (Jaccard).
Text set in other words around the same anchors differs; templates and bare lists have few anchors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import setlinks
from frameloom.llm.common import bounded_batches, materialize
from frameloom.llm.ngrams import LONGEST

#: Common words of four languages, in lower case.
ANCHORS = frozenset(
    """a an and are as at be but by for from had has have he in is it its not of on or that the their they this to was were which with you
    aber als am auch auf aus bei das dem den der des die ein eine einem einen er es für hat ich im ist mit nach nicht sich sie sind über und von war wie zu zum
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne on ou par pas pour que qui sa se ses son sont sur un une
    al como con del el ella en era es esta fue ha la las lo los más me muy no para pero por se sin su sus y""".split()
)
CHAIN = 2
_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """64-bit hash of each word, odd for anchors; words longer than LONGEST are not kept, and all are let go when it has grown to its bound."""

    bound = 200_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1 | (word in ANCHORS)
        if len(word) <= LONGEST:
            if len(self) >= self.bound:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def signatures(text: str | None) -> np.ndarray:
    """The text's signatures as sorted distinct 64-bit numbers.

    At the end of a text a chain may be short, but has one content word at least. A text without
    any chain is fingerprinted by its words; one without words has the empty set.
    """
    words = _WORD.findall(text.lower()) if text else []
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    anchor = (h & np.uint64(1)).astype(bool)
    content = np.flatnonzero(~anchor)
    first = np.searchsorted(content, np.flatnonzero(anchor))
    kept = first < len(content)
    if not kept.any():
        return np.unique(h)
    sig, first = h[anchor][kept], first[kept]
    chain = np.append(h[content], np.zeros(CHAIN, np.uint64))
    for k in range(CHAIN):
        sig = (sig * _K1) ^ (chain[first + k] + np.uint64(k)) * _K2
        sig ^= sig >> np.uint64(29)
    return np.unique(sig)


def fingerprint(sigs: np.ndarray) -> str:
    """The size of the set and a 128-bit digest of it; the empty set's is `0-` and zeros."""
    return f"{len(sigs)}-{xxhash.xxh3_128_hexdigest(sigs.tobytes()) if len(sigs) else '0' * 32}"


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two signature sets; 0 at once where their sizes alone rule out least. Two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    common = small + large - len(np.union1d(a, b))
    return common / (small + large - common)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much of the beginning of following."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_OUT = {
    "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}
_KINDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    other = edited(text, following)
    sigs = signatures(other)
    return len(text), hashlib.sha256(other.encode()).hexdigest(), fingerprint(own), fingerprint(sigs), likeness(own, sigs), likeness(own, theirs)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to the edited text and to the next document.

    The next document has the next smaller id; the last one's is the first. Null ids come last, equal
    ids in order of a hash of their texts, then of the texts; null text counts as empty; repeated rows stay. A table
    of one row is its own next. Other columns are not read. An empty table gives no rows.

    Documents are dealt out by ranges of ids and hashes and sorted there, each text once. Within a range each row
    meets its successor; only a range's first and last text are kept to join the ranges' ends.
    """
    return _walked(docs, id_col, text_col, None).select("doc_id", *_OUT)


def _walked(docs: DataFrame, id_col: str, text_col: str, marker: setlinks.Marker | None) -> DataFrame:
    """(doc_id, key, edited_fingerprints()' columns and, with a marker, its marks of the text's own set), as written tables."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kinds = _OUT | (marker.kinds if marker else {})
    ddl = _KINDS + (f", {marker.ddl}" if marker else "")
    mark = marker.mark() if marker else lambda _: ()
    blank = (None,) * len(kinds)
    order, tie = F.col("doc_id").desc_nulls_last(), F.col("key")
    ranges = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange(order, tie)
    kind = docs.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None  # (id, key, text, signatures)
        id_type = None

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            types = {"doc_id": id_type, "key": pa.int64(), **kinds, "edge": pa.string(), "range": pa.int64(), "text": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))

        for batch in batches:
            id_type = batch.column(0).type
            rows = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sigs = signatures(text)
                if last is None:
                    rows.append((doc_id, key, *blank, "first", part, text))
                else:
                    rows.append((*last[:2], *_row(*last[2:], text, sigs), *mark(last[3]), None, part, None))
                last = doc_id, key, text, sigs
            if rows:
                yield emit(rows)
        if last is not None:
            yield emit([(*last[:2], *blank, "last", part, last[2])])

    walked = ranges.sortWithinPartitions(order, tie, "text").mapInArrow(walk, f"doc_id {kind}, key long, {ddl}, edge string, range long, text string")
    done = materialize(walked, "spots")
    # one number for each range
    parts = sorted(r["range"] for r in done.where("edge = 'first'").select("range").collect())
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "range long, next_range long")
    firsts = done.where("edge = 'first'").select(F.col("range").alias("next_range"), F.col("text").alias("next_text"))
    ends = done.where("edge = 'last'").select("doc_id", "key", "text", "range").join(following, "range").join(firsts, "next_range").select("doc_id", "key", "text", "next_text")
    columns = ["doc_id", "key", *kinds]

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = signatures(a)
                rows.append((*_row(a, own, b, signatures(b)), *mark(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values()))], columns)

    joined = materialize(ends.mapInArrow(join_ends, f"doc_id {kind}, key long, {ddl}"), "ends", len(parts))
    return done.where("edge is null").select(*columns).union(joined)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = setlinks.LEAST_LIKENESS) -> DataFrame:
    """(doc_id, fingerprint, n_signatures, group_id) for each row of docs: groups over links of a likeness of least or more.

    group_id is the smallest doc_id of the group; null ids are never the smallest. Sets of signatures are partitioned
    by length and compared by pruned Jaccard, as in setlinks; no link is lost. Null, empty and blank texts share the
    empty set. Repeated rows stay, in one group. Other columns are not read. An empty table gives no rows.
    """
    marker = _marker(docs, id_col, text_col, least)
    rows = materialize(_named(setlinks.linked(marker, materialize(marker.marked(), "marked"))), "rooted")
    groups = rows.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return rows.join(groups, "root").select("doc_id", "fingerprint", F.col("n").alias("n_signatures"), "group_id")


def _marker(docs: DataFrame, id_col: str, text_col: str, least: float) -> setlinks.Marker:
    return setlinks.Marker(docs, lambda text: signatures(text.decode("utf-8", "replace") if text else None), id_col, text_col, least)


def _named(rooted: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n, root) of rows that setlinks has linked."""
    half = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    name = F.concat(F.col("n").cast("string"), F.lit("-"), F.when(F.col("n") > 0, F.concat(half("check"), half("fp"))).otherwise("0" * 32))
    return rooted.select("doc_id", name.alias("fingerprint"), "n", "root")


def grouped_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = setlinks.LEAST_LIKENESS) -> DataFrame:
    """edited_fingerprints() with group_fingerprint: the least fingerprint of all documents reachable over links of a likeness of least or more, the document's own included.

    Each text's signatures are made once, for both. Nulls, ties, repeated rows, other columns and the empty table: as in edited_fingerprints().
    """
    marker = _marker(docs, id_col, text_col, least)
    rows = _walked(docs, id_col, text_col, marker)
    linked = setlinks.linked(marker, rows.select("doc_id", "key", *marker.kinds))
    sets = materialize(linked.groupBy("fp", "check", "n", "root").agg(F.count("*").alias("_rows")), "groups")
    named = _named(sets.withColumn("doc_id", F.lit(None).cast("long")))
    least_of = named.groupBy("root").agg(F.min("fingerprint").alias("group_fingerprint"), F.count("*").alias("_sets")).where("_sets > 1")
    others = named.join(least_of, "root").select(F.col("fingerprint").alias("_own"), "group_fingerprint")
    out = rows.join(others, F.col("fingerprint") == F.col("_own"), "left")
    return out.select("doc_id", *_OUT, F.coalesce("group_fingerprint", "fingerprint").alias("group_fingerprint"))
