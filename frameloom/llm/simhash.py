"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct 64-bit fingerprint emits all variants within half the radius (radius 2: itself and
its 64 one-bit flips). Two fingerprints differ in at most two bits exactly if they share a variant,
and all that meet in a variant lie within the radius of each other. A variant therefore needs no
pairs: a bit mask says which flips reached it (two longs, combined before the shuffle), and each
member is linked to the least one after a check of the distance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import free_name, map_batches, materialize
from frameloom.llm.graph import components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2


def shingle_hashes(text: bytes, k: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each k-word shingle, repeats included; fewer words than k are one shingle; no word, none.

    bytes.lower() and bytes.split() know ASCII only: A-Z, and the white space 0x20 and 0x09-0x0D.
    """
    words = text.lower().split()
    n, h = len(words), xxhash.xxh64_intdigest
    if n <= k:
        return [h(b" ".join(words), SEED)] if n else []
    if k == 3:
        return [h(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:], strict=False)]
    return [h(b" ".join(words[i : i + k]), SEED) for i in range(n - k + 1)]


def fingerprint(text: bytes | None, k: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash; a bit is set in over half the hashes. Null, empty or blank text: 0."""
    return majority(np.array(shingle_hashes(text or b"", k), "<u8"))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits that are set in over half the hashes; of none: 0."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds what unpacked bits of a very long text take
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; other columns are not read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, k) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(ids, run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, fp long")


def links(distinct_fps: DataFrame) -> DataFrame:
    """fp -> edges (hi, lo) that connect all fingerprints within the radius: at most 65 a fingerprint."""
    # a row becomes 65: dealt out by what it becomes, not by what it is
    dealt = distinct_fps.repartition(int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    flips = dealt.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit"))
    bit = F.when(F.col("bit") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, bit)"))
    met = (
        flips.select(F.col("fp").bitwiseXOR(bit).alias("variant"), bit.alias("flip"), F.when(F.col("bit") < 0, 1).otherwise(0).cast("byte").alias("own"))
        .groupBy("variant")
        .agg(F.expr("bit_or(flip)").alias("flips"), F.max("own").alias("own"))
        .where("bit_count(flips) + own >= 2")
    )
    members = met.select(
        F.expr(
            "transform(filter(sequence(-1, 63), b -> if(b < 0, own = 1, (flips & shiftleft(1L, b)) <> 0)), "
            "b -> if(b < 0, variant, variant ^ shiftleft(1L, b)))"
        ).alias("fps")
    )
    pairs = members.select(F.array_min("fps").alias("lo"), F.explode("fps").alias("hi")).where("hi <> lo")
    return pairs.where(F.expr(f"bit_count(hi ^ lo) <= {RADIUS}")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id reachable over links of
    at most two differing bits, itself included; null ids are never the smallest, a component of
    null ids alone has a null component_id. Null, empty and blank texts share fingerprint zero and
    are linked like any other. Texts of any length are hashed whole. Equal rows stay and share a component.
    Other columns are not read. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, k), "fps")
    firsts = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(links(firsts))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """docs without the near duplicates: of each component, the row of the smallest id, then of the smallest hash of its text, stays with all its columns.

    near gives the components of (doc_id, text). Ids need not be unique: rows of one id and unlike texts are in
    components of their own. Of rows that repeat id and text one stays. Null ids are never the smallest.
    """
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    found = near(docs.select(row.alias("doc_id"), F.col(text_col).alias("text")))
    key, hashed = free_name(docs, "_kept"), free_name(docs, "_hash")
    heads = found.where("doc_id <=> component_id").groupBy(F.col("doc_id.id").alias(key), F.col("doc_id.hash").alias(hashed))
    stays = materialize(heads.agg(F.count("*").alias("n")), "stays")
    kept = docs.join(stays.select(key, hashed), docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(hashed)), "left_semi")
    return kept if stays.where("n > 1").isEmpty() else kept.dropDuplicates([id_col, text_col])
