"""Links between alike sets that texts are made into; no pair of the asked Jaccard is lost.

Prefix filtering: of a set's n members, in one order that holds for all sets, the first
n - ceil(least * n) + 1 are its probes, and two sets of that likeness share a probe. The order puts
members that a sample of the texts finds common last; whatever the sample holds, the result is the same.
Sets are partitioned by length, in classes whose bounds grow by 1 / least, so that a link joins sets of one
class or of two neighbours. Sets that meet in a probe are compared by their sizes, by where they meet, then by the
parity of their members in each of one to two times as many places (sets differ in at least as many members as
parities), and at last member by member.

Where sets have a SimHash fingerprint, fingerprints within its radius link them first, found by ball hashing (simhash.links)
and checked like all other pairs; the search above is then for links between sets that these have not connected.

Lists are built and searched in rounds, each over a share of the probes, so that what is shuffled at once stays a part of the table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from frameloom.llm import simhash
from frameloom.llm.common import map_batches, materialize, merged, release, rows_of, sample_share
from frameloom.llm.graph import components

LEAST_LIKENESS = 0.8
SEED = 5
#: Texts that are asked for common members, about, and how many of the commonest are told to the workers.
SAMPLE, COMMON = 8000, 1 << 18
#: Sets that stand side by side in a probe's list; lists that are longer by the sample are dealt out.
LIST_ROWS = 1000
#: In lists of more than SOME sets, pairs are told apart by their parities where they meet; in those of more than MANY,
#: a pair is also taken in the first list that it shares alone, for which each set brings its probes along.
SOME, MANY = 16, 64
#: Sets whose lists are built in one round, rows of lists that are searched in one, and rounds at most.
ROUND_SETS, ROUND_ROWS, ROUNDS = 1 << 16, 1 << 20, 16
#: Places of the bit map that says which texts' members are wanted again.
WANTED = 1 << 24

#: A text's UTF-8 (None for null) to its set: sorted distinct 64-bit numbers.
MakeSet = Callable[[bytes | None], np.ndarray]


def n_probes(n: int, least: float) -> int:
    return n - int(np.ceil(n * least - 1e-9)) + 1 if n else 0


def parities(sigs: np.ndarray) -> np.ndarray:
    """A bit for each place, in words of 64. There is a power of two of places, so that a half exclusive-ored with the other half has half as many."""
    places = max(64, 1 << (max(len(sigs), 1) - 1).bit_length())
    return np.packbits(np.bincount((sigs % np.uint64(places)).astype(np.int64), minlength=places) & 1).view("<i8")


def digest(sigs: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit digest, in two signed halves."""
    return tuple(np.array(divmod(xxhash.xxh3_128_intdigest(sigs.tobytes()), 1 << 64), np.uint64).view(np.int64).tolist())


def _name(sigs: np.ndarray, clashes: frozenset[int]) -> tuple[int, int]:
    """(what a set goes by, the rest of its digest): half of its digest, or where unlike sets share that, a hash of all of it."""
    check, fp = digest(sigs)
    return (int(np.uint64(xxhash.xxh64_intdigest(sigs.tobytes(), SEED)).view(np.int64)) if fp in clashes else fp), check


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return [t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column("text")]


def _common(named: DataFrame, share: float, make: MakeSet) -> tuple[np.ndarray, np.ndarray]:
    """(members, sorted; in how many texts of the sample each is) of those in two or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([make(t).view(np.int64) for t in _texts(batch)], pa.list_(pa.int64()))], ["sigs"])

    some = map_batches(sample_share(named.select("key", "text"), "key", share, SEED).dropDuplicates(["key"]), run, "sigs array<long>")
    often = some.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "sig").limit(COMMON).toArrow()
    sigs, counts = (often.column(c).to_numpy() for c in ("sig", "n"))
    order = np.argsort(sigs.view(np.uint64))
    return sigs.view(np.uint64)[order], counts[order]


class Marker:
    """Marks sets for the search of links: names them, and chooses their probes by what a sample of the texts finds common.

    fingerprint: a set's SimHash, for a further mark, simhash.
    """

    kinds = {"fp": pa.int64(), "check": pa.int64(), "n": pa.int32(), "bits": pa.list_(pa.int64()), "probes": pa.list_(pa.int64()), "lots": pa.list_(pa.int32())}
    ddl = "fp long, check long, n int, bits array<long>, probes array<long>, lots array<int>"

    def __init__(self, docs: DataFrame, make: MakeSet, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_LIKENESS, fingerprint: Callable[[np.ndarray], int] | None = None):
        self.fingerprint = fingerprint
        if fingerprint:
            self.kinds, self.ddl = self.kinds | {"simhash": pa.int64()}, f"{self.ddl}, simhash long"
        self.named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
        self.make, self.least = make, least
        share = min(1.0, SAMPLE / max(self.named.count(), 1))
        self.common = docs.sparkSession.sparkContext.broadcast((*_common(self.named, share, make), LIST_ROWS * share))
        self.clashes: frozenset[int] = frozenset()

    def mark(self) -> Callable[[np.ndarray], tuple]:
        """set -> (fp, check, n, bits, probes, lots) and its fingerprint, if asked for, to be called on the workers; lot: which part of a long list a set is in, -1 if the list is whole."""
        common_, least, clashes, fingerprint = self.common, self.least, self.clashes, self.fingerprint

        def of(sigs: np.ndarray) -> tuple:
            common, often, part = common_.value
            (fp, check), times = _name(sigs, clashes), np.zeros(len(sigs), np.int64)
            if len(common) and len(sigs):
                at = np.minimum(np.searchsorted(common, sigs), len(common) - 1)
                times = np.where(common[at] == sigs, often[at], 0)
            order = np.lexsort((sigs, times))[: n_probes(len(sigs), least)]
            parts = np.ceil(times[order] / part).astype(np.int64)
            own = (fingerprint(sigs),) if fingerprint else ()
            return fp, check, len(sigs), parities(sigs), sigs[order].view(np.int64), np.where(parts > 1, fp % np.maximum(parts, 1), -1).astype(np.int32), *own

        return of

    def marked(self) -> DataFrame:
        """(doc_id, key, fp, check, n, bits, probes, lots) and the fingerprint, if asked for, for each row."""
        mark, make, kinds = self.mark(), self.make, self.kinds

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [mark(make(text)) for text in _texts(batch)]
            cells = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *cells], ["doc_id", "key", *kinds])

        return map_batches(self.named, run, f"doc_id {self.named.schema['doc_id'].dataType.simpleString()}, key long, {self.ddl}")


def _sizes_fit(n: str, m: str, least: float) -> Column:
    return F.least(n, m) >= least * F.greatest(n, m) - 1e-9


def _room(n: str, m: str, at: str, other_at: str, least: float) -> Column:
    """Whether sets that first meet at these places of their order still have so many shingles in common: from there on, at most the shorter rest."""
    rest = F.least(F.col(n) - F.col(at), F.col(m) - F.col(other_at))
    return rest >= (F.col(n) + F.col(m)) * (least / (1 + least)) - 1e-9


def _apart(a: str, b: str) -> Column:
    """In how many shingles, at least, two sets differ, by their parities."""
    words = f"least(size({a}), size({b}))"
    one, other = (f"aggregate(sequence(i, size({c}) - 1, {words}), 0L, (w, j) -> w ^ {c}[j])" for c in (a, b))
    return F.expr(f"aggregate(sequence(0, {words} - 1), 0, (d, i) -> d + bit_count({one} ^ {other}))")


def _most(n: str, m: str, least: float) -> Column:
    """In how many shingles two sets of that likeness differ at most."""
    return (F.col(n) + F.col(m)) * ((1 - least) / (1 + least)) + 1e-9


def _close(pairs: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """Those of distinct pairs(hi, lo) whose sizes and parities do not rule the likeness out."""
    x, y = (heads.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("hi", "lo"))
    met = pairs.distinct().join(merged(x), "hi").join(merged(y), "lo").where(_sizes_fit("n_hi", "n_lo", least))
    return met.where(_apart("bits_hi", "bits_lo") <= _most("n_hi", "n_lo", least)).select("hi", "lo")


def _sets(marker: Marker, heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """The table of (fp, sigs) of all sets in pairs, read from the texts again; a bit map keeps the others' from being hashed and dealt out, but for the few that share a place."""
    named, make, clashes = marker.named, marker.make, marker.clashes
    ends = pairs.select(F.explode(F.array("hi", "lo")).alias("fp")).distinct()
    wanted = heads.join(merged(ends), "fp", "left_semi").select(F.pmod("key", F.lit(WANTED)).alias("at"))
    words = wanted.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(WANTED // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = named.sparkSession.sparkContext.broadcast(bitmap)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.column("key").to_numpy() % WANTED
        batch = batch.filter(pa.array((shared.value[at // 64] >> (at % 64) & 1).astype(bool)))
        sets = [make(t) for t in _texts(batch)]
        return pa.RecordBatch.from_arrays([pa.array([_name(s, clashes)[0] for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["fp", "sigs"])

    sets = map_batches(named.select("key", "text"), run, "fp long, sigs array<long>")
    sets = materialize(sets.groupBy("fp").agg(F.first("sigs").alias("sigs")), "sets", 2 * rows_of(pairs))
    shared.destroy()
    return sets


def linked(marker: Marker, marked: DataFrame) -> DataFrame:
    """(doc_id, key, fp, check, n, root) for each row that the marker has marked: key is XXH64 of the text, (fp, check) names its set of n members, root is shared by all rows reachable over links of a likeness of least or more.

    Equal sets are one. Links are sought in two steps, so that a large group of near copies does not meet
    pair by pair: first between fingerprints that ball hashing links, if there are any, and of each set with the first of each of its probes' lists and with the one before it, in an
    order of each list's own, which connects what is alike at large; then, exactly, those that meet and are not
    connected: in each list the sets outside its largest group with all others of like length. In lists of many sets,
    pairs are told apart by their parities where they meet, and taken in the first list that they share alone.
    Null, empty and blank texts share the empty set. Repeated rows stay; an empty table gives no rows. marked is a table
    that can be read again and again; the result reads it too.
    """
    least = marker.least
    while True:
        filled = marked.where("n > 0").groupBy("fp")
        own = [F.first("simhash").alias("simhash")] if marker.fingerprint else []
        heads = materialize(filled.agg(F.first("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits"), (F.min("check") != F.max("check")).alias("clash"), *own), "heads")
        # of n sets about n * n / 2 ** 65
        found = {r["fp"] for r in heads.where("clash").select("fp").collect()}
        if not found:
            break
        marker.clashes |= found
        marked = materialize(marker.marked(), "marked")
    marker.common.destroy()
    met = _met(filled, _rounds(rows_of(heads), ROUND_SETS))
    n_met = sum(map(rows_of, met))
    lists = reduce(DataFrame.union, met)

    first = lists.where("before is not null").select("fp", "n", "at", F.explode(F.array("before", "head")).alias("to")).select("fp", "n", "at", F.col("to.fp").alias("to"), F.col("to.n").alias("m"), F.col("to.at").alias("other_at"))
    first = first.where(_sizes_fit("n", "m", least) & _room("n", "m", "at", "other_at", least)).select(F.greatest("fp", "to").alias("hi"), F.least("fp", "to").alias("lo"))
    alike = [_fingerprinted(heads)] if marker.fingerprint else []
    beside = materialize(_close(reduce(DataFrame.union, alike, first), heads, least), "beside", 2 * n_met + sum(map(rows_of, alike)))
    release(*alike)
    links = _links(beside, marker, heads)
    size_class = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / least)) + 1e-9).cast("int").alias("class")
    roots = merged(components(links, rows_of(links)))
    grouped = materialize(lists.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "at", "sig", size_class, F.coalesce("root", "fp").alias("root")), "grouped")
    release(*met)
    rounds = _rounds(n_met, ROUND_ROWS)
    shares = [grouped.where(F.pmod("sig", F.lit(rounds)) == i) for i in range(rounds)] if rounds > 1 else [grouped]
    crossing = [_crossing(share, marked, heads, least) for share in shares]
    release(grouped)
    rest = _close(reduce(DataFrame.union, crossing), heads, least)
    more = _links(materialize(rest, "rest"), marker, heads)
    roots = components(links.union(more), rows_of(links) + rows_of(more))
    return marked.join(merged(roots), F.col("fp") == F.col("node"), "left").select("doc_id", "key", "fp", "check", "n", F.coalesce("root", "fp").alias("root"))


def _rounds(rows: int, in_one: int) -> int:
    return max(1, min(ROUNDS, -(-rows // in_one)))


def _met(filled: GroupedData, rounds: int) -> list[DataFrame]:
    """Tables of (fp, n, at, sig, lot, before, head): each set in each of its probes' lists that others are in too, or that was dealt out; with the one before it there, and the first."""
    beside = Window.partitionBy("sig", "lot").orderBy(F.xxhash64("sig", "fp"), "fp")
    one = F.struct("fp", "n", "at")
    probes = F.arrays_zip(F.col("probes").alias("sig"), F.col("lots").alias("lot"), F.sequence(F.lit(0), F.size("probes") - 1).alias("at"))

    def built(i: int) -> DataFrame:
        share = F.filter(probes, lambda p: F.pmod(p["sig"], F.lit(rounds)) == i) if rounds > 1 else probes
        lists = filled.agg(F.first("n").alias("n"), F.first(share).alias("probes")).select("fp", "n", F.inline("probes"))
        lists = lists.select("fp", "n", "at", "sig", "lot", F.lag(one).over(beside).alias("before"), F.first(one).over(beside).alias("head"), F.lead("fp").over(beside).alias("after"))
        return materialize(lists.where("before is not null or after is not null or lot >= 0").drop("after"), "met")

    return [built(i) for i in range(rounds)]


def _fingerprinted(heads: DataFrame) -> DataFrame:
    """The table of pairs(hi, lo) of sets that SimHash finds alike: the least of each fingerprint's sets with its others, and with the least of each that ball hashing links to it."""
    first = materialize(heads.groupBy("simhash").agg(F.min("fp").alias("first")), "fingerprints")
    same = heads.join(merged(first), "simhash").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    x, y = (first.select(F.col("simhash").alias(c), F.col("first").alias(to)) for c, to in (("hi", "a"), ("lo", "b")))
    near = simhash.links(first.select(F.col("simhash").alias("fp"))).join(merged(x), "hi").join(merged(y), "lo").select("a", "b")
    pairs = materialize(same.union(near).where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), "alike")
    release(first)
    return pairs


def _crossing(grouped: DataFrame, marked: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """The table of pairs(hi, lo) of sets of two groups that meet in one of these lists and may be alike."""
    sizes = grouped.groupBy("sig", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("sig").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.count("*").alias("groups"), F.sum("size").alias("sets")).where("groups > 1").drop("groups")
    met = apart = materialize(grouped.join(merged(largest), "sig"), "apart")
    few = apart.where(F.col("sets") <= SOME).withColumn("bits", F.lit(None).cast("array<long>"))
    some = apart.where(F.col("sets") > SOME).join(merged(heads.select("fp", "bits")), "fp")
    apart = few.unionByName(some)
    many = apart.where(F.col("sets") > MANY)
    told = marked.join(merged(many.select("fp").distinct()), "fp", "left_semi").groupBy("fp").agg(F.first("probes").alias("probes"))
    apart = apart.where(F.col("sets") <= MANY).withColumn("probes", F.lit(None).cast("array<long>")).unionByName(many.join(merged(told), "fp"))
    x, y = (apart.select("sig", "class", *(F.col(c).alias(f"{c}_{side}") for c in ("fp", "n", "at", "root", "largest", "bits", "probes"))) for side in "ab")
    x = x.where("root_a <> largest_a").withColumn("class", F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1)))))
    # of two sets that are both outside the largest group, the pair is taken once
    once = (F.col("root_b") == F.col("largest_b")) | (F.col("fp_a") < F.col("fp_b"))
    fits = (F.col("root_a") != F.col("root_b")) & once & _sizes_fit("n_a", "n_b", least) & _room("n_a", "n_b", "at_a", "at_b", least)
    near = F.col("bits_a").isNull() | (_apart("bits_a", "bits_b") <= _most("n_a", "n_b", least))
    here = F.col("probes_a").isNull() | (F.get(F.array_intersect("probes_a", "probes_b"), F.lit(0)) == x["sig"])
    cross = x.join(merged(y), (x["sig"] == y["sig"]) & (x["class"] == y["class"]) & fits & F.when(near, here).otherwise(False))
    pairs = materialize(cross.select(F.greatest("fp_a", "fp_b").alias("hi"), F.least("fp_a", "fp_b").alias("lo")).distinct(), "crossing")
    release(met)
    return pairs


def _links(pairs: DataFrame, marker: Marker, heads: DataFrame) -> DataFrame:
    sets = _sets(marker, heads, pairs)
    found = materialize(_alike(pairs, sets, marker.least), "links", rows_of(pairs))
    release(pairs, sets)
    return found


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of distinct pairs(hi, lo) whose Jaccard reaches least."""
    x, y = (sets.select(F.col("fp").alias(c), F.col("sigs").alias(f"sigs_{c}")) for c in ("hi", "lo"))
    common = F.size(F.array_intersect("sigs_hi", "sigs_lo"))
    met = pairs.join(merged(x), "hi").join(merged(y), "lo").select("hi", "lo", common.alias("common"), (F.size("sigs_hi") + F.size("sigs_lo")).alias("n"))
    return met.where(F.col("common") >= least * (F.col("n") - F.col("common")) - 1e-9).select("hi", "lo")
