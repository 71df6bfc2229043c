"""How a language's sources differ in their words: divergences of all pairs of sources, and each source's most typical terms.

Texts become terms in Arrow batches: a lookup table over the batch's concatenated UTF-8 says which bytes belong to a term,
boundaries fall where that changes, and slices are grouped by their XXH64 and then compared byte by byte with the first of
their group. Spark adds up the groups' counts. Terms that stay are dealt into blocks; a block is a sparse matrix of
sources by terms (CSR), in which a pair's divergence is what all terms would add were both sources without them, corrected
where one has an entry, summed row by row with reduceat. Probabilities are whole billionths, so that all sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import map_batches, materialize, release

#: A term is kept where so many documents of its language have it.
LEAST_DOCS = 30
#: Added to each count.
SMOOTHING = 5
UNIT = 1_000_000_000
#: Ranks of a source's terms that are reported.
TERMS = 50
#: Entries of a block, about: as many as it has pairs, but within these bounds.
CELLS, MOST_CELLS = 1 << 14, 1 << 21
#: Pairs that one task gives of a block; blocks of more pairs are dealt to several.
PAIRS = 1 << 20
#: Slices of more bytes are compared one by one, others so many at once.
LONG = 1 << 10

#: What a byte is in a term: itself, A-Z in lower case, or 0 where no term has it.
TABLE = np.arange(256, dtype=np.uint8)
TABLE[ord("A") : ord("Z") + 1] += 32
TABLE[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each term in texts that lie one after the other: text i is data[offsets[i]:offsets[i + 1]], lower-cased by TABLE."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = data != 0
    new = np.zeros(len(data) + 1, bool)
    new[offsets] = True
    starts, ends = inside.copy(), ~inside
    starts[1:] &= ~inside[:-1] | new[1:]
    ends |= new
    ends[1:] &= inside[:-1]
    ends[0] = False
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return np.searchsorted(offsets, start, "right") - 1, start, end


def grouped(data: np.ndarray, start: np.ndarray, end: np.ndarray, hash_of=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(each slice's group, each group's first slice): slices are in one group exactly if their bytes are equal."""
    raw, n = data.tobytes(), len(start)
    hashes = np.fromiter((hash_of(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, n)
    _, firsts, group = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = end - start
    unlike = np.arange(n)
    while True:  # once, but for collisions
        head = firsts[group[unlike]]
        same = sizes[unlike] == sizes[head]
        same[same] = _equal(data, start[unlike[same]], start[head[same]], sizes[unlike[same]])
        unlike = unlike[~same]
        if not len(unlike):
            return group, firsts
        _, first, inverse = np.unique(hashes[unlike], return_index=True, return_inverse=True)
        group[unlike] = len(firsts) + inverse
        firsts = np.concatenate((firsts, unlike[first]))


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the slices at a and at b, sizes long (over 0), have equal bytes. What is looked at in one go is bounded."""
    out = np.empty(len(sizes), bool)
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = np.array_equal(data[a[i] : a[i] + sizes[i]], data[b[i] : b[i] + sizes[i]])
    short = np.flatnonzero(sizes <= LONG)
    for at in range(0, len(short), LONG):
        some = short[at : at + LONG]
        k = sizes[some]
        begin = np.cumsum(k) - k
        within = np.arange(k.sum()) - np.repeat(begin, k)
        out[some] = ~np.logical_or.reduceat(data[np.repeat(a[some], k) + within] != data[np.repeat(b[some], k) + within], begin)
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, in a row and by TABLE; where each begins, and where the last ends)."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return TABLE[held], at - at[0]


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of (text, lang, source): a row for each term of each pair of lang and source, and one without a term."""
    data, offsets = _texts(batch.column(0))
    pairs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
    numbers = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
    owner = np.array([numbers[p] for p in pairs])
    text, start, end = boundaries(data, offsets)
    group, firsts = grouped(data, start, end)
    width = max(len(firsts), 1)
    cells, n = np.unique(owner[text] * width + group, return_counts=True)
    docs = np.bincount(np.searchsorted(cells, _cells(text, group, owner, width)), minlength=len(cells))
    raw, names = data.tobytes(), list(numbers)
    who, which = np.divmod(cells, width)
    first, last = start[firsts].tolist(), end[firsts].tolist()
    terms = [raw[first[g] : last[g]] for g in which.tolist()]
    rows = [names[i] for i in who.tolist()] + names
    none = np.zeros(len(names), np.int64)
    cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([*terms, *[None] * len(names)], pa.binary())]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate((n, none)), pa.int64()), pa.array(np.concatenate((docs, none)), pa.int64())], ["lang", "source", "term", "n", "docs"])


def _cells(text: np.ndarray, group: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """The cell of each distinct pair of text and group."""
    text, group = np.divmod(np.unique(text * width + group), width)
    return owner[text] * width + group


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly for totals up to 2 ** 53: the quotient is made three digits at a time."""
    total = total + SMOOTHING * terms
    share, rest = np.divmod(count + SMOOTHING, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        share = share * 1000 + digits
    return share + 1


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, head) of the kept terms: occurrences in the source and in the language; head: one row of each of a language's terms.

    Each pair of lang and source that occurs has one more row, whose term is null. Nulls count as empty texts.
    """
    empty = F.lit("")
    named = docs.select(F.coalesce(F.col(text_col), empty).cast("binary").alias("text"), F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"))
    counts = map_batches(named, _count, "lang string, source string, term binary, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    told = counts.select("lang", "source", F.col("term").cast("string").alias("term"), "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("all"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("head"))
    return told.where(F.col("term").isNull() | (F.col("all") >= least_docs)).drop("all")


def _langs(counts: DataFrame) -> DataFrame:
    """(lang, lang_total, terms, blocks, parts) as a written table, whose size says whether it can be sent to the entries: else all of a language's would meet in one task."""
    kept = F.col("term").isNotNull()
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum((kept & F.col("head")).cast("long")).alias("terms"), F.count("term").alias("entries"), F.sum((~kept).cast("long")).alias("sources"))
    pairs = F.col("sources") * F.col("sources")
    cells = F.greatest(F.lit(CELLS), F.least(F.lit(MOST_CELLS), pairs))
    return materialize(langs.select("lang", "lang_total", "terms", F.greatest(F.lit(1), F.ceil(F.col("entries") / cells)).cast("int").alias("blocks"), F.ceil(pairs / PAIRS).cast("int").alias("parts")), "langs", 1)


def _blocks(counts: DataFrame, langs: DataFrame) -> DataFrame:
    """The rows of all blocks: (lang, block, part, parts, source, term, n, lang_n, total, lang_total, terms).

    Each block has its language's sources, without a term, and the entries of its terms; those of more than PAIRS pairs are dealt out in parts, each of which
    gives the pairs of every parts-th source.
    """
    kept = F.col("term").isNotNull()
    sources = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n")
    rows = sources.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "block", "parts", "source", *none, "total", "lang_total", "terms")
    entries = counts.where(kept).join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "parts", "source", "term", "n", "lang_n", F.lit(None).cast("long").alias("total"), "lang_total", "terms")
    return rows.unionByName(entries).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How far all points lie from each of to, summed."""
    points = np.sort(points)
    sums = np.concatenate(([0], np.cumsum(points)))
    below = np.searchsorted(points, to)
    return to * (2 * below - len(points)) + sums[-1] - 2 * sums[below]


def _diverge(rows: pa.Table) -> pa.Table:
    """A block's pairs of sources (the lesser first) and what its terms add to each; and of each source, the block's first TERMS of those that it has more often than its language."""
    lang, block, part, parts, all_terms, lang_total = (rows.column(c)[0].as_py() for c in ("lang", "block", "part", "parts", "terms", "lang_total"))
    base = rows.filter(rows.column("term").is_null()).sort_by("source")
    entries = rows.filter(rows.column("term").is_valid())
    names, totals = base.column("source").to_pylist(), base.column("total").to_numpy()
    number = {s: i for i, s in enumerate(names)}
    terms = sorted(set(entries.column("term").to_pylist()), key=str.encode)
    column = {t: i for i, t in enumerate(terms)}
    if not all_terms:  # no term of the language is kept: nothing differs
        n, share = 0, np.zeros(0, np.int64)
        bare = np.zeros(len(names), np.int64)
        indptr, indices = np.zeros(len(names) + 1, np.int64), np.zeros(0, np.int64)
        of_lang = share
    else:
        n = len(terms)
        row = np.array([number[s] for s in entries.column("source").to_pylist()], np.int64)
        col = np.array([column[t] for t in entries.column("term").to_pylist()], np.int64)
        order = np.lexsort((col, row))
        row, indices = row[order], col[order]
        indptr = np.searchsorted(row, np.arange(len(names) + 1))
        share = shares(entries.column("n").to_numpy()[order], totals[row], all_terms)
        bare = shares(np.zeros(len(names), np.int64), totals, all_terms)
        of_lang = shares(entries.column("lang_n").to_numpy()[order], lang_total, all_terms)
    out = [[], [], [], [], []]

    def add(source: list, kind: str, item: list, value: np.ndarray) -> None:
        for cells, new in zip(out, (source, [kind] * len(item), item, value.tolist()), strict=False):
            cells.extend(new)

    filled = np.flatnonzero(np.diff(indptr))
    dense = np.empty(n, np.int64)
    for i in range(part, len(names), parts):
        own = slice(indptr[i], indptr[i + 1])
        dense[:] = bare[i]
        dense[indices[own]] = share[own]
        # were the others without any term, then what their entries change
        value = _distances(share[own], bare[i + 1 :]) + (n - (own.stop - own.start)) * np.abs(bare[i + 1 :] - bare[i])
        later = filled[filled > i]
        if len(later):
            begin = indptr[later[0]]
            here, who = dense[indices[begin:]], np.repeat(np.arange(len(names)), np.diff(indptr))[begin:]
            change = np.abs(share[begin:] - here) - np.abs(bare[who] - here)
            value[later - i - 1] += np.add.reduceat(change, indptr[later] - begin)
        add([names[i]] * len(value), "pair", names[i + 1 :], value)
        f = share[own] - of_lang[own]
        best = np.lexsort((indices[own], -f))[:TERMS]
        best = best[f[best] > 0]
        add([names[i]] * len(best), "term", [terms[c] for c in indices[own][best].tolist()], f[best])
    cells = [pa.array([lang] * len(out[0]), pa.string()), *(pa.array(c, pa.string()) for c in out[:3]), pa.array(out[3], pa.int64())]
    return pa.Table.from_arrays(cells, ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language, as billionths of probability.

    part pair: item is another source of the language, value the sum over the language's kept terms of how far their
    probabilities in the two lie apart; all of them. part term: item is a kept term that the source has, and has
    more often than its language; the TERMS of the largest difference. rank: from 1, the largest value first, then the
    items in the order of their UTF-8.

    A term is a run of letters A-Z, lower-cased, and characters beyond ASCII; a language keeps those that least_docs of its
    rows have. Null texts, languages and sources count as empty ones. A source without terms has the probabilities of no
    occurrence; where a language keeps none, values are 0. Rows that repeat count each. Terms of any length are
    whole. Other columns are not read. An empty table gives no rows.
    """
    counts = materialize(term_counts(docs, text_col, lang_col, source_col, least_docs), "counts")
    langs = _langs(counts)
    blocks = _blocks(counts, langs).groupBy("lang", "block", "part")
    found = materialize(blocks.applyInArrow(_diverge, "lang string, source string, part string, item string, value long"), "blocks")
    release(counts, langs)
    pair = F.col("part") == "pair"
    sums = found.where(pair).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", both.alias("p"), "value").select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(found.where(~pair)).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TERMS))
