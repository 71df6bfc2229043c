"""Packing of token sequences by non-negative least squares over a histogram of lengths.

A document is cut into whole windows and one tail. All that packing needs of the tails is how many
there are of each length: combinations of up to three lengths that fill a window exactly are
enumerated, their repeat counts solved for against that histogram, and rounded down; what is left
of the histogram is packed greedily, combination by combination. Tails that would leave a window with a
hole are cut, first at a half of the window, then at a quarter, and so on: such heads fill windows among
themselves, and what is left of the tails is packed in the same way again.
The driver works on numbers whose count the window bounds, whatever the number of documents; each piece
finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frameloom.llm.common import map_batches, materialize

WINDOW = 1024
END_ID = 0
#: Steps of the least-squares solver; it stops when no count would change by TOLERANCE.
STEPS, TOLERANCE = 400, 0.02
#: Pieces of one length are numbered in groups of about so many, or of the root of all pieces' number if that is more:
#: groups stay small beside a task, and their counts few beside the pieces.
GROUP_ROWS = 500
#: Lengths of the heads that tails are cut into, if at all, down to those that leave no hole whatever the tails' length. The last
#: divides the others; the CRC-32 up to each of its multiples is kept, so that a cut needs no ids.
HEADS = (512, 256, 128, 64, 32, 16, 8)
GRID = HEADS[-1]
#: A window that is filled less far is not left so, but its tails are cut.
FILLED = 0.995
TOKENIZER = "byte_bpe_50k.json"


@cache
def encoder(folder: str) -> Callable[[str], np.ndarray]:
    """text -> ids of the tokenizers file byte_bpe_50k.json, add_special_tokens=False.

    The same vocabulary as tiktoken ranks gives the same ids several times faster (tests compare them);
    texts with the special token's string, and those whose white space its pattern engine gives up on,
    go to tokenizers itself.
    """
    with open(os.path.join(folder, TOKENIZER), encoding="utf-8") as file:
        special = [token["content"] for token in json.load(file)["added_tokens"]]
    with open(os.path.join(folder, TOKENIZER.replace(".json", ".tiktoken")), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return fast.encode_to_numpy(text).astype("<u4")
            except ValueError:
                pass
        return np.array(_slow(folder).encode(text, add_special_tokens=False).ids, "<u4")

    return encode


@cache
def _slow(folder: str) -> Tokenizer:
    """Loaded by the first text that needs it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(os.path.join(folder, TOKENIZER))


def tokenizer_folder() -> str:
    return os.path.dirname(public_tokenizers.path(TOKENIZER))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, marks): each document's ids and END_ID, cut into whole windows and a tail.

    marks: of a tail, the CRC-32 of its first GRID, 2 * GRID ... ids, little-endian. Null text: empty. Repeated rows are
    cut each. Other columns are not read. An empty table gives no rows.
    """
    folder = folder or tokenizer_folder()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "marks"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(folder)
        row, start, length, crcs, total, marks = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4").tobytes()
            n = len(ids) // 4
            for at in range(0, n, window):
                end, crc, upto = min(n, at + window), 0, []
                grid = range(at + GRID, end, GRID) if end - at < window else ()
                last = at
                for stop in grid:
                    crc = zlib.crc32(ids[4 * last : 4 * stop], crc)
                    upto.append(crc)
                    last = stop
                row.append(i)
                start.append(at)
                length.append(end - at)
                crcs.append(zlib.crc32(ids[4 * last : 4 * end], crc))
                total.append(n)
                marks.append(np.array(upto, "<u4").tobytes())
        cells = [*(pa.array(x, pa.int64()) for x in (start, length, crcs, total)), pa.array(marks, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *cells], names)

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, marks binary")


def crc_of_rest(whole: int, head: int, n_bytes: int) -> int:
    """CRC-32 of the last n_bytes of something, from that of all of it and of what comes before them: CRCs are linear."""
    zeros = bytes(n_bytes)
    return whole ^ zlib.crc32(zeros, head) ^ zlib.crc32(zeros)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """(n, 3): all ways to fill the window with one to three of the lengths, the longest first, 0 for none."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found = [[window, 0, 0]] if there[window] else []
    ls = np.flatnonzero(there[:window])
    out = [np.array(found, np.int64).reshape(-1, 3)]
    for a in ls:
        rest = window - a
        if rest <= a and there[rest]:
            out.append(np.array([[a, rest, 0]]))
        b = ls[(ls <= a) & (ls < rest)]
        c = rest - b
        ok = (c <= b) & there[c]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out)


def solve(combos: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Repeat counts >= 0 that bring the combinations' lengths close to the histogram, in the least-squares sense (multiplicative updates)."""
    size = len(hist)
    used = combos > 0
    flat = np.where(used, combos, 0)

    def lengths_of(x: np.ndarray) -> np.ndarray:
        h = sum(np.bincount(flat[:, k], x * used[:, k], size) for k in range(3))
        h[0] = 0
        return h

    def gain(h: np.ndarray) -> np.ndarray:
        return (h[flat] * used).sum(axis=1)

    want = hist.astype(float).copy()
    want[0] = 0
    target = gain(want)
    times = np.maximum(lengths_of(np.ones(len(combos))), 1)
    x = np.min(np.where(used, (want / times)[flat], np.inf), axis=1)
    for _ in range(STEPS):
        new = x * target / np.maximum(gain(lengths_of(x)), 1e-12)
        moved = np.abs(new - x).max(initial=0)
        x = new
        if moved < TOLERANCE:
            break
    return x


def greedy(hist: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """[(lengths, repeats)] that use up the histogram: the longest left, then again and again the longest that still fits."""
    left, out = hist.copy(), []
    while (at := np.flatnonzero(left)).size:
        room, combo = window, []
        avail = left.copy()
        while (fit := at[at <= room]).size and (fit := fit[avail[fit] > 0]).size:
            a = int(fit[-1])
            take = min(room // a, int(avail[a]))
            combo += [a] * take
            avail[a] -= take
            room -= a * take
        need = np.bincount(combo, minlength=len(left))
        times = int((left[need > 0] // need[need > 0]).min())
        left -= need * times
        out.append((combo, times))
    return out


class _Level:
    """A histogram's pieces: those with the first ranks of their length fill windows, the others are cut and left to the next level."""

    def __init__(self, hist: np.ndarray, window: int, head: int, first_sequence: int):
        """head: length of the heads that are cut off; 0: nothing is cut, and all pieces get a place."""
        left = hist.astype(np.int64).copy()
        chosen: list[tuple[list[int], int]] = []
        ls = np.flatnonzero(left)
        combos = combinations(ls, window) if len(ls) else np.zeros((0, 3), np.int64)
        x = np.floor(solve(combos, left) + 1e-9).astype(np.int64) if len(combos) else np.zeros(0, np.int64)
        for i in np.argsort(-x, kind="stable"):
            if x[i] <= 0:
                break
            combo = [int(n) for n in combos[i] if n]
            need = {n: combo.count(n) for n in combo}
            times = min(int(x[i]), *(int(left[n]) // k for n, k in need.items()))
            if times > 0:
                for n, k in need.items():
                    left[n] -= k * times
                chosen.append((combo, times))
        for combo, times in greedy(left, window):
            if not head or sum(combo) >= FILLED * window:
                chosen.append((combo, times))
                for n in combo:
                    left[n] -= times
        self.head, self.cut_from = head, hist.astype(np.int64) - left
        #: the next level's pieces, and the ranks that the first cut piece of each length has there, as a head and as a rest
        self.next = np.zeros(len(hist), np.int64)
        self.head_rank, self.rest_rank = np.zeros(len(hist), np.int64), np.zeros(len(hist), np.int64)
        for n in np.flatnonzero(left):
            for part, rank in ((min(n, head), self.head_rank), (n - head, self.rest_rank)):
                if part > 0:
                    rank[n] = self.next[part]
                    self.next[part] += left[n]
        rows, sequence, ranks = [], first_sequence, np.zeros(len(hist), np.int64)
        for combo, times in chosen:
            offset = 0
            for n in combo:
                rows.append((n, ranks[n], sequence, offset))
                ranks[n] += times
                offset += n
            sequence += times
        rows.sort()
        self.length, self.first, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 4).T.copy()
        self.sequences = sequence

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these ranks among those of their length."""
        shift = 1 << 44
        at = np.searchsorted(self.length * shift + self.first, length * shift + rank, "right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


class Plan:
    """Where the pieces of each length go, and how they are cut."""

    def __init__(self, hist: np.ndarray, window: int = WINDOW):
        """hist[n]: how many pieces of n ids there are."""
        self.window, self.ids = window, int((np.arange(len(hist)) * hist).sum())
        self.levels: list[_Level] = []
        for head in (*HEADS, 0):
            self.levels.append(_Level(hist, window, head, self.levels[-1].sequences if self.levels else 0))
            hist = self.levels[-1].next
        self.sequences = self.levels[-1].sequences

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the pieces with these ranks among those of their length, a row for each part: (number of the piece, where the part begins in it, its length, sequence, offset), sorted by piece and beginning."""
        of, at, out = np.arange(len(length)), np.zeros(len(length), np.int64), []
        for level in self.levels:
            stays = rank < level.cut_from[length]
            out.append((of[stays], at[stays], length[stays], *level.place(length[stays], rank[stays])))
            of, at, length, rank = of[~stays], at[~stays], length[~stays], rank[~stays] - level.cut_from[length[~stays]]
            rest = length > level.head
            parts = ((of, of[rest]), (at, at[rest] + level.head), (np.minimum(length, level.head), length[rest] - level.head), (level.head_rank[length] + rank, level.rest_rank[length[rest]] + rank[rest]))
            of, at, length, rank = map(np.concatenate, parts)
        cells = [np.concatenate(x) for x in zip(*out, strict=True)]
        order = np.lexsort((cells[1], cells[0]))
        return tuple(c[order] for c in cells)


def crc_of_part(whole: int, length: int, marks: np.ndarray, start: int, size: int) -> int:
    """CRC-32 of a part of a piece of length ids, from that of the piece and its marks."""
    upto = lambda n: 0 if not n else whole if n == length else int(marks[n // GRID - 1])
    return crc_of_rest(upto(start + size), upto(start), 4 * size) if start else upto(size)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row of docs lies in exactly one piece; a sequence's pieces lie gapless from
    offset 0. Null and empty texts are one piece of END_ID alone. Repeated rows are packed each. Other columns are
    not read. An empty table gives no rows. Texts are tokenized once; the pieces' table is written before packing.
    """
    cut = materialize(pieces(docs, id_col, text_col, folder, window), "pieces")
    hist = np.zeros(window + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        hist[r["length"]] = r["n"]
    group_rows = max(GROUP_ROWS, int(np.sqrt(hist.sum())))
    groups = F.get(F.array(*(F.lit(int(max(1, -(-n // group_rows)))) for n in hist)), F.col("length").cast("int"))
    cut = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), groups))
    counts = materialize(cut.groupBy("length", "_group").agg(F.count("*").alias("n")), "counts")
    plan = docs.sparkSession.sparkContext.broadcast(Plan(hist, window))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "start", "ids_crc32"))
    ranked = cut.withColumn("_within", within).join(bases, ["length", "_group"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = ranked.select(*columns, "marks", (F.col("_base") + F.col("_within") - 1).alias("rank"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        start, length, crc, total = (batch.column(i).to_numpy() for i in range(1, 5))
        of, at, size, sequence, offset = plan.value.place(length, batch.column(6).to_numpy())
        crc = crc[of].copy()
        for i in np.flatnonzero(size < length[of]):
            crc[i] = crc_of_part(int(crc[i]), int(length[of[i]]), np.frombuffer(batch.column(5)[int(of[i])].as_py(), "<u4"), int(at[i]), int(size[i]))
        cells = [pa.array(x, pa.int64()) for x in (start[of] + at, size, crc, total[of], sequence, offset)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *cells], [*columns, "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(ranked, run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
