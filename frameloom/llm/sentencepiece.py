"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

The pieces of a trained model file form a lattice over each word. Forward filtering sums the weights
of all ways to reach each position; backward sampling walks from the word's end, choosing each piece
by its share of that sum. No piece crosses a word's beginning, so that the lattice falls into words:
each distinct word is filtered once, and all words of a batch are sampled together, one piece a step.
The random numbers are a hash of the seed, the row's key, the word's number in the row and the step:
the same row gets the same segmentation however the table is partitioned.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import map_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Weight of a piece is (rank + RANK_OFFSET) ** -ALPHA: merge ranks fall about as frequencies do. ALPHA 0 would make
#: all segmentations alike; a large one gives the likeliest.
ALPHA, RANK_OFFSET = 1.0, 100.0
#: Weight of a character that the model has no piece for; it becomes its bytes' pieces.
OTHER_WEIGHT = 1e-4
SEED = 9
#: A worker keeps the lattices of the words it has met until there are so many words, or arcs.
KEPT_WORDS, KEPT_ARCS = 300_000, 1 << 23
#: Words that are sampled together, and characters of new words that are filtered together (one word at least).
_AT_ONCE, _CHARS_AT_ONCE = 1 << 18, 1 << 18
#: Blanks and what follows them up to the next blank; of any length.
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Lattices:
    """The lattices of all words met, as flat arrays that grow.

    A node is a position of a word; its arcs are the pieces that end there, with the cumulated share of
    the forward weight: node + share.
    The pieces form a trie, whose edges are a sorted array of (node, character).
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        normal = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = np.array([sp.id_to_piece(i).encode() for i in range(self.size)], object)
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.text[self.byte] = [bytes([b]) for b in range(256)]
        edges: dict[tuple[int, int], int] = {}
        piece_at = {}
        for n, i in enumerate(normal):
            at = 0
            for c in map(ord, sp.id_to_piece(i)):
                at = edges.setdefault((at, c), len(edges) + 1)
            piece_at[at] = i, (n + RANK_OFFSET) ** -ALPHA
        keys = np.array([node << 21 | c for node, c in edges], np.int64)
        order = np.argsort(keys)
        self.edges, self.targets = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.roots = np.zeros(0x110000, np.int32)
        for (node, c), to in edges.items():
            if not node:
                self.roots[c] = to
        self.piece_at, self.weight_at = np.full(len(edges) + 1, -1, np.int64), np.zeros(len(edges) + 1)
        for at, (i, w) in piece_at.items():
            self.piece_at[at], self.weight_at[at] = i, w
        self.clear()

    def clear(self) -> None:
        self.end: dict[str, int] = {}
        self.nodes = self.arcs = 0
        self.cum, self.piece, self.back = np.zeros(1 << 16), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int8)
        #: which nodes are a word's beginning
        self.first = np.zeros(1 << 16, bool)
        #: each node's first arc
        self.begin = np.zeros(1 << 16, np.int32)

    def add(self, words: list[str]) -> None:
        """Forward filtering of new words, all together: the weight of all ways to reach each position."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        stops = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        stop = stops[word]
        node = np.arange(len(chars)) + word  # of the position before each character
        arcs = []
        at, state = np.arange(len(chars)), self.roots[chars].astype(np.int64)
        lone = np.flatnonzero((state == 0) | (self.piece_at[state] < 0))  # characters without a piece stand for their bytes
        arcs.append((lone, np.ones(len(lone), np.int8), self.size + chars[lone], np.full(len(lone), OTHER_WEIGHT)))
        met, length = state > 0, 0
        while at.size:
            if length:
                keys = state << 21 | chars[at + length]
                e = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
                met = self.edges[e] == keys
                state = self.targets[e]
            length += 1
            at, state = at[met], state[met]
            found = self.piece_at[state] >= 0
            arcs.append((at[found], np.full(found.sum(), length, np.int8), self.piece_at[state[found]], self.weight_at[state[found]]))
            more = at + length < stop[at]
            at, state = at[more], state[more]
        start, back, piece, weight = (np.concatenate(x) for x in zip(*arcs, strict=True))
        place = start - (stop - sizes[word])[start]
        order = np.argsort(place.astype(np.min_scalar_type(int(place.max(initial=0)))), kind="stable")
        bounds = np.searchsorted(place[order], np.arange(sizes.max(initial=0) + 1))
        weight = np.log(weight)  # sums of long words leave a double's range
        alpha = np.full(len(chars) + len(words), -np.inf)
        alpha[(stops - sizes) + np.arange(len(words))] = 0.0
        from_, to = node[start], node[start] + back
        for k in range(len(bounds) - 1):  # arcs that start at the same place of their words end at different nodes
            i = order[bounds[k] : bounds[k + 1]]
            alpha[to[i]] = np.logaddexp(alpha[to[i]], alpha[from_[i]] + weight[i])
        order = np.argsort(to, kind="stable")
        to, from_, weight, piece, back = to[order], from_[order], weight[order], piece[order], back[order]
        share = np.cumsum(np.exp(alpha[from_] + weight - alpha[to]))
        begins = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        before = np.repeat(np.append(0.0, share[begins[1:] - 1]), np.diff(np.append(begins, len(to))))
        cum = to + np.minimum(share - before, 1.0)
        cum[np.append(begins[1:], len(to)) - 1] = to[begins] + 1.0
        begin = np.zeros(len(alpha), np.int32)
        begin[to[begins]] = begins
        self._store(cum, piece, back, (stops - sizes) + np.arange(len(words)), begin)
        self.end.update(zip(words, (self.nodes - len(alpha) + stops + np.arange(len(words))).tolist(), strict=True))

    def _store(self, cum: np.ndarray, piece: np.ndarray, back: np.ndarray, first: np.ndarray, begin: np.ndarray) -> None:
        to, nodes = self.arcs + len(cum), len(begin)
        if to > len(self.cum):
            self.cum, self.piece, self.back = (np.concatenate((x, np.zeros(max(len(x), len(cum)), x.dtype))) for x in (self.cum, self.piece, self.back))
        if self.nodes + nodes > len(self.first):
            self.first, self.begin = (np.concatenate((x, np.zeros(max(len(x), nodes), x.dtype))) for x in (self.first, self.begin))
        self.cum[self.arcs : to], self.piece[self.arcs : to], self.back[self.arcs : to] = cum + self.nodes, piece, back
        self.first[self.nodes + first] = True
        self.begin[self.nodes : self.nodes + nodes] = begin + self.arcs
        self.arcs, self.nodes = to, self.nodes + nodes


@cache
def lattices(path: str) -> Lattices:
    return Lattices(path)


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from a 64-bit mix of the word's key and the step."""
    z = key + np.uint64((step + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def escape(text: str) -> str:
    """The model's own normalisation: a blank before the text, blanks shown as U+2581; all else stays."""
    return f"{SPACE}{text.replace(' ', SPACE)}" if text else ""


def split_words(text: str) -> list[str]:
    return _WORD.findall(escape(text))


def sample(texts: list[str], keys: list[int], path: str) -> list[np.ndarray]:
    """Ids of a sampled segmentation of each text."""
    lat = lattices(path)
    ends, counts = [], []
    for text in texts:
        words = split_words(text)
        counts.append(len(words))
        ends.append(words)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[tuple[int, int, int]] = []  # text, from word, to word
    size = 0
    for t, n in enumerate(counts):
        for at in range(0, n, _AT_ONCE):
            to = min(n, at + _AT_ONCE)
            if size and size + to - at > _AT_ONCE:
                _flush(lat, group, ends, keys, out)
                group, size = [], 0
            group.append((t, at, to))
            size += to - at
    if group:
        _flush(lat, group, ends, keys, out)
    return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


def _flush(lat: Lattices, group: list[tuple[int, int, int]], ends: list[list[str]], keys: list[int], out: list[list[np.ndarray]]) -> None:
    """Backward sampling of all words of the group, a piece of each at every step."""
    if len(lat.end) > KEPT_WORDS or lat.arcs > KEPT_ARCS:
        lat.clear()
    words = [w for t, a, b in group for w in ends[t][a:b]]
    new, size = [], 0
    for w in {w: None for w in words if w not in lat.end}:
        if new and size + len(w) > _CHARS_AT_ONCE:
            lat.add(new)
            new, size = [], 0
        new.append(w)
        size += len(w)
    if new:
        lat.add(new)
    node = np.fromiter(map(lat.end.__getitem__, words), np.int64, len(words))
    cum, piece, back, first = lat.cum[: lat.arcs], lat.piece, lat.back, lat.first
    sizes = np.array([b - a for _, a, b in group])
    key = np.repeat(np.array([keys[t] for t, _, _ in group], np.uint64), sizes)
    word = np.concatenate([np.arange(a, b) for _, a, b in group]).astype(np.uint64)
    key += word * np.uint64(0x9E3779B97F4A7C15)
    live = np.arange(len(node))
    steps_word, steps_piece = [], []
    step = 0
    while live.size:
        drawn = node + _uniform(key, step)
        at = lat.begin[node]
        below = np.flatnonzero(cum[at] <= drawn)
        while below.size:  # most nodes have two arcs or three
            at[below] += 1
            below = below[cum[at[below]] <= drawn[below]]
        steps_word.append(live)
        steps_piece.append(piece[at])
        node = node - back[at]
        go = ~first[node]
        live, node, key = live[go], node[go], key[go]
        step += 1
    where = np.concatenate(steps_word)
    order = np.argsort(where[::-1], kind="stable")  # the last step is a word's first piece
    ids, where = np.concatenate(steps_piece)[::-1][order], where[::-1][order]
    bounds = np.searchsorted(where, np.cumsum(sizes)[:-1])
    if (other := np.flatnonzero(ids >= lat.size)).size:
        spelt = [lat.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in (ids[other] - lat.size).tolist()]
        ids[other] = [x[0] for x in spelt]
        ids = np.insert(ids, np.repeat(other + 1, [len(x) - 1 for x in spelt]), np.concatenate([x[1:] for x in spelt]))
        bounds += np.searchsorted(np.repeat(other, [len(x) - 1 for x in spelt]), bounds)
    for (t, _, _), part in zip(group, np.split(ids, bounds), strict=True):
        out[t].append(part)


def decode(ids: np.ndarray, path: str) -> str:
    """The text that was encoded: pieces joined, byte pieces read as UTF-8, U+2581 as a blank, the first blank dropped."""
    joined = b"".join(lattices(path).text[ids]).decode("utf-8", "surrogatepass")
    return joined.replace(SPACE, " ")[1:]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, ids) of docs: array<int> of a sampled segmentation.

    Null and empty texts: no ids. Equal ids of rows give equal samples of equal texts; a null id counts as one of its
    own. Repeated rows stay. Texts and words may be of any length. Other columns are not read. An empty table gives no rows.
    """
    path = path or public_tokenizers.path(MODEL)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sample(texts, row_keys(batch.column(0).to_pylist(), seed), path), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_rows(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) of ids arrays, as encode() gives them or any other segmentation.

    Null and empty arrays: the empty text. Repeated rows stay. Other columns are not read. An empty table gives no rows.
    """
    path = path or public_tokenizers.path(MODEL)
    df = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(np.array(x or [], np.int64), path) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_batches(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string")


def row_keys(ids: list, seed: int) -> list[int]:
    return [xxhash.xxh64_intdigest(str(i).encode(), seed) for i in ids]


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seed: int = SEED) -> DataFrame:
    """A row for each row of docs: its sampled ids' count, their CRC-32, and what decoding them gives back.

    lossless: decoding gives the text again. Texts that hold U+2581 itself can't tell it from a blank;
    there, the two are the same to the model, and lossless compares texts with each U+2581 as a blank.
    Null text counts as empty and has no ids. Repeated rows stay. Other columns are not read. An empty table gives no rows.
    """
    path = path or public_tokenizers.path(MODEL)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = {"n_pieces": pa.int64(), "ids_crc32": pa.int64(), "decoded_sha256": pa.string(), "lossless": pa.bool_()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        rows = []
        for text, ids in zip(texts, sample(texts, row_keys(batch.column(0).to_pylist(), seed), path), strict=True):
            back = decode(ids, path)
            rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text.replace(SPACE, " ")))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values()))], ["doc_id", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {kind}, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
