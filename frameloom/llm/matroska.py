"""Matroska: variable-length EBML elements, clusters, blocks with lacing, and cues, as packet tables.

parse() walks the elements of one file's bytes and gives a row for each packet (frame): track,
timestamp, byte range, key flag, lacing. write() makes a small valid file from frames, so that
any payload can be stored without loss and read back through the same parser.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import map_batches

# Element ids: fixed values of the Matroska specification.
EBML = 0x1A45DFA3
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that end a cluster or segment of unknown size.
TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

TRACK_NUMBERS = {TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits", DEFAULT_DURATION: "duration"}
CUE_FIELDS = [CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION]

FRAME = 576
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 32
RATE = 8000


#: Master elements deeper than this are taken for damage; the format needs five levels.
DEEPEST = 16


class Packet(NamedTuple):
    """timestamp_ns: the block's time and, for a frame of a lace, the durations of those before it, as far as a duration is given."""

    track: int
    timestamp_ns: int
    start: int
    size: int
    key: bool
    lacing: int
    cluster: int


class Cue(NamedTuple):
    """A time in the file's ticks, a track, and where the cluster begins, counted from the segment's first byte."""

    time: int
    track: int
    cluster: int


class Parsed(NamedTuple):
    packets: list[Packet]
    tracks: list[dict[str, object]]
    cues: list[Cue]
    clusters: list[int]
    segment: int
    timestamp_scale: int
    error: str | None


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, bytes) of a variable-length number; value None if all its bits are 1 (unknown size)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"number cut off at {at}")
    raw = int.from_bytes(data[at : at + n])
    if keep_marker:
        return raw, n
    value = raw & ((1 << (7 * n)) - 1)
    return (None if value == (1 << (7 * n)) - 1 else value), n


def size_vint(value: int) -> bytes:
    n = 1
    while value >= (1 << (7 * n)) - 1:
        n += 1
    return ((1 << (7 * n)) | value).to_bytes(n)


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8) + size_vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8)))


def _laced(data: bytes, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """(start, size) of a block's frames from its first byte after the flags."""
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        return [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing does not divide its block")
        sizes = [(end - at) // n] * (n - 1)
    elif lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes, at = [*sizes, size + data[at]], at + 1
    else:
        for i in range(n - 1):
            value, used = vint(data, at)
            if value is None:
                value = (1 << (7 * used)) - 1
            at += used
            sizes.append(value if not i else sizes[-1] + value - ((1 << (7 * used - 1)) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("laced sizes exceed their block")
    out = []
    for size in [*sizes, last]:
        out.append((at, size))
        at += size
    return out


class _Walk:
    """What a walk over elements has found so far."""

    def __init__(self, data: bytes, scale: int = 1_000_000, tracks: list[dict[str, object]] | None = None):
        self.data, self.scale, self.tracks = data, scale, tracks if tracks is not None else []
        self.cues: list[Cue] = []
        self.clusters: list[int] = []
        self.segment = self.time = 0
        self.cue = [0, 0, 0]
        #: track, ticks, number in the lace, start, size, key, lacing, cluster, duration of the block in ticks
        self.frames: list[list[int | None]] = []
        #: of the block group that the walk is in: its first frame and its duration
        self.group: list[int | None] = [0, None]

    def block(self, at: int, end: int, simple: bool) -> None:
        track, used = vint(self.data, at)
        at += used
        (offset,) = struct.unpack_from(">h", self.data, at)
        flags = self.data[at + 2]
        for i, (start, size) in enumerate(_laced(self.data, at + 3, end, flags)):
            self.frames.append([track or 0, self.time + offset, i, start, size, bool(flags & 0x80) if simple else True, flags >> 1 & 3, len(self.clusters) - 1, None])

    def begin(self, ident: int, at: int, body: int) -> None:
        """A master element begins."""
        if ident == SEGMENT:
            self.segment = body
        elif ident == CLUSTER:
            self.clusters.append(at - self.segment)
        elif ident == TRACK_ENTRY:
            self.tracks.append({})
        elif ident == CUE_POINT:
            self.cue = [0, 0, 0]
        elif ident == BLOCK_GROUP:
            self.group = [len(self.frames), None]

    def end(self, ident: int) -> None:
        if ident == CUE_POINT:
            self.cues.append(Cue(*self.cue))
        elif ident == BLOCK_GROUP:
            for frame in self.frames[self.group[0] :]:
                frame[-1] = self.group[1]

    def value(self, ident: int, body: int, stop: int) -> None:
        """An element that holds no others."""
        raw = self.data[body:stop]
        number = lambda: int.from_bytes(raw)
        if ident in (SIMPLE_BLOCK, BLOCK):
            self.block(body, stop, ident == SIMPLE_BLOCK)
        elif ident == TIMESTAMP_SCALE:
            self.scale = number()
        elif ident == TIMESTAMP:
            self.time = number()
        elif ident == BLOCK_DURATION:
            self.group[1] = number()
        elif ident in CUE_FIELDS:
            self.cue[CUE_FIELDS.index(ident)] = number()
        elif ident in TRACK_NUMBERS and self.tracks:
            self.tracks[-1][TRACK_NUMBERS[ident]] = number()
        elif ident == SAMPLING_FREQUENCY and self.tracks:
            self.tracks[-1]["rate"] = struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0]
        elif ident == CODEC_ID and self.tracks:
            self.tracks[-1]["codec"] = raw.decode("ascii", "replace")

    def over(self, at: int, end: int) -> None:
        """Walks the elements from at to end. Open master elements lie on a list, so that nesting costs no stack."""
        open_: list[tuple[int, int, bool]] = [(0, end, False)]  # element, where it ends, whether its size is unknown
        while True:
            while len(open_) > 1 and at >= open_[-1][1]:
                self.end(open_.pop()[0])
            if at >= open_[-1][1]:
                return
            ident, used = vint(self.data, at, keep_marker=True)
            size, more = vint(self.data, at + used)
            while open_[-1][2] and (ident in TOP if open_[-1][0] == CLUSTER else ident == SEGMENT):
                self.end(open_.pop()[0])  # an element of unknown size ends where one begins that it can't hold
            body = at + used + more
            stop = open_[-1][1] if size is None else body + size
            if stop > open_[-1][1]:
                raise ValueError(f"element {ident:X} at {at} exceeds its parent")
            if ident in MASTERS:
                if len(open_) > DEEPEST:
                    raise ValueError(f"elements nest too deep at {at}")
                open_.append((ident, stop, size is None))
                self.begin(ident, at, body)
                at = body
            else:
                self.value(ident, body, stop)
                at = stop

    def packets(self) -> list[Packet]:
        """Timestamps count from the block's: a frame's duration is the track's default, or else its share of the block's."""
        default = {t.get("number"): t.get("duration") for t in self.tracks}
        laces = [0] * len(self.frames)
        last = len(self.frames)
        for i in range(len(self.frames) - 1, -1, -1):  # how many frames the lace of each has
            laces[i] = last - i + self.frames[i][2]
            if self.frames[i][2] == 0:
                last = i
        out = []
        for (track, ticks, k, start, size, key, lacing, cluster, took), n in zip(self.frames, laces, strict=True):
            each = default.get(track) or (took * self.scale // n if took else 0)
            out.append(Packet(track, ticks * self.scale + k * each, start, size, key, lacing, cluster))
        return out


def parse(data: bytes) -> Parsed:
    """All packets, tracks and cues. What is cut off or damaged ends the walk: what came before stays, error says why."""
    walk, error = _Walk(data), None
    try:
        if not data:
            raise ValueError("empty file")
        walk.over(0, len(data))
    except (ValueError, IndexError, struct.error) as e:
        error = str(e)
    return Parsed(walk.packets(), walk.tracks, walk.cues, walk.clusters, walk.segment, walk.scale, error)


def seek(data: bytes, parsed: Parsed, timestamp_ns: int, track: int = 1) -> Packet | None:
    """The track's last packet at or before a time, read by way of the cues: only the cluster that they name is walked. None if there is no such packet, or no cue.

    parsed is the file's parse(); its tracks, scale, cues and the segment's place are used, its packets are not.
    """
    at = bisect.bisect_right(cues := sorted(c for c in parsed.cues if c.track == track), timestamp_ns // parsed.timestamp_scale, key=lambda c: c.time)
    if not at:
        return None
    walk, begin = _Walk(data, parsed.timestamp_scale, parsed.tracks), parsed.segment + cues[at - 1].cluster
    _, used = vint(data, begin, keep_marker=True)
    size, more = vint(data, begin + used)
    walk.over(begin, len(data) if size is None else begin + used + more + size)
    found = [p for p in walk.packets() if p.track == track and p.timestamp_ns <= timestamp_ns]
    return found[-1]._replace(cluster=parsed.clusters.index(cues[at - 1].cluster)) if found else None


def _block(frames: list[bytes], offset: int, lacing: int) -> bytes:
    """A simple block of track 1. Frames of one size can use fixed lacing."""
    if len(frames) == 1:
        lacing = NO_LACING
    sizes = [len(f) for f in frames]
    head = b"\x81" + struct.pack(">hB", offset, 0x80 | lacing << 1)
    if lacing != NO_LACING:
        head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += size_vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            n = 1
            while abs(b - a) > (1 << (7 * n - 1)) - 2:
                n += 1
            head += ((1 << (7 * n)) | (b - a + (1 << (7 * n - 1)) - 1)).to_bytes(n)
    elif lacing == FIXED and len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def write(frames: list[bytes], lacings: Sequence[int] = (FIXED, XIPH, EBML_LACING), per_block: int = FRAMES_PER_BLOCK, per_cluster: int = BLOCKS_PER_CLUSTER, rate: int = RATE) -> bytes:
    """A file of one 8-bit mono PCM track: laced simple blocks in clusters, the lacings in turn, and a cue for each cluster.

    Ticks are milliseconds. All frames but the last have the first one's length, whose duration the track states.
    """
    head = element(
        EBML,
        uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2),
    )
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    length = len(frames[0]) if frames else FRAME
    track = element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(DEFAULT_DURATION, length * 1_000_000_000 // rate) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    parts = [element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"frameloom") + element(WRITING_APP, b"frameloom")), element(TRACKS, track)]
    at, cues = sum(map(len, parts)), []
    time = lambda i: i * length * 1000 // rate
    for i in range(0, len(frames), per_block * per_cluster):
        base, body = time(i), []
        for j in range(i, min(i + per_block * per_cluster, len(frames)), per_block):
            body.append(_block(frames[j : j + per_block], time(j) - base, lacings[j // per_block % len(lacings)]))
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, uint(TIMESTAMP, base) + b"".join(body)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def packets(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """A row for each packet of each file(id, bytes): timestamps in nanoseconds, byte ranges of the payload in the file.

    A null or damaged file gives the packets before the damage, and one row with null packet columns that holds the error.
    Rows that repeat give their packets again. Other columns are not read. An empty table gives no rows.
    """
    files = files.select(F.col(id_col).alias("file_id"), F.col(data_col).cast("binary").alias("data"))
    columns = "packet long, track long, timestamp_ns long, start long, size long, key boolean, lacing int, cluster int, error string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, rows = [], []
        for i, data in enumerate(batch.column(1)):
            found = parse(data.as_py() or b"")
            rows += [(n, min(p.track, _LONG), min(max(p.timestamp_ns, -_LONG), _LONG), *p[2:], None) for n, p in enumerate(found.packets)]
            rows += [(*[None] * 8, found.error)] * (found.error is not None)
            at += [i] * (len(rows) - len(at))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
        cells = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cells], ["file_id", *(c.split()[0] for c in columns.split(", "))])

    return map_batches(files, run, f"file_id {files.schema['file_id'].dataType.simpleString()}, {columns}")


#: Damaged files can hold larger numbers than a column.
_LONG = (1 << 63) - 1


def payload_of(text: bytes) -> bytes:
    """text and bytes 255 up to a positive multiple of FRAME."""
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a file of 576-sample frames, parses the stored bytes, and describes what was read back.

    Null text is stored as empty. Equal texts give equal values; repeated rows stay; a text of any length is one file.
    Other columns are not read. An empty table gives no rows. feature: packets, clusters and cues, the last packet's
    time in ms and the mean sample from the parsed table; last_start: where the last packet begins, sought by the cues.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def row(text: bytes) -> tuple:
        stored = payload_of(text)
        media = write([stored[i : i + FRAME] for i in range(0, len(stored), FRAME)])
        found = parse(media)
        if found.error:
            raise ValueError(found.error)
        back = b"".join([media[p.start : p.start + p.size] for p in found.packets])
        last = seek(media, found, found.packets[-1].timestamp_ns)
        if last != found.packets[-1]:
            raise ValueError("the cues lead to another packet")
        ms, silent = last.timestamp_ns // 1_000_000, sum(1 for p in found.packets if media[p.start] == 255)
        feature = f"packets={len(found.packets)};clusters={len(found.clusters)};cues={len(found.cues)};last_ms={ms};last_start={last.start};mean={sum(back) / len(back):.4f};silent={silent}"
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [row(t.as_py() or b"") for t in batch.column(1)]
        kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values()))], ["doc_id", *kinds])

    kind = named.schema["doc_id"].dataType.simpleString()
    return map_batches(named, run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
