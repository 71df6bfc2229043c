import hashlib
import struct
import zlib

import pytest
from conftest_llm import odd_texts, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import matroska as m


@pytest.mark.parametrize("lacing", [m.NO_LACING, m.XIPH, m.FIXED, m.EBML_LACING])
def test_frames_come_back(lacing):
    frames = [bytes([i % 251]) * (300 if lacing == m.FIXED else 1 + (i * 97) % 700) for i in range(700)]
    data = m.write(frames, [lacing], per_block=1 if lacing == m.NO_LACING else 8)
    found = m.parse(data)
    assert found.error is None and [data[p.start : p.start + p.size] for p in found.packets] == frames
    assert found.tracks == [{"number": 1, "type": 2, "codec": "A_PCM/INT/LIT", "rate": 8000.0, "channels": 1, "bits": 8, "duration": len(frames[0]) * 1_000_000_000 // 8000}]
    assert [c.cluster for c in found.cues] == found.clusters and len(found.clusters) > 2


def test_each_frame_of_a_lace_has_its_own_time():
    found = m.parse(m.write([b"x" * 576] * 20))
    assert [p.timestamp_ns for p in found.packets] == [72_000_000 * i for i in range(20)]


def test_cues_lead_to_the_packet():
    frames = [bytes([i % 251]) * 576 for i in range(1000)]
    data = m.write(frames)
    found = m.parse(data)
    assert len(found.cues) == 4
    for i in (0, 1, 255, 256, 257, 600, 999):
        assert m.seek(data, found, 72_000_000 * i) == found.packets[i] == m.seek(data, found, 72_000_000 * i + 71_999_999)
    assert m.seek(data, found._replace(cues=[]), 0) is None and m.seek(data, found, -1) is None and m.seek(data, found, 0, track=2) is None


@given(st.one_of(st.binary(max_size=300), st.builds(lambda n, x: m.write([b"ab"] * 40)[:n] + x, st.integers(0, 500), st.binary(max_size=40)), st.builds(lambda n: b"\xa0\xff" * n, st.integers(0, 3000))))
@settings(max_examples=400, deadline=None)
def test_no_bytes_end_a_walk_but_with_an_error(data):
    found = m.parse(data)
    assert all(0 <= p.start <= p.start + p.size <= len(data) for p in found.packets)


def test_deep_nesting_keeps_the_packets_before_it(spark):
    whole = m.write([b"ab", b"cd"])
    data = bytearray(whole + b"\xa0\xff" * 5000)
    rows = m.packets(spark.createDataFrame([(1, data), (1, data)], "id long, data binary"), "id", "data").collect()
    assert len([r for r in rows if r["error"] is None]) == 4 and len([r for r in rows if r["error"]]) == 2
    assert m.packets(spark.createDataFrame([], "id long, data binary"), "id", "data").count() == 0


def test_variable_length_numbers():
    for value in (0, 1, 126, 127, 128, 16382, 16383, 2**40):
        assert m.vint(m.size_vint(value), 0) == (value, len(m.size_vint(value)))
    assert m.vint(b"\xff", 0) == (None, 1) and m.vint(b"\x01" + b"\xff" * 7, 0) == (None, 8)
    with pytest.raises(ValueError):
        m.vint(b"\x00", 0)


def test_unknown_sizes_and_block_groups():
    block = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x82" + struct.pack(">hB", -3, 0) + b"xyz") + m.uint(m.BLOCK_DURATION, 7))
    cluster = lambda t: m.CLUSTER.to_bytes(4) + b"\x01" + b"\xff" * 7 + m.uint(m.TIMESTAMP, t) + block
    data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4) + b"\xff" + m.element(m.INFO, m.uint(m.TIMESTAMP_SCALE, 500)) + cluster(10) + cluster(20) + m.element(m.CUES, b"")
    found = m.parse(data)
    assert found.error is None and found.timestamp_scale == 500
    assert [(p.track, p.timestamp_ns, data[p.start : p.start + p.size], p.cluster) for p in found.packets] == [(2, 7 * 500, b"xyz", 0), (2, 17 * 500, b"xyz", 1)]


def test_a_block_s_duration_is_shared_by_its_lace():
    lace = b"\x81" + struct.pack(">hB", 0, m.FIXED << 1) + bytes([3]) + b"aabbccdd"
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, lace) + m.uint(m.BLOCK_DURATION, 8))
    data = m.element(m.SEGMENT, m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 5) + group + m.element(m.SIMPLE_BLOCK, lace)))
    assert [p.timestamp_ns // 1_000_000 for p in m.parse(data).packets] == [5, 7, 9, 11, 5, 5, 5, 5]


def test_damage_keeps_what_came_before():
    data = m.write([b"a" * 10] * 600)
    whole = m.parse(data).packets
    for cut in (0, 3, 50, len(data) // 2, len(data) - 1):
        found = m.parse(data[:cut])
        assert found.error and found.packets == whole[: len(found.packets)]
    assert m.parse(b"\x00" * 20).error


def test_packet_table(spark):
    data = bytearray(m.write([b"ab", b"cd", b"ef"]))
    rows = m.packets(spark.createDataFrame([(1, data, "own"), (2, None, "own"), (3, bytearray(b"zz"), "own")], "id long, data binary, packet string"), "id", "data").collect()
    one = [r for r in rows if r["file_id"] == 1]
    assert [bytes(data[r["start"] : r["start"] + r["size"]]) for r in one] == [b"ab", b"cd", b"ef"] and all(r["error"] is None for r in one)
    assert sorted(r["file_id"] for r in rows if r["error"]) == [2, 3]


def test_round_trip_of_texts(make_docs):
    texts = odd_texts() + [prose(2, 300), "b" * 576, "b" * 577]
    rows = {r["doc_id"]: r for r in m.store_and_read(make_docs(texts, extra=True)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        size = max(1, -(-len(raw) // 576)) * 576
        payload = raw + b"\xff" * (size - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[8]["media_sha256"] == rows[9]["media_sha256"] and rows[8]["feature"] == rows[9]["feature"]
    assert m.store_and_read(make_docs(["a"]).where("doc_id < 0")).count() == 0
