import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from cloakframe.llm.common import scratch
from cloakframe.llm.transport import PACKET, STREAM_PID, _section, media_features, media_table, mux, packet_rows, padded, parse, section_crc, seek


@given(st.binary(max_size=3000), st.integers(1, 700))
@settings(max_examples=120, deadline=None)
def test_round_trip(data, unit):
    payload = padded(data)
    assert len(payload) % 64 == 0 and payload.startswith(data) and payload
    stream = mux(payload, unit)
    assert len(stream) % PACKET == 0 and set(stream[::PACKET]) == {0x47}
    got = parse(stream)
    assert got.payload(STREAM_PID) == payload
    assert got.programs == {1: [STREAM_PID]} and got.continuity_errors == got.table_errors == got.sync_errors == 0
    packets = got.streams[STREAM_PID].packets
    assert [p.pts for p in packets] == [90_000 + 3600 * k for k in range(-(-len(payload) // unit))]
    assert [p.random_access for p in packets] == [k % 4 == 0 for k in range(len(packets))]
    assert got.clock_references == [p.pts for p in packets if p.random_access]
    for e in got.index():  # from a random-access point on, the rest can be read with the tables before it
        at = e["offset"]
        assert stream[at] == 0x47 and (stream[at + 1] & 0x1F) << 8 | stream[at + 2] == STREAM_PID
        if e["random_access"]:
            assert parse(stream[at - 2 * PACKET :]).payload(STREAM_PID) == payload[unit * ((e["pts"] - 90_000) // 3600) :]
            assert seek(stream, got.index(), STREAM_PID, e["pts"] + 3600) == at
    assert seek(stream, got.index(), STREAM_PID, 0) is None


def test_damage_is_seen():
    stream = mux(bytes(range(256)) * 40)
    lost = stream[: 5 * PACKET] + stream[6 * PACKET :]
    assert parse(lost).continuity_errors == 1
    again = stream[: 6 * PACKET] + stream[5 * PACKET :]
    assert parse(again).payload(STREAM_PID) == parse(stream).payload(STREAM_PID) and parse(again).continuity_errors == 0
    bad = bytearray(stream)
    bad[10] ^= 1
    assert parse(bytes(bad)).table_errors == 1
    assert parse(b"\0" + stream[1:]).sync_errors == 1
    assert section_crc(b"123456789") == 0x0376E6E7  # the published check value of this checksum
    assert parse(b"").n_packets == 0


def packet(pid, body, start=True, cc=0, control=1):
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 0xFF, control << 4 | cc])
    return head + body.ljust(PACKET - 4, b"\xff")


def test_sections_over_several_packets():
    """A map table of 60 streams fills two packets; a second section starts behind the first one's end."""
    streams = [0x200 + k for k in range(60)]
    table = _section(2, 7, (0xE000 | 0x200).to_bytes(2, "big") + b"\xf0\0" + b"".join(bytes([6]) + (0xE000 | s).to_bytes(2, "big") + b"\xf0\0" for s in streams))
    association = _section(0, 1, b"\0\0" + (0xE010).to_bytes(2, "big") + (7).to_bytes(2, "big") + (0xE123).to_bytes(2, "big"))
    assert len(table) > PACKET
    data = packet(0, b"\0" + association)
    rest = table[PACKET - 5 :]
    data += packet(0x123, b"\0" + table[: PACKET - 5], cc=0) + packet(0x123, bytes([len(rest)]) + rest + table[: PACKET - 5 - len(rest)], cc=1)
    got = parse(data)
    assert got.programs == {7: streams} and got.table_errors == 0 and sorted(got.streams) == streams
    lost = packet(0, b"\0" + association) + packet(0x123, b"\0" + table[: PACKET - 5], cc=0) + packet(0x123, rest, start=False, cc=2)
    assert parse(lost).programs == {} and parse(lost).continuity_errors == 1


@given(st.lists(st.tuples(st.sampled_from([0, 1, 0x100, 0x1000, 0x1FFF]), st.binary(max_size=PACKET - 4), st.booleans(), st.integers(0, 15), st.integers(0, 3)), max_size=12), st.binary(max_size=200), st.integers(0, 4000))
@settings(max_examples=200, deadline=None)
def test_any_bytes_are_read(packets, tail, cut):
    stream = mux(bytes(range(256)) * 5)
    made = b"".join(packet(*p) for p in packets)
    for data in (tail, made + tail, stream[:1000] + made + stream[1000:], stream[: cut // PACKET * PACKET] + made + stream, stream[:cut] + tail + stream[cut:]):
        got = parse(data)
        assert got.n_packets + got.sync_errors == len(data) // PACKET
        got.index()


def test_a_map_table_where_no_program_says_so():
    data = packet(0, b"\0" + _section(2, 1, b"\xe1\0\xf0\0")) + packet(0x55, b"\xb7" + b"\0" * 183, control=2) + packet(0x55, b"\xff", control=3)
    assert parse(data).programs == {} and parse(data).packet_errors == 1


def test_operator_against_brute_force(spark):
    texts = [None, "", "x" * 64, "é" * 33, "lang " * 30000, "x" * 64]
    docs = spark.createDataFrame([Row(doc_id=None if i == 3 else i, text=t, media="clash", n_bytes=1) for i, t in enumerate(texts)])
    media = media_table(docs, scratch(spark, "m"))
    got = media_features(media).collect()
    assert len(got) == 6
    packets = packet_rows(media).where("doc_id = 4").orderBy("packet_no").collect()
    assert [p.pts for p in packets] == [90_000 + 3600 * k for k in range(-(-150_016 // 8192))] and [p.random_access for p in packets] == [k % 4 == 0 for k in range(len(packets))]
    assert [p.offset for p in packets] == sorted(p.offset for p in packets) and {p.pid for p in packets} == {STREAM_PID} and {p.dts for p in packets} == {None}
    for r in got:
        raw = (texts[3 if r.doc_id is None else r.doc_id] or "").encode()
        n = max(64, -(-len(raw) // 64) * 64)
        payload = raw + b"\0" * (n - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stream = mux(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        units, share = -(-n // 8192), np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / n
        last = 90_000 + 3600 * (units - 1)
        assert (r.n_packets, r.n_pes, r.n_random_access, r.first_pts, r.last_pts, r.continuity_errors, r.table_errors) == (len(stream) // PACKET, units, -(-units // 4), 90_000, last, 0, 0)
        entropy, mean = -sum(x * np.log2(x) for x in share if x), sum(x * k for k, x in enumerate(share))
        assert r.feature == f"program=1 pid=256 type=6 packets={r.n_packets} pes={units} random_access={-(-units // 4)} pts=90000-{last} mean={mean:.4f} entropy={abs(entropy):.4f}"
    same = [r for r in got if r.doc_id in (2, 5)]
    assert same[0][1:] == same[1][1:]
    assert media_features(media_table(docs.limit(0), scratch(spark, "m"))).count() == 0
