"""MPEG transport streams as a media column: writing, parsing, packet rows, and features.

A payload is cut into access units, each one PES packet with a presentation time; every RAP_EVERY-th unit is
a random-access point with a clock reference, preceded by the program tables. `parse` reads any bytes as 188-byte
packets: it gathers sections of the program association and map tables, over several packets if need be (with their
checksums), checks continuity counters per PID, reassembles PES packets and notes for each its timestamps, the
offset of its first packet and whether random access is possible there. Damage is counted and never raises an error.

The stored table holds a stream beside its index: a (pid, pts, dts, offset, random_access) entry for each elementary
packet, so that a reader may start at a random-access point without parsing what comes before (`seek`).

Defined cases of the operator: null or empty text is one block of 64 zero bytes; equal texts give equal
streams and values; null ids, repeated rows and texts of any length stay as they are; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, release_memory, scratch, table

PACKET, SYNC, BLOCK = 188, 0x47, 64
UNIT, RAP_EVERY, TICKS = 8192, 4, 3600
PMT_PID, STREAM_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 1, 0x06, 0xBD
RESULT = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_packets long, n_pes long, n_random_access long, first_pts long, last_pts long, continuity_errors long, table_errors long"
)
INDEX = "array<struct<pid:int,pts:bigint,dts:bigint,offset:bigint,random_access:boolean>>"
MEDIA = f"doc_id long, n_bytes long, media binary, index {INDEX}"
_ENTRY = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())])


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The checksum of program tables; over a table with its checksum it is 0."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> tuple[bytes, bytes]:
    """What comes before and after the byte with the continuity counter."""
    return bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF]), b"\0" + section + b"\xff" * (PACKET - 5 - len(section))


_PAT = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0"))


def _pts(value: int) -> bytes:
    return bytes([0x21 | (value >> 29) & 0x0E]) + ((value >> 14 & 0xFFFE) | 1).to_bytes(2, "big") + ((value << 1 & 0xFFFE) | 1).to_bytes(2, "big")


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """The payload as a transport stream of one program with one private stream."""
    out, cc, tables = [], 0, 0
    first, rest = bytes([SYNC, 0x40 | STREAM_PID >> 8, STREAM_PID & 0xFF]), bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF])
    for k, at in enumerate(range(0, len(payload), unit)):
        body, pts = payload[at : at + unit], 90_000 + k * TICKS & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts(pts) + body
        extra = b""
        if k % RAP_EVERY == 0:
            for head, tail in (_PAT, _PMT):
                out.append(head + bytes([0x10 | tables]) + tail)
            tables = tables + 1 & 15
            extra = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")  # random access, and a clock reference
        p = 0
        while p < len(pes):
            room = PACKET - 4 - (len(extra) + 1 if extra else 0)
            chunk = pes[p : p + room]
            head = rest if p else first
            if len(chunk) < room or extra:
                fill = PACKET - 4 - len(chunk) - 1
                field_ = bytes([fill]) + ((extra or b"\0") + b"\xff" * fill)[:fill]
                out.append(head + bytes([0x30 | cc]) + field_ + chunk)
            else:
                out.append(head + bytes([0x10 | cc]) + chunk)
            cc, extra = cc + 1 & 15, b""
            p += len(chunk)
    return b"".join(out)


@dataclass
class Packet:
    """An elementary packet; offset is that of its first transport packet."""

    pts: int | None
    dts: int | None
    random_access: bool
    offset: int
    payload: bytes


@dataclass
class Stream:
    kind: int
    packets: list[Packet] = field(default_factory=list)


@dataclass
class Parsed:
    programs: dict[int, list[int]] = field(default_factory=dict)  # number -> elementary PIDs
    streams: dict[int, Stream] = field(default_factory=dict)
    n_packets: int = 0
    continuity_errors: int = 0
    table_errors: int = 0
    sync_errors: int = 0
    packet_errors: int = 0  # adaptation fields or elementary packets that don't fit
    clock_references: list[int] = field(default_factory=list)

    def payload(self, pid: int) -> bytes:
        return b"".join(p.payload for p in self.streams[pid].packets)

    def index(self) -> list[dict]:
        """An entry for each elementary packet, in order of offset."""
        return sorted(({"pid": pid, "pts": p.pts, "dts": p.dts, "offset": p.offset, "random_access": p.random_access} for pid, s in self.streams.items() for p in s.packets), key=lambda e: e["offset"])


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _packet_of(data: bytes, random_access: bool, offset: int) -> Packet | None:
    if len(data) < 6 or data[:3] != b"\0\0\1":
        return None
    size = int.from_bytes(data[4:6], "big")
    end = 6 + size if size else len(data)
    if data[3] in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xFF) or len(data) < 9:  # kinds without an optional header
        return Packet(None, None, random_access, offset, data[6:end])
    head = data[9 : 9 + data[8]]
    pts = _time(head) if data[7] & 0x80 and len(head) >= 5 else None
    dts = _time(head[5:]) if data[7] & 0xC0 == 0xC0 and len(head) >= 10 else None
    return Packet(pts, dts, random_access, offset, data[9 + data[8] : end])


class _Sections:
    """Sections of one PID: they may fill several packets, and a packet may end one and begin others."""

    def __init__(self):
        self.held: bytearray | None = None

    def feed(self, body: bytes, start: bool) -> Iterator[bytes]:
        if start:
            pointer = body[0] if body else 0
            if self.held is not None:
                self.held += body[1 : 1 + pointer]
                yield from self._whole()
            self.held = bytearray(body[1 + pointer :])
        elif self.held is None:
            return
        else:
            self.held += body
        yield from self._whole()

    def _whole(self) -> Iterator[bytes]:
        while self.held is not None and len(self.held) >= 3:
            if self.held[0] == 0xFF:  # stuffing up to the next start
                self.held = None
                return
            size = 3 + (int.from_bytes(self.held[1:3], "big") & 0xFFF)
            if len(self.held) < size:
                return
            yield bytes(self.held[:size])
            self.held = self.held[size:] or None


def parse(data: bytes) -> Parsed:
    out, pmts, counters, open_, tables = Parsed(), {}, {}, {}, {}

    def close(pid: int) -> None:
        if pid in open_:
            parts, random_access, offset = open_.pop(pid)
            if (got := _packet_of(b"".join(parts), random_access, offset)) is not None:
                out.streams[pid].packets.append(got)
            else:
                out.packet_errors += 1

    def read(pid: int, s: bytes) -> None:
        if len(s) < 12 or section_crc(s):
            out.table_errors += 1
        elif pid == 0 and s[0] == 0:
            pmts.clear()
            for k in range(8, len(s) - 7, 4):
                if s[k : k + 2] != b"\0\0":  # program 0 names the network's table
                    pmts[int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF] = int.from_bytes(s[k : k + 2], "big")
        elif s[0] == 2 and pid in pmts and len(s) >= 16:
            k, pids = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF), []
            while k + 5 <= len(s) - 4:
                es = int.from_bytes(s[k + 1 : k + 3], "big") & 0x1FFF
                if es not in (0, 0x1FFF):
                    out.streams.setdefault(es, Stream(s[k]))
                    pids.append(es)
                k += 5 + (int.from_bytes(s[k + 3 : k + 5], "big") & 0xFFF)
            out.programs[pmts[pid]] = pids

    for at in range(0, len(data) - PACKET + 1, PACKET):
        if data[at] != SYNC:
            out.sync_errors += 1
            continue
        out.n_packets += 1
        b1, b3 = data[at + 1], data[at + 3]
        pid, start, control = (b1 & 0x1F) << 8 | data[at + 2], bool(b1 & 0x40), b3 >> 4 & 3
        if pid == 0x1FFF:
            continue
        p, flags = at + 4, 0
        if control & 2:
            n = data[p]
            if n > PACKET - 5:
                out.packet_errors += 1
                continue
            if n:
                flags = data[p + 1]
                if flags & 0x10 and n >= 7:
                    out.clock_references.append(int.from_bytes(data[p + 2 : p + 8], "big") >> 15)
            p += 1 + n
        if not control & 1:
            continue
        count, last = b3 & 15, counters.get(pid)
        counters[pid] = count
        if last is not None and not flags & 0x80:
            if count == last:  # a repeated packet
                continue
            if count != (last + 1 & 15):
                out.continuity_errors += 1
                tables.pop(pid, None)
        body = data[p : at + PACKET]
        if pid in out.streams:
            if start:
                close(pid)
                open_[pid] = [body], bool(flags & 0x40), at
            elif pid in open_:
                open_[pid][0].append(body)
        elif pid == 0 or pid in pmts:
            for section in tables.setdefault(pid, _Sections()).feed(body, start):
                read(pid, section)
    for pid in list(open_):
        close(pid)
    return out


def seek(media: bytes, index: list[dict], pid: int, pts: int) -> int | None:
    """Offset of the last random-access point of a stream at or before a time; None if there is none."""
    found = [e["offset"] for e in index if e["pid"] == pid and e["random_access"] and e["pts"] is not None and e["pts"] <= pts]
    return max(found) if found else None


def padded(text: bytes, block: int = BLOCK) -> bytes:
    return text + b"\0" * (-len(text) % block or (0 if text else block))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            made = [mux(padded(t)) for t in texts]
            index = [parse(m).index() for m in made]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(made, pa.binary()), pa.array(index, pa.list_(_ENTRY))], names=["doc_id", "n_bytes", "media", "index"])
    release_memory()


def main_stream(got: Parsed) -> tuple[int, int] | None:
    """(program, PID) of the first stream of the lowest program that has packets."""
    return next(((number, pid) for number in sorted(got.programs) for pid in got.programs[number] if got.streams[pid].packets), None)


def feature_of(got: Parsed, program: int, pid: int, payload: bytes) -> str:
    stream, counts = got.streams[pid], np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / max(len(payload), 1)
    entropy, mean = float(-(share * np.log2(share)).sum()), float((counts * np.arange(256)).sum() / max(len(payload), 1))
    times = [p.pts for p in stream.packets if p.pts is not None]
    return (
        f"program={program} pid={pid} type={stream.kind} packets={got.n_packets} pes={len(stream.packets)} random_access={sum(p.random_access for p in stream.packets)} "
        f"pts={min(times, default='')}-{max(times, default='')} mean={mean:.4f} entropy={entropy + 0.0:.4f}"
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESULT.split(", ")]
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            rows = []
            for r in batch.slice(k, 500).to_pylist():
                media = r["media"]
                got = parse(media)
                program, pid = main_stream(got) or (0, None)
                payload = got.payload(pid) if pid is not None else b""
                packets = got.streams[pid].packets if pid is not None else []
                times = [p.pts for p in packets if p.pts is not None]
                feature = feature_of(got, program, pid, payload) if pid is not None else "no stream"
                rows.append((r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature,
                             got.n_packets, len(packets), sum(p.random_access for p in packets), times[0] if times else None, times[-1] if times else None, got.continuity_errors, got.table_errors))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for n, c in zip(names, cols, strict=True)], names=names)
    release_memory()


def media_table(docs: DataFrame, path: str) -> DataFrame:
    """Writes (doc_id, n_bytes, media, index) to path and reads it back."""
    prepare(docs.sparkSession)
    docs.select("doc_id", "text").mapInArrow(_write, MEDIA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(MEDIA).parquet(path)


def media_features(media: DataFrame) -> DataFrame:
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, RESULT)


def packet_rows(media: DataFrame) -> DataFrame:
    """(doc_id, packet_no, pid, pts, dts, offset, random_access): a row for each elementary packet; streams are not read."""
    return media.select("doc_id", F.posexplode("index").alias("packet_no", "e")).select("doc_id", "packet_no", "e.*")


def op4_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(media_table(table(spark, sf_dir, "documents"), scratch(spark, "media")))
