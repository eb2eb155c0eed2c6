"""Media columns as MPEG transport streams: a payload is stored in 188-byte packets and read back through its program tables.

Writing: a program association table (PID 0) and a program map table, each with its CRC, then the payload as packetised elementary
stream packets of ``UNIT`` bytes on one PID of private data. Every unit has a presentation timestamp; every ``RANDOM_ACCESS``-th
starts with an adaptation field that marks a random-access point and carries the clock reference. Stuffing fills the last packet.

Reading: gather the tables' sections over their packets, check their CRCs, follow a program's map to a stream's PID, drop legal duplicates,
check the continuity counters, drop adaptation fields, reassemble the elementary packets and list their timestamps, offsets and
random-access points. Other writers' streams may have several programs, network entries, tables longer than a packet and tables that come
again. Whatever is missing shows as a fault. Both sides work on whole packet matrices.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship
from . import textkernel as tk

PACKET, MAP_PID, STREAM_PID, STREAM_ID, STREAM_TYPE = 188, 0x1000, 0x0100, 0xBD, 0x06
#: Payload bytes of an access unit, its duration in ticks of 90 kHz, and units from one random-access point to the next.
UNIT, TICKS, RANDOM_ACCESS = 32768, 3600, 4
PAYLOAD_BLOCK = 64


@lru_cache(maxsize=64)
def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@lru_cache(maxsize=8)
def _table(pid: int, table_id: int, body: bytes) -> bytes:
    """One packet with a section: header, number 1, body, CRC, stuffing."""
    section = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2) + (1).to_bytes(2) + bytes([0xC1, 0, 0]) + body
    section += section_crc(section).to_bytes(4)
    return (bytes([0x47]) + (0x4000 | pid).to_bytes(2) + bytes([0x10, 0]) + section).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    programs = (1).to_bytes(2) + (0xE000 | MAP_PID).to_bytes(2)
    streams = (0xE000 | STREAM_PID).to_bytes(2) + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2) + b"\xf0\x00"
    return _table(0, 0, programs) + _table(MAP_PID, 2, streams)


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _clock(pts: int) -> bytes:
    return ((pts << 15) | (0x3F << 9)).to_bytes(6)


def mux(payload: bytes) -> bytes:
    out, counter = [_tables()], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], (k * TICKS) % (1 << 33)
        body = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2) + b"\x80\x80\x05" + _timestamp(pts) + unit
        lead = bytes([0x50]) + _clock(pts) if k % RANDOM_ACCESS == 0 else b""
        head = bytes([len(lead)]) + lead if lead else b""
        room = PACKET - 4 - len(head)
        n = 1 + max(0, -(-(len(body) - room) // (PACKET - 4)))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        counter += n
        data = np.frombuffer(body, np.uint8)
        if n > 1:
            packets[0, 4 + len(head) :] = data[:room]
            if n > 2:
                packets[1:-1, 4:] = data[room : room + (n - 2) * (PACKET - 4)].reshape(n - 2, PACKET - 4)
            rest = data[room + (n - 2) * (PACKET - 4) :]
        else:
            rest = data
        if head:
            packets[0, 3] |= 0x20
            packets[0, 4 : 4 + len(head)] = np.frombuffer(head, np.uint8)
        stuffing = PACKET - 4 - len(rest) - (len(head) if n == 1 else 0)
        if stuffing:  # into the last packet's adaptation field: its length, flags if it has any, filler
            packets[-1, 3] |= 0x20
            if n == 1 and head:
                packets[0, 4] += stuffing
            else:
                packets[-1, 4] = stuffing - 1
                if stuffing > 1:
                    packets[-1, 5] = 0
        packets[-1, PACKET - len(rest) :] = rest
        out.append(packets.tobytes())
    return b"".join(out)


def _same(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two packets carry the same payload; their clock references may differ."""
    x, y = (r.tobytes() for r in (a, b))
    return x[5 + x[4] if x[3] & 0x20 else 4 :] == y[5 + y[4] if y[3] & 0x20 else 4 :] and x[3] == y[3]


@dataclass
class Stream:
    """What reading gave: the payload; a timestamp, payload offset and random-access flag for each elementary packet; faults found."""

    payload: bytes = b""
    pts: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    pid: int = -1
    packets: int = 0
    continuity_errors: int = 0
    table_errors: int = 0


def _sections(packets: np.ndarray) -> tuple[list[bytes], int]:
    """(whole sections with a right CRC, faulty or unfinished ones) of one PID's packets; a section may take several packets, and a packet hold several."""
    found, faults, pending = [], 0, None
    for row in packets:
        packet = row.tobytes()
        if not packet[3] & 0x10:
            continue
        data = packet[5 + packet[4] :] if packet[3] & 0x20 else packet[4:]
        starts = packet[1] & 0x40 and len(data)
        parts = [(pending, data[1 : 1 + data[0]]), (b"", data[1 + data[0] :])] if starts else [(pending, data)]
        for k, (before, more) in enumerate(parts):
            if before is None:
                continue
            pending = before + more
            while pending and pending[0] != 0xFF:
                length = (int.from_bytes(pending[1:3]) & 0x0FFF) + 3 if len(pending) >= 3 else None
                if length is None or len(pending) < length:
                    break
                section, pending = pending[:length], pending[length:]
                if length >= 12 and section_crc(section) == 0:
                    found.append(section)
                else:
                    faults += 1
            else:
                pending = None
            if pending is not None and k + 1 < len(parts):  # cut off by the next start
                faults, pending = faults + 1, None
    return found, faults + (pending is not None)


def _packets(media: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(media) % PACKET or not media:
        raise ValueError("not a whole number of transport packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("a packet without its sync byte")
    return p, ((p[:, 1].astype(np.int32) & 0x1F) << 8) | p[:, 2]


def programs(media: bytes) -> tuple[list[tuple[int, int, int]], int]:
    """((program, stream PID, stream type) in the order of the tables, table faults); network entries are no programs."""
    p, pid = _packets(media)
    tables, faults = _sections(p[pid == 0])
    maps, out = {}, []
    for section in tables:
        if section[0] == 0:
            for at in range(8, len(section) - 4, 4):
                number, where = int.from_bytes(section[at : at + 2]), int.from_bytes(section[at + 2 : at + 4]) & 0x1FFF
                if number:
                    maps.setdefault(number, where)
    if not maps:
        return [], max(faults, 1)
    for number, where in maps.items():
        sections, wrong = _sections(p[pid == where])
        mine = [x for x in sections if x[0] == 2 and int.from_bytes(x[3:5]) == number]
        faults += wrong or (not mine)
        if mine:
            section = mine[-1]  # the latest version
            at = 12 + (int.from_bytes(section[10:12]) & 0x0FFF)
            while at + 5 <= len(section) - 4:
                out.append((number, int.from_bytes(section[at + 1 : at + 3]) & 0x1FFF, section[at]))
                at += 5 + (int.from_bytes(section[at + 3 : at + 5]) & 0x0FFF)
    return out, faults


def demux(media: bytes, pid: int | None = None) -> Stream:
    """One elementary stream: of the given PID, else the first of the first program. Without one, or without its packets, there is a table fault."""
    out = Stream()
    found, out.table_errors = programs(media)
    p, every = _packets(media)
    if pid is None and not found:
        return out
    out.pid = found[0][1] if pid is None else pid
    p = p[every == out.pid]
    out.packets = len(p)
    if not len(p):
        out.table_errors += 1
        return out
    # a packet may be sent twice: same counter and payload as the one before
    again = np.zeros(len(p), bool)
    again[1:] = ((p[1:, 3] & 0x1F) == (p[:-1, 3] & 0x1F)) & ((p[1:, 3] & 0x10) > 0) & (p[1:, -64:] == p[:-1, -64:]).all(1)
    for k in np.flatnonzero(again):
        again[k] = not again[k - 1] and _same(p[k - 1], p[k])
    p = p[~again]
    has_payload, has_field = (p[:, 3] & 0x10) > 0, (p[:, 3] & 0x20) > 0
    announced = has_field & (p[:, 4] > 0) & ((p[:, 5] & 0x80) > 0)  # a discontinuity that the stream itself announces
    counter = (p[has_payload, 3] & 15).astype(np.int16)
    out.continuity_errors = int(np.count_nonzero(((np.diff(counter) - 1) % 16 > 0) & ~announced[has_payload][1:]))
    skip = np.where(has_payload, 4 + np.where(has_field, 1 + p[:, 4].astype(np.int32), 0), PACKET)
    data = p[np.arange(PACKET)[None, :] >= skip[:, None]]
    before = np.concatenate([[0], np.cumsum(PACKET - skip)])
    units = np.flatnonzero((p[:, 1] & 0x40) > 0)
    stops = [*before[units[1:]], len(data)]
    parts, at = [], 0
    for row, stop in zip(units, stops, strict=True):
        start = int(before[row])
        h = data[start : start + 14].tobytes()
        if len(h) < 9 or h[:3] != b"\x00\x00\x01":
            out.continuity_errors += 1
            continue
        if h[7] & 0x80:
            out.pts.append((h[9] >> 1 & 7) << 30 | h[10] << 22 | h[11] >> 1 << 15 | h[12] << 7 | h[13] >> 1)
        else:
            out.pts.append(-1)
        length = int.from_bytes(h[4:6])
        body = data[start + 9 + h[8] : min(stop, start + 6 + length) if length else stop]
        parts.append(body)
        out.offsets.append(at)
        out.random_access.append(bool(has_field[row] and p[row, 4] and p[row, 5] & 0x40))
        at += len(body)
    out.payload = np.concatenate(parts).tobytes() if parts else b""
    return out


def padded(text: bytes) -> bytes:
    return text.ljust(max(PAYLOAD_BLOCK, -(-len(text) // PAYLOAD_BLOCK) * PAYLOAD_BLOCK), b"\x00")


def _texts(column: pa.Array):
    data, offsets = tk.text_buffer(column)
    for i, j in tk.chunks(offsets):
        yield i, [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]


def _encode(batches):
    for batch in batches:
        for i, texts in _texts(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded) and media: each text's bytes, zero-padded to a positive multiple of 64, as a transport stream. Null: empty."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").try_cast("long"), F.col("text").cast("string")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _decode(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            s = demux(batch.column(2)[i].as_buffer().to_pybytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), pa.array([s.payload[: batch.column(1)[i].as_py()]], pa.binary()), pa.array([s.pts]), pa.array([s.offsets]), pa.array([s.random_access]), pa.array([s.continuity_errors], pa.int64()), pa.array([s.table_errors], pa.int64())],
                ["doc_id", "payload", "pts", "offsets", "random_access", "continuity_errors", "table_errors"],
            )


def decode_media(media: DataFrame) -> DataFrame:
    """The inverse of encode_media: doc_id, payload without padding, pts, offsets, random_access of its elementary packets, and faults."""
    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, "doc_id long, payload binary, pts array<bigint>, offsets array<bigint>, random_access array<boolean>, continuity_errors long, table_errors long")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches):
    for batch in batches:
        for i, texts in _texts(batch.column(1)):
            rows = []
            for t in texts:
                media = mux(padded(t))
                s = demux(media)
                points = [x for x, r in zip(s.pts, s.random_access, strict=True) if r]
                feature = f"pid={s.pid};packets={s.packets};units={len(s.pts)};pts={s.pts[0]}-{s.pts[-1]};random_access={len(points)}@{points[-1]};faults={s.continuity_errors + s.table_errors}"
                rows.append((len(t), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-PAYLOAD_BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [f.split()[0] for f in DIGEST.split(", ")])


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as a transport stream, read the stored bytes back and digest both; one row for each row of docs.

    Null texts count as empty: 64 zero bytes. Equal texts give equal values. Null doc_ids stay null, repeated rows stay, other columns
    are ignored, an empty table gives an empty result. ``feature`` sums up what the reader found: stream PID, its packets, elementary
    packets, first and last timestamp, random-access points with the last one's timestamp, and faults (0 for what we stored).
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_digest, DIGEST)
