"""MPEG transport streams as media columns: bytes packed into 188-byte packets and read back.

The reader parses the program tables (association and map), checks the continuity counters of every stream, puts elementary
packets together again across transport packets, and notes their timestamps (presentation and decoding), clock references and
random-access points. It finds the packets again after lost or stray bytes. The writer stores a
payload losslessly as one private elementary stream, so that the round trip can be proven for any bytes.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, BODY, SYNC = 188, 184, 0x47
PMT_PID, DATA_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x100, 0x101, 1, 0x06, 0xBD
#: Bytes of payload in one elementary packet of the writer, and the ticks of the 90 kHz clock between two of them.
UNIT, TICKS, RANDOM_ACCESS_EVERY = 1 << 14, 3600, 4


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packets(pid: int, section: bytes) -> bytes:
    """A section in as many packets as it takes; the last is filled up by stuffing bytes."""
    data = b"\x00" + section
    data += b"\xff" * (-len(data) % BODY)
    parts = [data[at : at + BODY] for at in range(0, len(data), BODY)]
    return b"".join(bytes([SYNC, (0 if i else 0x40) | pid >> 8, pid & 0xFF, 0x10 | i % 16]) + part for i, part in enumerate(parts))


#: The program tables are the same for all streams of the writer.
TABLES = _table_packets(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packets(
    PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


#: Fixed values of the format: stream ids whose elementary packets have no long header.
PLAIN_IDS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)


def _ticks(stamp: bytes) -> int:
    return (stamp[0] >> 1 & 7) << 30 | stamp[1] << 22 | stamp[2] >> 1 << 15 | stamp[3] << 7 | stamp[4] >> 1


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def write_stream(payload: bytes) -> bytes:
    """A transport stream of the program tables and the payload in elementary packets of up to 16 KiB.

    Every elementary packet has a timestamp; every fourth is a random-access point. Its last transport packet is filled up
    by an adaptation field.
    """
    out, counter = [TABLES], 0
    for no, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        data = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(no * TICKS & (1 << 33) - 1) + unit
        first = BODY - 2  # the first transport packet has an adaptation field of flags
        n = 1 + -(-max(len(data) - first, 0) // BODY)
        flags = 0x40 if no % RANDOM_ACCESS_EVERY == 0 else 0
        block = np.full((n, PACKET), 0xFF, np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        block[0, 1] |= 0x40
        block[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        counter = (counter + n) % 16
        spare = first + (n - 1) * BODY - len(data)  # bytes to fill in the last packet
        block[0, 3] |= 0x20
        block[0, 4:6] = 1, flags
        if n == 1:
            block[0, 4] = 1 + spare
            block[0, 6 + spare :] = np.frombuffer(data, np.uint8)
        else:
            block[0, 6:] = np.frombuffer(data, np.uint8, first)
            whole = n - 1 if not spare else n - 2
            block[1 : 1 + whole, 4:] = np.frombuffer(data, np.uint8, whole * BODY, first).reshape(whole, BODY)
            if spare:
                block[-1, 3] |= 0x20
                block[-1, 4] = spare - 1
                if spare > 1:
                    block[-1, 5] = 0
                block[-1, 4 + spare :] = np.frombuffer(data, np.uint8, BODY - spare, first + whole * BODY)
        out.append(block.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """One elementary stream as read: its bytes, and per elementary packet the place in them, presentation time, access flag
    and decoding time (that of presentation if it has none of its own)."""

    pid: int
    kind: int
    data: bytes = b""
    units: list[tuple[int, int | None, bool, int | None]] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)  # clock references, in ticks of 27 MHz
    lost: int = 0  # breaks of the continuity counter
    packets: int = 0


def _packets(media: bytes, wrong: list[str]) -> np.ndarray:
    """The transport packets as rows of bytes. A packet counts if it begins with the sync byte and one follows it in one of the
    next two places, or the stream ends there; else the next such place is looked for, and the bytes between are left out. So
    a packet before stray bytes is left out too: it looks like one that lost some."""
    b = np.frombuffer(media, np.uint8)
    grid = b[: len(b) // PACKET * PACKET].reshape(-1, PACKET)
    if len(b) % PACKET == 0 and (grid[:, 0] == SYNC).all():
        return grid
    sync = np.concatenate([b == SYNC, np.zeros(2 * PACKET + 1, bool)])
    here = np.arange(max(len(b) - PACKET + 1, 0))
    fine = np.flatnonzero(sync[here] & (sync[here + PACKET] | sync[here + 2 * PACKET] | (here + PACKET == len(b))))
    taken, at = [], 0
    while (i := int(np.searchsorted(fine, at))) < len(fine):
        taken.append(int(fine[i]))
        at = taken[-1] + PACKET
    if outside := len(b) - PACKET * len(taken):
        wrong.append(f"{outside} bytes outside packets")
    return b[np.array(taken, np.int64)[:, None] + np.arange(PACKET)] if taken else grid[:0]


def read_stream(media: bytes) -> tuple[list[Stream], list[str]]:
    """The elementary streams of the programs, and what is wrong with the bytes (empty if nothing). Packets that carry the
    error flag are left out, scrambled ones have no payload; both are told."""
    wrong: list[str] = []
    p = _packets(media, wrong)
    if bad := int((p[:, 1] & 0x80 != 0).sum()):
        wrong.append(f"{bad} packets with the error flag")
        p = p[p[:, 1] & 0x80 == 0]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    # Where the payload begins: after the adaptation field if there is one; at the end if there is no payload.
    begin = np.where(p[:, 3] & 0x20, 5 + p[:, 4].astype(np.int32), 4)
    begin = np.where(p[:, 3] & 0x10, np.minimum(begin, PACKET), PACKET)
    scrambled = (p[:, 3] & 0xC0 != 0) & (pid != 0x1FFF)
    if scrambled.any():
        wrong.append(f"{int(scrambled.sum())} scrambled packets")
        begin = np.where(scrambled, PACKET, begin)
    access = (p[:, 3] & 0x20 != 0) & (p[:, 4] > 0) & (p[:, 5] & 0x40 != 0)

    def sections(of: int, table: int) -> Iterator[bytes]:
        """Bodies of the sections of a table, which may go over several packets, or share one."""
        open_, last = b"", b""

        def whole(data: bytes) -> tuple[list[bytes], bytes]:
            out = []
            while len(data) >= 3 and data[0] != 0xFF and (n := (int.from_bytes(data[1:3], "big") & 0xFFF) + 3) <= len(data):
                out.append(data[:n])
                data = data[n:]
            return out, data if data[:1] != b"\xff" else b""

        found: list[bytes] = []
        for i in np.flatnonzero((pid == of) & (begin < PACKET)):
            raw = p[i].tobytes()
            if raw == last:  # sent twice
                continue
            last, body = raw, raw[begin[i] :]
            if raw[1] & 0x40:
                done, rest = whole(open_ + body[1 : 1 + body[0]]) if open_ else ([], b"")
                if rest:
                    wrong.append(f"section of {of} is broken")
                found += done
                open_ = body[1 + body[0] :]
            elif open_:
                open_ += body
            done, open_ = whole(open_)
            found += done
        if open_:
            wrong.append(f"section of {of} is broken")
        for one in found:
            if one[0] != table:
                continue
            if len(one) < 12 or crc32_mpeg(one):
                wrong.append(f"section of {of} is broken")
            else:
                yield one[8:-4]

    maps = {}
    for body in sections(0, 0):
        for at in range(0, len(body) - 3, 4):
            if number := int.from_bytes(body[at : at + 2], "big"):
                maps[number] = int.from_bytes(body[at + 2 : at + 4], "big") & 0x1FFF
    if not maps:
        wrong.append("no program association")
    kinds: dict[int, int] = {}
    for of in maps.values():
        for body in sections(of, 2):
            at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
            while at + 5 <= len(body):
                kinds[int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF] = body[at]
                at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    return [_elementary(p, begin, access, np.flatnonzero(pid == of), of, kind, wrong) for of, kind in kinds.items()], wrong


def _elementary(p: np.ndarray, begin: np.ndarray, access: np.ndarray, own: np.ndarray, pid: int, kind: int, wrong: list[str]) -> Stream:
    s = Stream(pid, kind, packets=len(own))
    for i in own[(p[own, 3] & 0x20 != 0) & (p[own, 4] >= 7) & (p[own, 5] & 0x10 != 0)]:
        clock = int.from_bytes(p[i, 6:12].tobytes(), "big")
        s.clocks.append((clock >> 15) * 300 + (clock & 0x1FF))
    own = own[begin[own] < PACKET]
    if not len(own):
        return s
    count = p[own, 3] & 0x0F
    step = (count[1:].astype(int) - count[:-1]) % 16
    again = np.concatenate([[False], (step == 0) & (p[own[1:]] == p[own[:-1]]).all(axis=1)])  # a packet may be sent twice
    s.lost = int(((step != 1) & ~again[1:]).sum())
    own = own[~again]
    size = PACKET - begin[own]
    ends = np.cumsum(size)
    inside = np.arange(PACKET)[None, :] >= begin[own][:, None]
    raw = p[own][inside].tobytes()
    starts = np.flatnonzero(p[own, 1] & 0x40)
    parts, at = [], 0
    for j, i in enumerate(starts):
        a, b = int(ends[i] - size[i]), int(ends[starts[j + 1]] - size[starts[j + 1]]) if j + 1 < len(starts) else len(raw)
        head = raw[a : a + 19]
        plain = len(head) >= 6 and head[3] in PLAIN_IDS
        if head[:3] != b"\x00\x00\x01" or b - a < (6 if plain else 9):
            wrong.append(f"elementary packet {j} of {pid} has no start code")
            continue
        told = int.from_bytes(head[4:6], "big")
        skip = 6 if plain else 9 + head[8]
        flags = 0 if plain else head[7]
        pts = _ticks(head[9:14]) if flags & 0x80 and skip >= 14 and len(head) >= 14 else None
        dts = _ticks(head[14:19]) if flags & 0xC0 == 0xC0 and skip >= 19 and len(head) >= 19 else pts
        if told and told + 6 != b - a:
            wrong.append(f"elementary packet {j} of {pid} has {b - a - 6} bytes, not {told}")
        s.units.append((at, pts, bool(access[own[i]]), dts))
        parts.append(raw[a + skip : min(b, a + 6 + told) if told else b])
        at += len(parts[-1])
    s.data = b"".join(parts)
    return s


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns but text, with n_bytes, media (binary): the text in UTF-8 (null: empty), filled up by bytes 0 to a
    positive multiple of 64, as a transport stream. Rows are stored each by itself. Columns of docs with these two names give
    way."""

    def pack(t: str | None) -> tuple[int, bytes]:
        raw = (t or "").encode()
        return len(raw), write_stream(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, media = zip(*map(pack, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["r", "n_bytes", "media"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_bytes", "media")]).alias("r"), text)
    return packed.mapInArrow(run, f"r {packed.schema['r'].dataType.simpleString()}, n_bytes bigint, media binary").select("r.*", "n_bytes", "media")


_READ = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, streams int, packets bigint, lost bigint, timestamps array<bigint>, decoding_timestamps array<bigint>, clock_references array<bigint>, access_points array<bigint>, problems array<string>, feature string"


def read(stored: DataFrame, media: str = "media") -> DataFrame:
    """stored's columns but media, with what a reader finds in it.

    payload_*: the bytes of all elementary streams in order (their length, SHA-256, CRC-32 of the last 64); timestamps
    (of decoding: those of presentation where there are no others) in ticks of 90 kHz, clock_references in ticks of 27 MHz,
    access_points as offsets into the payload; lost: breaks of the counters; problems: what is wrong.
    A null or broken stream gives what could be read and its problems. feature sums it up as text. Columns
    of stored with the names of these give way.
    """

    def look(m: bytes | None) -> tuple:
        streams, wrong = read_stream(m or b"")
        payload = b"".join(s.data for s in streams)
        stamps = [u[1] for s in streams for u in s.units if u[1] is not None]
        decoding = [u[3] for s in streams for u in s.units if u[3] is not None]
        clocks = [c for s in streams for c in s.clocks]
        points = [u[0] for s in streams for u in s.units if u[2]]
        lost, packets = sum(s.lost for s in streams), sum(s.packets for s in streams)
        seen = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8)
        feature = f"units={sum(len(s.units) for s in streams)};packets={packets};lost={lost};pts={stamps[0] if stamps else '-'}..{stamps[-1] if stamps else '-'};access={len(points)};bytes={'/'.join(map(str, seen))}"
        return (len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-64:]), len(m or b""), hashlib.sha256(m or b"").hexdigest(), len(streams), packets, lost, stamps, decoding, clocks, points, wrong, feature)

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = zip(*map(look, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["r", *names])

    names = [x.split(" ")[0] for x in _READ.split(", ")]
    packed = stored.select(F.struct(*[F.col(f"`{c}`") for c in stored.columns if c not in (media, *names)]).alias("r"), media)
    return packed.mapInArrow(run, f"r {packed.schema['r'].dataType.simpleString()}, {_READ}").select("r.*", *names)


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: every text stored as a transport stream and read back."""
    out = read(store(docs.select("doc_id", "text")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "access_points")
