"""MPEG transport streams: tables, packets with continuity counters, elementary packets with timestamps.

`mux` writes one program with one private elementary stream: a program association table and a program map table
ahead of every random-access point, then elementary packets of up to PES_BYTES, each with a presentation timestamp;
the first packet of each also carries a program clock reference and the random-access flag. `demux` reads streams
of any number of programs: it follows the tables, also those of several packets, to the elementary streams, checks
continuity counters, puts elementary packets together again and keeps timestamps and the byte positions of
random-access points.
"""

from __future__ import annotations

import binascii
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_batches

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 0x0000, 0x0100, 0x0101, 0x06, 0xBD
PES_BYTES = 8192
#: Elementary packets between random-access points, and 90 kHz ticks between elementary packets.
RANDOM_ACCESS, TICKS = 4, 3600
PAD = 64


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 04C11DB7, not reflected, no final exclusive or."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ CRC_TABLE[(crc >> 24) ^ b]
    return crc


def _crc_entry(i: int) -> int:
    c = i << 24
    for _ in range(8):
        c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
    return c


CRC_TABLE = [_crc_entry(i) for i in range(256)]


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def table_packet(pid: int, sec: bytes) -> bytearray:
    """A table's packet with continuity counter 0; `mux` sets the running value."""
    return bytearray((bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + sec).ljust(PACKET, b"\xff"))


PAT = table_packet(PAT_PID, section(0, 1, b"\0\1" + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = table_packet(PMT_PID, section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0"))


def stamp(ticks: int) -> bytes:
    """A presentation timestamp, 33 bits with markers."""
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 14, t >> 22 & 255, 1 | t >> 14 & 254, t >> 7 & 255, 1 | t << 1 & 254])


def mux(payload: bytes) -> bytes:
    out: list[bytes] = []
    cc = tables = 0
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        part, access = payload[at : at + PES_BYTES], k % RANDOM_ACCESS == 0
        if access:
            for p in (PAT, PMT):
                q = bytearray(p)
                q[3] |= tables & 15
                out.append(bytes(q))
            tables += 1
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\5" + stamp(k * TICKS) + part
        pos = 0
        while pos < len(pes):
            first = pos == 0
            extra = b""  # of the adaptation field, after its length
            if first:
                base = k * TICKS & (1 << 33) - 1
                extra = bytes([0x10 | 0x40 * access]) + (base << 15 | 0x7E00).to_bytes(6, "big")
            room = PACKET - 4 - (1 + len(extra) if first else 0)
            body = pes[pos : pos + room]
            pos += len(body)
            if len(body) < room:  # stuffing
                lack = room - len(body)
                if first:
                    extra += b"\xff" * lack
                else:
                    extra = b"" if lack == 1 else b"\0" + b"\xff" * (lack - 2)
                    first = True
            out.append(bytes([SYNC, 0x40 * (pos == len(body)) | ES_PID >> 8, ES_PID & 255, (0x30 if first else 0x10) | cc]))
            if first:
                out.append(bytes([len(extra)]) + extra)
            out.append(body)
            cc = cc + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """One elementary stream as read back."""

    pid: int
    kind: int
    program: int
    packets: list[bytes] = field(default_factory=list)
    pts: list[int | None] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)


@dataclass
class Parsed:
    streams: list[Stream]
    n_packets: int = 0
    continuity_errors: int = 0
    sync_errors: int = 0
    crc_errors: int = 0
    transport_errors: int = 0
    lost_packets: int = 0


#: Longest program table section, and stream ids whose elementary packets have no header beyond their length (maps,
#: padding, private 2, ECM, EMM, DSM-CC, H.222.1 type E, directory).
MOST_SECTION = 1024
PADDING_ID, PLAIN_IDS = 0xBE, frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))


class Sections:
    """Puts the sections of one table's packets together; one may take several packets, and a packet may hold several."""

    def __init__(self):
        self.held = b""

    def take(self, body: bytes, unit: bool, gap: bool) -> list[bytes | None]:
        """The sections that end in this packet's body; None stands for one that is cut."""
        out: list[bytes | None] = []
        held, self.held = self.held, b""
        if gap and held:
            out.append(None)
            held = b""
        if unit:
            start = 1 + body[0] if body else 0
            if held:
                out += self.cut(held + body[1:start])
                if self.held:
                    out.append(None)
                    self.held = b""
            return out + self.cut(body[start:])
        return out + self.cut(held + body) if held else out

    def cut(self, data: bytes) -> list[bytes | None]:
        out: list[bytes | None] = []
        while data and data[0] != 0xFF:  # stuffing follows
            size = 3 + ((data[1] & 15) << 8 | data[2]) if len(data) >= 3 else MOST_SECTION
            if size > MOST_SECTION:
                return [*out, None]
            if len(data) < size:
                self.held = data
                break
            out.append(data[:size])
            data = data[size:]
        return out


def read_pes(pes: bytes) -> tuple[bytes, int | None] | None:
    """Payload and presentation timestamp of an elementary packet; None if it is cut or no such packet."""
    if len(pes) < 6 or pes[:3] != b"\0\0\1":
        return None
    size, plain = pes[4] << 8 | pes[5], pes[3] in PLAIN_IDS
    if len(pes) < 6 + size or not plain and (len(pes) < 9 or len(pes) < 9 + pes[8] or size and size < 3 + pes[8]):
        return None
    body, time = pes[6 if plain else 9 + pes[8] : 6 + size if size else len(pes)], None
    if not plain and pes[7] & 0x80 and pes[8] >= 5:
        t = pes[9:14]
        time = (t[0] & 14) << 29 | t[1] << 22 | (t[2] & 254) << 14 | t[3] << 7 | t[4] >> 1
    return body, time


def demux(data: bytes) -> Parsed:
    """All elementary streams that the program tables name. Elementary packets that lack a part (after a gap of the
    continuity counter, or cut) are left out and counted in lost_packets, as is what a stream has before its first start
    of a packet. A packet may come twice; a jump that its discontinuity flag announces is no error."""
    out = Parsed([])
    tables = {PAT_PID: Sections()}
    streams: dict[int, Stream] = {}
    pending: dict[int, list[bytes]] = {}
    last: dict[int, int] = {}
    again: set[int] = set()  # pids whose last packet came twice
    whole: dict[bytes, bool] = {}

    def flush(pid: int) -> None:
        parts = pending.pop(pid, None)
        if not parts:
            return
        pes = b"".join(parts)
        if pes[3:4] == bytes([PADDING_ID]) and pes[:3] == b"\0\0\1":
            return
        found = read_pes(pes)
        if found is None:
            out.lost_packets += 1
            return
        streams[pid].packets.append(found[0])
        streams[pid].pts.append(found[1])

    def apply(pid: int, s: bytes | None) -> None:
        if s is not None and s not in whole:
            whole[s] = len(s) >= 12 and crc32_mpeg(s) == 0
        if s is None or not whole[s]:
            out.crc_errors += 1
        elif not s[5] & 1:  # not valid yet
            return
        elif pid == PAT_PID and s[0] == 0:
            for i in range(8, len(s) - 4, 4):
                if s[i] or s[i + 1]:
                    tables.setdefault((s[i + 2] & 31) << 8 | s[i + 3], Sections())
        elif pid != PAT_PID and s[0] == 2:
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while i + 5 <= len(s) - 4:
                es = (s[i + 1] & 31) << 8 | s[i + 2]
                if es not in streams and es not in tables:
                    streams[es] = Stream(es, s[i], s[3] << 8 | s[4])
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])

    pos, n = 0, len(data)
    while pos + PACKET <= n:
        if data[pos] != SYNC:  # look for the next sync byte that has another one packet later
            out.sync_errors += 1
            pos += 1
            while pos + PACKET <= n and not (data[pos] == SYNC and (pos + PACKET == n or data[pos + PACKET] == SYNC)):
                pos += 1
            continue
        at, end = pos + 4, pos + PACKET
        b1, b3 = data[pos + 1], data[pos + 3]
        pid, unit, flags, cc = (b1 & 31) << 8 | data[pos + 2], b1 & 0x40, b3 & 0x30, b3 & 15
        start, pos = pos, end
        out.n_packets += 1
        if b1 & 0x80:  # damaged on its way; not even its pid is certain
            out.transport_errors += 1
            continue
        access = jump = False
        if flags & 0x20:
            if data[at]:
                access, jump = bool(data[at + 1] & 0x40), bool(data[at + 1] & 0x80)
            at += 1 + data[at]
        if not flags & 0x10 or pid == 0x1FFF:
            continue
        gap = False
        if pid in last and cc != last[pid] + 1 & 15:
            if cc == last[pid] and not jump and pid not in again:  # a repeated packet
                again.add(pid)
                continue
            gap = True
            out.continuity_errors += not jump
        last[pid] = cc
        again.discard(pid)
        if pid in tables:
            for s in tables[pid].take(data[at:end], bool(unit), gap):
                apply(pid, s)
        elif pid in streams:
            if gap and pending.pop(pid, None):
                out.lost_packets += 1
            if unit:
                flush(pid)
                pending[pid] = []
                if access:
                    streams[pid].random_access.append(start)
            if pid in pending:
                pending[pid].append(data[at:end])
    for pid in list(pending):
        flush(pid)
    out.crc_errors += sum(bool(t.held) for t in tables.values())
    out.streams = [streams[p] for p in sorted(streams)]
    return out


def padded(data: bytes) -> bytes:
    """`data` with bytes 0 up to a positive multiple of PAD."""
    return data + b"\0" * (PAD - len(data) % PAD if data else PAD) if len(data) % PAD or not data else data


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "media") -> DataFrame:
    """Rows (id, n_bytes, out): each text's UTF-8 bytes, padded, as a transport stream; a null text counts as empty."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            raw = [(x or "").encode() for x in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], names=[id_col, "n_bytes", out])

        return batch

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, n_bytes long, `{out}` binary")


PARSED = "payload binary, n_packets long, n_streams int, stream_pid int, stream_type int, pts array<bigint>, random_access array<bigint>, continuity_errors long, sync_errors long, crc_errors long, transport_errors long, lost_packets long"


def parse_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """`df` with what its transport streams hold: the bytes of the elementary stream of the least pid, its timestamps
    (90 kHz) and random-access points (byte positions of packets), and error counts. `media_streams` gives all streams.

    Null, empty or foreign bytes give an empty payload, no streams and null pid and type; damaged packets are
    counted and skipped. Columns of these names that `df` already has are replaced.
    """
    names = [x.split()[0] for x in PARSED.split(", ")]
    df = df.drop(*names)
    at = df.columns.index(media_col)

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [demux(x or b"") for x in b.column(at).to_pylist()]
            first = [r.streams[0] if r.streams else None for r in rows]
            new = [
                pa.array([b"".join(s.packets) if s else b"" for s in first], pa.binary()),
                pa.array([r.n_packets for r in rows], pa.int64()),
                pa.array([len(r.streams) for r in rows], pa.int32()),
                pa.array([s and s.pid for s in first], pa.int32()),
                pa.array([s and s.kind for s in first], pa.int32()),
                pa.array([s.pts if s else [] for s in first], pa.list_(pa.int64())),
                pa.array([s.random_access if s else [] for s in first], pa.list_(pa.int64())),
                *(pa.array([getattr(r, k) for r in rows], pa.int64()) for k in names[-5:]),
            ]
            return pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

        return batch

    return map_batches(df, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + PARSED)


def media_streams(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Rows (id, program, pid, type, payload, pts, random_access), one for each elementary stream of each row of `df`, by
    pid; what holds no stream gives no row. Repeated rows give repeated streams; other columns are not read."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            at, found = [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                for s in demux(x or b"").streams:
                    at.append(i)
                    found.append(s)
            new = [
                pa.array([s.program for s in found], pa.int32()),
                pa.array([s.pid for s in found], pa.int32()),
                pa.array([s.kind for s in found], pa.int32()),
                pa.array([b"".join(s.packets) for s in found], pa.binary()),
                pa.array([s.pts for s in found], pa.list_(pa.int64())),
                pa.array([s.random_access for s in found], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *new], names=[id_col, "program", "pid", "type", "payload", "pts", "random_access"])

        return batch

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col), F.col(media_col)), make, f"`{id_col}` {kind}, program int, pid int, type int, payload binary, pts array<bigint>, random_access array<bigint>")


def media_digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: sizes and hashes of the stored stream and of the payload read back, and a feature string. A null text
    is empty: 0 bytes, a payload of 64 zero bytes. Null ids pass through, repeated rows stay, an empty table gives an empty
    result; columns other than `id_col` and text are not read."""
    d = parse_media(write_media(df, id_col))
    return d.select(
        id_col,
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat_ws("=", F.lit("packets"), F.col("n_packets")),
            F.concat_ws("=", F.lit("pid"), F.col("stream_pid")),
            F.concat_ws("=", F.lit("type"), F.col("stream_type")),
            F.concat_ws("=", F.lit("pes"), F.size("pts")),
            F.concat_ws("=", F.lit("pts"), F.array_min("pts"), F.array_max("pts")),
            F.concat_ws("=", F.lit("access"), F.array_join(F.col("random_access").cast("array<string>"), "+")),
            F.concat_ws("=", F.lit("cc_errors"), F.col("continuity_errors")),
        ).alias("feature"),
    )
