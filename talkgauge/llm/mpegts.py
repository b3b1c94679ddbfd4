"""Media columns as MPEG transport streams: bytes are multiplexed, parsed again and described.

A payload of 8-bit samples (frames of 576 bytes) becomes elementary packets of up to 32 frames, each with
a presentation time; these are cut into transport packets of 188 bytes behind a program association and a
program map table. Reading parses both tables (with their checksums), follows the program's stream,
checks continuity counters, reassembles the elementary packets and keeps their timestamps and the
random-access points. A packet that repeats the one before it, as the standard allows once, is taken once; a
counter that jumps counts as an error, unless the packet announces it, and what is left of its elementary packet is kept.

Null and empty media have no packets and decode to no payload. Media that can't be read (cut short, out of
synchronisation, without tables or with damaged ones) have no payload and say why in the column ``error``;
the rows beside them are untouched. Equal texts give equal media; repeated rows are stored each. Very long
texts are stored whole, one row a batch. An empty table gives an empty result.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talkgauge.llm.common import mapped, without

# Fixed values of ISO/IEC 13818-1 and of this layout.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID = 0x0000, 0x1000, 0x0100
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
FRAME = 576
FRAMES_PER_PES = 32
#: 576 samples at 8 kHz in ticks of 90 kHz.
TICKS_PER_FRAME = 6480
#: Every so many elementary packets, one is marked as a random-access point and carries a clock reference.
RANDOM_ACCESS_EVERY = 4
BATCH_BYTES = 16 << 20


_CRCS: dict[bytes, int] = {}


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, not reflected, no final inversion."""
    if data in _CRCS:
        return _CRCS[data]
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    if len(_CRCS) < 256:
        _CRCS[data] = crc
    return crc


def _section(table_id: int, table_ext: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, table_ext, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _tables() -> bytes:
    pat = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _section(2, 1, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, PRIVATE_DATA, 0xE000 | STREAM_PID, 0xF000))
    return b"".join(
        (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff") for pid, section in ((PAT_PID, pat), (PMT_PID, pmt))
    )


def _stamp(prefix: int, pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([prefix << 4 | pts >> 29 & 14 | 1, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def multiplex(payload: bytes) -> bytes:
    """The payload as a transport stream: two table packets, then its elementary packets. Empty: nothing."""
    if not payload:
        return b""
    out, counter, size = [np.frombuffer(_tables(), np.uint8).reshape(-1, PACKET)], 0, FRAME * FRAMES_PER_PES
    for k, at in enumerate(range(0, len(payload), size)):
        body = payload[at : at + size]
        pts = k * FRAMES_PER_PES * TICKS_PER_FRAME
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM_1, len(body) + 8, 0x80, 0x80, 5) + _stamp(2, pts) + body
        clock = k % RANDOM_ACCESS_EVERY == 0
        lead = 8 if clock else 0  # bytes of the first packet's adaptation field
        first = min(184 - lead, len(pes))
        full, tail = divmod(len(pes) - first, 184)
        n = 1 + full + (tail > 0)
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        counter = (counter + n) % 16
        packets[0, 1] |= 0x40
        raw = np.frombuffer(pes, np.uint8)
        pad = 184 - lead - first  # only when the whole packet is short
        if clock or pad:
            packets[0, 3] |= 0x20
            packets[0, 4] = lead + pad - 1
            if lead + pad > 1:
                packets[0, 5] = 0x50 if clock else 0
            if clock:
                base = pts & (1 << 33) - 1
                packets[0, 6:12] = np.frombuffer(struct.pack(">IH", base >> 1, (base & 1) << 15 | 0x7E00), np.uint8)
        packets[0, PACKET - first :] = raw[:first]
        if full:
            packets[1 : 1 + full, 4:] = raw[first : first + 184 * full].reshape(full, 184)
        if tail:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = 183 - tail
            if tail < 183:
                packets[-1, 5] = 0
            packets[-1, PACKET - tail :] = raw[first + 184 * full :]
        out.append(packets)
    return np.concatenate(out).tobytes()


def _parse_tables(packets: np.ndarray, pids: np.ndarray) -> tuple[int, int]:
    """The stream's packet id and type, by way of both tables."""

    def section(pid: int, table_id: int) -> bytes:
        at = np.flatnonzero((pids == pid) & (packets[:, 1] & 0x40 > 0))
        if not len(at):
            raise ValueError(f"no table of packet id {pid}")
        row = packets[at[0]].tobytes()
        begin = 5 + row[4]
        end = begin + 3 + (struct.unpack(">H", row[begin + 1 : begin + 3])[0] & 0xFFF) if begin + 3 <= PACKET else PACKET + 1
        if end > PACKET or end < begin + 16 or row[begin] != table_id or section_crc(row[begin : end - 4]) != struct.unpack(">I", row[end - 4 : end])[0]:
            raise ValueError(f"table of packet id {pid} is damaged")
        return row[begin + 8 : end - 4]

    program_map = struct.unpack(">HH", section(PAT_PID, 0)[:4])[1] & 0x1FFF
    body = section(program_map, 2)
    skip = 4 + (struct.unpack(">H", body[2:4])[0] & 0xFFF)
    if len(body) < skip + 5:
        raise ValueError("the program has no stream")
    kind, pid = struct.unpack(">BH", body[skip : skip + 3])
    return pid & 0x1FFF, kind


def demultiplex(media: bytes | None) -> dict:
    """payload, n_packets, n_pes, cc_errors, pts (list), random_access (elementary packet numbers), pid, stream_type."""
    out = {"payload": b"", "n_packets": 0, "n_pes": 0, "cc_errors": 0, "pts": [], "random_access": [], "pid": None, "stream_type": None}
    if not media:
        return out
    if len(media) % PACKET:
        raise ValueError("a transport stream is a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pid, kind = _parse_tables(packets, pids)
    own = packets[pids == pid]
    own = own[~_repeats(own)]
    has_payload = own[:, 3] & 0x10 > 0
    field = np.where(own[:, 3] & 0x20, own[:, 4].astype(np.int32) + 1, 0)
    if (field > PACKET - 4).any():
        raise ValueError("an adaptation field is longer than its packet")
    announced = ((field > 1) & (own[:, 5] & 0x80 > 0))[has_payload]
    counters = own[has_payload, 3].astype(np.int16) & 15
    errors = int((((counters[1:] - counters[:-1]) % 16 != 1) & ~announced[1:]).sum())
    begin = np.where(has_payload, 4 + field, PACKET)
    data = own[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    starts = np.flatnonzero((own[:, 1] & 0x40 > 0) & has_payload)
    marked = (field > 1) & (own[:, 5] & 0x40 > 0)
    bounds = [*(ends[starts] - (PACKET - begin[starts])).tolist(), len(data)]
    parts = []
    for k, (at, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if end - at < 9 or data[at : at + 3] != b"\0\0\1":
            raise ValueError("an elementary packet doesn't begin with its prefix")
        length, header = struct.unpack(">H", data[at + 4 : at + 6])[0], data[at + 8]
        last = at + 6 + length if length else end  # length 0: up to the next elementary packet
        if last > end and not errors or at + 9 + header > last:
            raise ValueError("an elementary packet is cut short")
        if data[at + 7] & 0x80 and header >= 5:
            s = data[at + 9 : at + 14]
            out["pts"].append((s[0] & 14) << 29 | s[1] << 22 | (s[2] & 254) << 14 | s[3] << 7 | s[4] >> 1)
        parts.append(data[at + 9 + header : min(last, end)])
        if marked[starts[k]]:
            out["random_access"].append(k)
    return out | {"payload": b"".join(parts), "n_packets": len(packets), "n_pes": len(parts), "cc_errors": errors, "pid": pid, "stream_type": kind}


def _repeats(own: np.ndarray) -> np.ndarray:
    """Which packets of one id repeat the one before: same counter, same payload; clock references may differ. Two in a row count once."""
    out = np.zeros(len(own), bool)
    same = np.flatnonzero((own[1:, 3] == own[:-1, 3]) & (own[1:, 3] & 0x10 > 0)) + 1
    for i in same.tolist():
        x, y = own[i - 1].copy(), own[i].copy()
        if x[3] & 0x20 and x[4] >= 7 and y[4] == x[4] and x[5] & 0x10:
            x[6:12] = y[6:12] = 0
        out[i] = bool((x == y).all()) and not out[i - 1]
    return out


def padded(raw: bytes) -> bytes:
    """``raw`` and bytes 255 up to a positive multiple of the frame."""
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b"\xff")


def _map(df: DataFrame, schema: T.StructType, at: int, row, drop: bool):
    """``df`` (less column ``at`` if ``drop``) with what ``row`` makes of each value, in batches of bounded bytes."""
    names = [f.name for f in schema.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(schema)]
        for b in batches:
            rest = [c for i, c in enumerate(b.columns) if not (drop and i == at)]
            start, size, rows = 0, 0, []
            for i, value in enumerate(b.column(at).to_pylist()):
                made, weight = row(value)
                rows.append(made)
                size += weight
                if size >= BATCH_BYTES or i == b.num_rows - 1:
                    own = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[len(rest) :], strict=True)]
                    yield pa.RecordBatch.from_arrays([*[c.slice(start, i + 1 - start) for c in rest], *own], names=names)
                    start, size, rows = i + 1, 0, []

    return mapped(df, run, schema)


def store(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``docs`` without its text, with n_bytes (of the text in UTF-8) and the padded text as a transport stream."""
    docs = without(docs, media_col, "n_bytes")
    rest = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*rest, T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())])

    def row(text):
        raw = (text or "").encode()
        media = multiplex(padded(raw))
        return (len(raw), media), len(media)

    return _map(docs, schema, docs.columns.index(text_col), row, drop=True)


def load(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """``stored`` with what its media column holds: payload, n_packets, n_pes, cc_errors, pts, random_access, stream_type; error says why not."""
    own = [
        T.StructField("payload", T.BinaryType()),
        T.StructField("n_packets", T.LongType()),
        T.StructField("n_pes", T.LongType()),
        T.StructField("cc_errors", T.LongType()),
        T.StructField("pts", T.ArrayType(T.LongType())),
        T.StructField("random_access", T.ArrayType(T.LongType())),
        T.StructField("stream_type", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
    stored = without(stored, *[f.name for f in own])

    def row(media):
        try:
            x = demultiplex(media) | {"error": None}
        except ValueError as wrong:
            x = {"error": str(wrong)}
        return tuple(x.get(f.name) for f in own), len(x.get("payload") or b"") + len(media or b"")

    return _map(stored, T.StructType([*stored.schema.fields, *own]), stored.columns.index(media_col), row, drop=False)
