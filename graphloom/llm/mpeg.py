"""MPEG audio columns: building, resynchronising and indexing frames.

Payloads travel losslessly as ancillary data of silent MPEG-2 layer III frames (16 kHz, mono, 144 kbit/s,
576 samples and 648 bytes a frame, with checksums), behind an ID3v2 tag and an Info frame with a seek
table. The reader takes any MPEG-1/2/2.5 layer I-III stream: it skips tags and junk, resynchronises on
headers that agree with their successors, verifies checksums, reads Xing, Info and VBRI tables, and gives
exact durations and the byte offset of every frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the standard: kbit/s by index, Hz by index, for MPEG-1 and for MPEG-2/2.5.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
UNIT, FRAME, SIDE = 576, 648, 9
HEADER = bytes((0xFF, 0xF2, 0xD8, 0xC0))
_CRC: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005 from 0xFFFF, as frames carry it."""
    if data not in _CRC:
        if len(_CRC) > 4096:
            _CRC.clear()
        crc = 0xFFFF
        for byte in data:
            for bit in range(7, -1, -1):
                crc = ((crc << 1) ^ (0x8005 if (crc >> 15) ^ (byte >> bit & 1) else 0)) & 0xFFFF
        _CRC[data] = crc
    return _CRC[data]


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def padded(payload: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of the frame's unit."""
    return payload + b"\xff" * (max(1, -(-len(payload) // UNIT)) * UNIT - len(payload))


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A stream that carries ``payload`` (a multiple of the unit); the tag holds how many bytes came before padding."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    head = HEADER + struct.pack(">H", crc16(HEADER[2:] + bytes(SIDE))) + bytes(SIDE)
    frames = np.zeros((len(units), FRAME), np.uint8)
    frames[:, : len(head)] = np.frombuffer(head, np.uint8)
    frames[:, len(head) : len(head) + UNIT] = units
    toc = bytes(256 * i // 100 for i in range(100))
    info = head + b"Info" + struct.pack(">III", 7, len(units), FRAME * (len(units) + 1)) + toc
    text = b"\x03n_bytes\x00" + str(n_bytes).encode()
    frame = b"TXXX" + _synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _synchsafe(len(frame)) + frame + info.ljust(FRAME, b"\0") + frames.tobytes()


def header(data: bytes, at: int) -> dict | None:
    """A frame header's fields, or None if there is none at this place."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = {0: 2.5, 2: 2, 3: 1}.get(b1 >> 3 & 3), {1: 3, 2: 2, 3: 1}.get(b1 >> 1 & 3)
    if version is None or layer is None or b2 >> 4 in (0, 15) or b2 >> 2 & 3 == 3:
        return None
    kbps, rate, pad = BITRATES[1 if version == 1 else 2, layer][b2 >> 4], RATES[version][b2 >> 2 & 3], b2 >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    mono = b3 >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return {"version": version, "layer": layer, "kbps": kbps, "rate": rate, "samples": samples, "size": size, "checked": not b1 & 1, "side": side, "mono": mono}


def tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """(start, end) of the audio between tags, and the text fields of an ID3v2 tag."""
    at, end, found = 0, len(data), {}
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        size = sum((b & 0x7F) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        pos, stop, wide = at + 10, min(at + 10 + size, len(data)), data[at + 3] >= 4
        while pos + 10 <= stop and data[pos]:
            raw = data[pos + 4 : pos + 8]
            n = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if wide else int.from_bytes(raw, "big")
            body = data[pos + 10 : pos + 10 + n]
            if data[pos : pos + 1] == b"T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
                key, _, value = text.partition("\0") if data[pos : pos + 4] == b"TXXX" else (data[pos : pos + 4].decode("latin-1"), "", text)
                found[key] = value.rstrip("\0")
            pos += 10 + n
        at += 10 + size + (10 if data[at + 5] & 0x10 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    return min(at, end), end, found


def vbr_table(data: bytes, at: int, h: dict) -> dict | None:
    """The Xing, Info or VBRI table in a frame."""
    pos = at + 4 + (2 if h["checked"] else 0) + h["side"]
    kind = data[pos : pos + 4]
    if kind in (b"Xing", b"Info"):
        flags, pos = int.from_bytes(data[pos + 4 : pos + 8], "big"), pos + 8
        out: dict = {"kind": kind.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
        if flags & 4:
            out["toc"] = list(data[pos : pos + 100])
        return out
    pos = at + 36
    if data[pos : pos + 4] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(data[pos + 10 : pos + 14], "big"), "frames": int.from_bytes(data[pos + 14 : pos + 18], "big")}
    return None


def frames_of(data: bytes) -> dict:
    """Frames, table, tags, junk and checksum failures of a stream; ``offsets`` are the audio frames' places.

    A first frame must be followed by one of its kind or by the end; after a loss the next such place is
    sought. A frame whose own checksum holds needs no neighbour. A last frame that the stream cuts short
    isn't a frame.
    """
    at, end, text = tags(data)
    out = {"tags": text, "table": None, "offsets": [], "bad_crc": 0, "junk": 0, "samples": {}, "kinds": set()}
    kind, first = None, True

    def sound(h: dict, at: int) -> bool:
        return int.from_bytes(data[at + 4 : at + 6], "big") == crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h["side"]])

    while at < end:
        h = header(data, at)
        same = h and kind == (h["version"], h["layer"], h["rate"])
        if h and not same:
            after = header(data, at + h["size"])
            same = h["checked"] and h["layer"] == 3 and sound(h, at)
            same = same or at + h["size"] == end or bool(after) and (after["version"], after["layer"], after["rate"]) == (h["version"], h["layer"], h["rate"])
        if not h or not same or at + h["size"] > end:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out["junk"] += nxt - at
            at, kind = nxt, None
            continue
        kind = (h["version"], h["layer"], h["rate"])
        if h["checked"] and h["layer"] == 3 and not sound(h, at):
            out["bad_crc"] += 1
        table = vbr_table(data, at, h) if first and h["layer"] == 3 else None
        if table:
            out["table"] = table
        else:
            out["offsets"].append(at)
            out["samples"][h["rate"]] = out["samples"].get(h["rate"], 0) + h["samples"]
        first, at = False, at + h["size"]
    out["duration"] = sum((Fraction(n, r) for r, n in out["samples"].items()), Fraction(0))
    return out


def payload_of(data: bytes, offsets: list[int]) -> bytes:
    """The payload that ``encode`` put into the frames at these places."""
    at = np.array(offsets, np.int64) + 4 + 2 + SIDE
    return np.frombuffer(data, np.uint8)[at[:, None] + np.arange(UNIT)].tobytes()


def _batches(rows: Iterator[tuple], names: list[str], types: list, size_of) -> Iterator[pa.RecordBatch]:
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += size_of(row)
        if held > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)


def as_audio(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, media``: each text (null: empty) as an MPEG stream. Repeated rows stay; equal texts, equal streams."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    yield doc, encode(padded(raw), len(raw))

        yield from _batches(rows(), ["doc_id", "media"], [pa.int64(), pa.binary()], lambda r: len(r[1]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(stored, "doc_id long, media binary")


INDEX = "doc_id long, media_bytes long, media_sha256 string, frames long, duration_ms double, duration string, seek array<long>, table string, tags map<string,string>, junk long, bad_crc long, payload_bytes long, payload_sha256 string, tail_crc32 long, mean double"


def audio_index(media: DataFrame) -> DataFrame:
    """Per stream: size, digest, frames, duration (exact, as seconds in a fraction, and in ms), the offset of every frame
    (``seek``), the variable-bitrate table as JSON, tags, junk and checksum failures, and digests of the payload read back.

    A null or frameless stream has no frames, duration 0 and an empty payload.
    """
    names = [f.split(" ")[0] for f in INDEX.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()]

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc, cell in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    data = cell.as_buffer().to_pybytes() if cell.is_valid else b""
                    f = frames_of(data)
                    payload = payload_of(data, f["offsets"]) if f["offsets"] and all(o + 15 + UNIT <= len(data) for o in f["offsets"][-1:]) else b""
                    d = f["duration"]
                    yield (
                        doc, len(data), hashlib.sha256(data).hexdigest(), len(f["offsets"]), float(d * 1000), f"{d.numerator}/{d.denominator}", f["offsets"], json.dumps(f["table"]), list(f["tags"].items()), f["junk"], f["bad_crc"],
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), float(np.frombuffer(payload, np.uint8).mean()) if payload else 0.0,
                    )

        yield from _batches(rows(), names, types, lambda r: 8 * r[3] + 500)

    return media.select("doc_id", "media").mapInArrow(indexed, INDEX)


def op10_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    found = audio_index(as_audio(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    feature = F.format_string("frames=%d;duration=%s;seek=%s;bad_crc=%d;mean=%.4f", "frames", "duration", F.hex(F.xxhash64("seek")), "bad_crc", "mean")
    return found.select("doc_id", F.element_at("tags", "n_bytes").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
