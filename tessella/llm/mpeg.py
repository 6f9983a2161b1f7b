"""Media columns: MPEG audio written and read as byte columns.

``encode`` stores bytes losslessly as a silent MPEG-1 Layer III stream: each frame carries
192 of them as ancillary data behind empty side information, with a checksum; an ID3v2 tag
holds the unpadded length, an Info frame the frame count and seek table, an ID3v1 tag ends
the stream.  ``parse`` reads any MPEG-1/2/2.5 stream: it skips tags, resynchronises on the
next header that a second one confirms, reads Xing/Info tables, verifies Layer III checksums
and keeps every frame's offset, so durations are exact and seeking needs no scan.

Defined results: null is an empty payload (one frame of spaces); damaged bytes between
frames are skipped and counted; a stream without a frame has no frames and duration 0.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

UNIT = 192
FRAME = 240
#: Fixed values of the MPEG audio header: kbit/s by (version 1 or not, layer) and Hz of version 1.
RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = (44100, 48000, 32000)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, (out << 1) ^ 0x8005, out << 1) & 0xFFFF
    return out


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """MPEG's checksum of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[((crc >> 8) ^ rows[:, k]) & 0xFF]
    return crc


class Header(NamedTuple):
    version: int  # 1, 2, or 25 for 2.5
    layer: int
    kbps: int
    hertz: int
    channels: int
    protected: bool
    length: int  # bytes of the frame
    samples: int
    side: int  # bytes of side information


def header(b: bytes) -> Header | None:
    if len(b) < 4 or b[0] != 0xFF or b[1] < 0xE0:
        return None
    version, layer = {0: 25, 2: 2, 3: 1}.get(b[1] >> 3 & 3, 0), 4 - (b[1] >> 1 & 3)
    rate, hz = b[2] >> 4, b[2] >> 2 & 3
    if not version or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    kbps = RATES[version == 1, layer][rate - 1]
    hertz = HERTZ[hz] // {1: 1, 2: 2, 25: 4}[version]
    pad, mono = b[2] >> 1 & 1, b[3] >> 6 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    length = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(version, layer, kbps, hertz, 1 if mono else 2, not b[1] & 1, length, samples, side)


class Stream(NamedTuple):
    offsets: np.ndarray  # of the audio frames
    sizes: np.ndarray
    samples: int
    hertz: int
    channels: int
    layer: int
    version: int
    checked: int  # frames with a checksum
    wrong: int  # of them, those whose checksum fails
    skipped: int  # bytes between frames
    tags: dict[str, str]
    table: dict | None  # the Xing or Info table
    kbps: tuple[int, ...]

    @property
    def milliseconds(self) -> int:
        return self.samples * 1000 // self.hertz if self.hertz else 0


def _id3(data: bytes) -> tuple[int, dict[str, str]]:
    """Length and text frames of an ID3v2 tag at the start; 0 if there is none."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    out, at, end = {}, 10, min(len(data), 10 + size)
    while at + 10 <= end and data[at : at + 4].isalnum():
        n = int.from_bytes(data[at + 4 : at + 8], "big")
        if data[3] == 4:
            n = data[at + 4] << 21 | data[at + 5] << 14 | data[at + 6] << 7 | data[at + 7]
        body = data[at + 10 : at + 10 + n]
        if body[:1] in (b"\0", b"\3") and data[at : at + 1] == b"T":
            text = body[1:].decode("utf-8" if body[0] else "latin-1", "replace").split("\0")
            out["TXXX:" + text[0] if data[at : at + 4] == b"TXXX" else data[at : at + 4].decode()] = text[-1]
        at += 10 + n
    return 10 + size, out


def _xing(data: bytes, at: int, h: Header) -> dict | None:
    p = at + 4 + h.side
    for p in (p, p + 2 * h.protected):
        if data[p : p + 4] in (b"Xing", b"Info"):
            flags, q = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8
            out: dict = {"kind": data[p : p + 4].decode()}
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    out[name] = list(data[q : q + n]) if n == 100 else int.from_bytes(data[q : q + n], "big")
                    q += n
            return out
    return None


def parse(data: bytes) -> Stream:
    """Frames, tags, table and checksums of a stream."""
    start, tags = _id3(data)
    end = len(data)
    if data[-128:-125] == b"TAG" and end - 128 >= start:
        end -= 128
        tags["ID3v1"] = data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").strip()
    raw = np.frombuffer(data, np.uint8)
    at, skipped, samples, wrong, checked = start, 0, 0, 0, 0
    offsets, sizes, kbps, first, table = [], [], {}, None, None
    while at + 4 <= end:
        h = header(data[at : at + 4])
        follows = h and at + h.length + 4 <= end and header(data[at + h.length : at + h.length + 4])
        # the first frame needs a second that agrees with it; later ones agree with the first
        like = first or follows or (h if h and at + h.length >= end else None)
        if not h or at + h.length > end or not like or (like.version, like.layer, like.hertz) != (h.version, h.layer, h.hertz):
            nxt = data.find(b"\xff", at + 1, end)
            skipped += (nxt if nxt > 0 else end) - at
            at = nxt if nxt > 0 else end
            continue
        # a run of frames with one header is taken at once
        n = (end - at) // h.length
        heads = np.lib.stride_tricks.as_strided(raw[at:], (n, 4), (h.length, 1))
        differ = np.flatnonzero((heads != heads[0]).any(1))
        n = int(differ[0]) if len(differ) else n
        if first is None and h.layer == 3 and (table := _xing(data, at, h)):
            first, at = h, at + h.length
            continue
        first = first or h
        where = at + h.length * np.arange(n)
        if h.protected and h.layer == 3:
            body = np.lib.stride_tricks.as_strided(raw[at:], (n, 6 + h.side), (h.length, 1))
            told = body[:, 4].astype(np.uint32) << 8 | body[:, 5]
            wrong += int((crc16(np.concatenate((body[:, 2:4], body[:, 6:]), 1)) != told).sum())
            checked += n
        offsets.append(where)
        sizes.append(np.full(n, h.length))
        kbps[h.kbps] = kbps.get(h.kbps, 0) + n
        samples += n * h.samples
        at += n * h.length
    skipped += max(0, end - at)
    none = np.zeros(0, np.int64)
    f = first or Header(0, 0, 0, 0, 0, False, 0, 0, 0)
    return Stream(np.concatenate(offsets) if offsets else none, np.concatenate(sizes) if sizes else none, samples, f.hertz, f.channels, f.layer, f.version, checked, wrong, skipped, tags, table, tuple(sorted(kbps)))


def _head(b1: int) -> bytes:
    """MPEG-1 Layer III, 80 kbit/s, 48 kHz, mono: 240 bytes a frame."""
    return bytes((0xFF, b1, 0x64, 0xC4))


_SIDE = np.frombuffer(_head(0xFA)[2:] + bytes(17), np.uint8)[None]
_HEAD = np.frombuffer(_head(0xFA) + int(crc16(_SIDE)[0]).to_bytes(2, "big"), np.uint8)


def encode(payload: bytes) -> bytes:
    """A stream that holds ``payload``, filled up with spaces to whole frames."""
    n = max(1, -(-len(payload) // UNIT))
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, :6] = _HEAD
    frames[:, 23 : 23 + UNIT] = np.frombuffer(payload.ljust(n * UNIT, b" "), np.uint8).reshape(n, UNIT)
    text = b"\0bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    size = len(frame)
    tag = b"ID3\3\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + frame
    total = (n + 1) * FRAME
    toc = bytes(min(255, 256 * (FRAME * (1 + k * n // 100)) // total) for k in range(100))
    info = _head(0xFB) + bytes(17) + b"Info" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc + bytes(4)
    return tag + info.ljust(FRAME, b"\0") + frames.tobytes() + b"TAG" + b"stored bytes".ljust(125, b"\0")


def payload(data: bytes, s: Stream | None = None) -> tuple[bytes, int]:
    """The bytes that ``encode`` stored, filled up, and their number before that."""
    s = s or parse(data)
    at = s.offsets[s.sizes == FRAME]
    raw = np.frombuffer(data, np.uint8)
    return raw[at[:, None] + np.arange(23, 23 + UNIT)].tobytes(), int(s.tags.get("TXXX:bytes", len(at) * UNIT))


def feature(s: Stream) -> str:
    return (
        f"mpeg{s.version} layer{s.layer} {s.hertz}Hz {s.channels}ch kbps={','.join(map(str, s.kbps))} frames={len(s.offsets)} samples={s.samples} ms={s.milliseconds} "
        f"crc={s.checked - s.wrong}/{s.checked} skipped={s.skipped} table={(s.table or {}).get('kind', '-')}:{(s.table or {}).get('frames', 0)} seek={zlib.crc32(s.offsets.astype('<i8').tobytes())}"
    )


def to_audio(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): each whole text's bytes as a stream."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                media = [encode((x.as_buffer().to_pybytes() if x.is_valid else b"")) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["key", "media"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, media binary")


def read_audio(media: DataFrame) -> DataFrame:
    """Rows (key, media) read back: digests of the stored payload, exact duration, seek offsets."""
    fields = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate int, duration_ms long, bad_checksums long, seek_offsets array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                cols: list[list] = [[] for _ in range(12)]
                for x in part.column(1):
                    data = x.as_buffer().to_pybytes() if x.is_valid else b""
                    s = parse(data)
                    stored, n = payload(data, s)
                    for c, v in zip(cols, (n, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(s), s.samples, s.hertz, s.milliseconds, s.wrong, s.offsets), strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "sample_rate", "duration_ms", "bad_checksums", "seek_offsets"])

    return media.select("key", "media").mapInArrow(run, fields)
