"""MPEG audio columns: a payload stored losslessly in Layer III frames, and the reader that takes such streams apart.

Writer: an ID3v2 tag with the payload's length, a frame that carries the variable-bitrate ("Xing") table, then frames
whose side information is all zero (silence) and whose main-data area carries the payload, each with its CRC-16. The
last frame takes the smallest bitrate that holds what is left, so bitrates vary.

Reader: skips or parses ID3v2 and ID3v1 tags, finds frames by header and confirms each by its successor (resynchronising
after junk), parses the variable-bitrate table, verifies checksums, and derives exact durations (samples over sampling
rate) and the byte offset of every frame for seeking.

Defined cases: a null text is an empty payload of 64 zero bytes; repeated texts give equal media; very long texts span
as many frames as they need and are handled frame by frame; a stream cut short yields the whole frames before the cut.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize

#: Fixed values of the MPEG-1 and MPEG-2/2.5 audio formats (kbit/s by index, Hz by index).
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}
#: Side information bytes of Layer III by (version 1?, mono?).
SIDE = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    crc: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int


@lru_cache(maxsize=4096)
def parse_header(word: bytes) -> Header | None:
    """A frame header, or None if the four bytes aren't one. Free-format and reserved values aren't taken."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get((word[1] >> 3) & 3)
    layer = 4 - ((word[1] >> 1) & 3)
    bits, rate = word[2] >> 4, (word[2] >> 2) & 3
    if version is None or layer == 4 or rate == 3 or bits in (0, 15) or word[3] & 3 == 2:
        return None
    kbps = BITRATES[(1 if version == 1 else 2, layer)][bits]
    hz, pad = RATES[version][rate], (word[2] >> 1) & 1
    if layer == 1:
        size, samples = (12000 * kbps // hz + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == 1 else 576
        size = samples // 8 * 1000 * kbps // hz + pad
    return Header(version, layer, not word[1] & 1, kbps, hz, word[3] >> 6 == 3, size, samples)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """The format's CRC-16 (polynomial 0x8005, initial value 0xFFFF) over header bytes 2-3 and side information."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


def synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


_PREFIX = 4 + 2 + 17
#: MPEG-1 Layer III, protected, 48 kHz, mono: frame bytes are 3 times the kbit/s, with no rounding or padding.
_FRAMES = {k: bytes([0xFF, 0xFA, i << 4 | 1 << 2, 0xC0]) for i, k in enumerate(BITRATES[(1, 3)]) if k}
_HEADS = {k: h + struct.pack(">H", crc16(h[2:4] + bytes(17))) + bytes(17) for k, h in _FRAMES.items()}


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The payload as an MPEG stream."""
    text = b"\x03PAYLOAD\x00" + str(n_bytes).encode()
    body = b"TXXX" + synchsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + synchsafe(len(body)) + body
    room, frames, at = 960 - _PREFIX, [], 0
    head = _HEADS[320]
    while len(payload) - at > room:
        frames += (head, payload[at : at + room])
        at += room
    left = len(payload) - at
    kbps = next(k for k in _FRAMES if 3 * k - _PREFIX >= left)
    frames += (_HEADS[kbps], payload[at:], bytes(3 * kbps - _PREFIX - left))
    count = -(-max(len(payload), 1) // room)
    sizes = [960] * (count - 1) + [3 * kbps]
    total = 384 + sum(sizes)
    toc = bytes(min(255, (384 + 960 * min(count - 1, i * count // 100)) * 256 // total) for i in range(100))
    info = b"Xing" + struct.pack(">III", 7, count, total) + toc
    first = _HEADS[128] + info + bytes(384 - _PREFIX - len(info))
    return b"".join([tag, first, *frames])


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    tag_bytes: int = 0
    id3v1: bool = False
    vbr: dict = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    kbps: list[int] = field(default_factory=list)
    bodies: list[tuple[int, int]] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    junk: int = 0
    crc_ok: int = 0
    crc_bad: int = 0

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def _checksum(data: bytes, at: int, h) -> bool | None:
    """Whether the checksum of the frame at ``at`` holds; None if it has none that covers known bytes."""
    if not h.crc or h.layer != 3:
        return None
    side = SIDE[(h.version == 1, h.mono)]
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]) == int.from_bytes(data[at + 4 : at + 6], "big")


def _begins_frame(data: bytes, at: int, end: int) -> bool:
    """A header whose checksum holds and whose frame ends at another header or the stream's end."""
    h = parse_header(data[at : at + 4])
    if not h or h.size <= 4 or at + h.size > end:
        return False
    return bool(_checksum(data, at, h)) and (at + h.size == end or bool(parse_header(data[at + h.size : at + h.size + 4])))


def _cut_short(data: bytes, at: int, nxt: int, end: int) -> bool:
    """Whether a good frame begins inside the frame at..nxt: then bytes of this one are missing."""
    q = data.find(b"\xff", at + 4, nxt)
    while q >= 0:
        if _begins_frame(data, q, end):
            return True
        q = data.find(b"\xff", q + 1, nxt)
    return False


def decode(data: bytes) -> Stream:
    """Take a stream apart. A frame counts only if another header, a trailing tag or the end follows it; or if its checksum
    holds and no good frame begins inside it (then what follows is junk)."""
    s, at, end = Stream(), 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        size = (data[6] << 21) | (data[7] << 14) | (data[8] << 7) | data[9]
        s.tag_bytes, p, at = 10 + size, 10, min(end, 10 + size)
        while p + 10 <= at and data[p] != 0:
            key, n = data[p : p + 4].decode("latin-1"), data[p + 4 : p + 8]
            n = (n[0] << 21) | (n[1] << 14) | (n[2] << 7) | n[3] if data[3] >= 4 else int.from_bytes(n, "big")
            name, _, value = data[p + 11 : p + 10 + n].partition(b"\x00") if key == "TXXX" else (key.encode(), b"", data[p + 11 : p + 10 + n])
            s.tags[name.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
            p += 10 + n
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        s.id3v1, end = True, end - 128
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        nxt = at + h.size if h else 0
        side = SIDE[(h.version == 1, h.mono)] if h and h.layer == 3 else 0
        ok = _checksum(data, at, h) if h else None
        checked = ok is not None
        follows = bool(h and h.size > 4 and nxt <= end and (nxt == end or parse_header(data[nxt : nxt + 4])))
        if not (follows or (ok and h.size > 4 and nxt <= end and not _cut_short(data, at, nxt, end))):
            found = data.find(b"\xff", at + 1, end)
            s.junk += (end if found < 0 else found) - at
            at = end if found < 0 else found
            continue
        body = at + 4 + 2 * h.crc + side
        if checked:
            s.crc_ok, s.crc_bad = s.crc_ok + ok, s.crc_bad + (not ok)
        if not s.offsets and not s.vbr and data[body : body + 4] in (b"Xing", b"Info"):
            flags, p = struct.unpack(">I", data[body + 4 : body + 8])[0], body + 8
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    s.vbr[key] = struct.unpack(">I", data[p : p + 4])[0]
                    p += 4
            if flags & 4:
                s.vbr["toc"] = data[p : p + 100]
        else:
            s.offsets.append(at)
            s.kbps.append(h.kbps)
            s.bodies.append((body, nxt))
            s.samples += h.samples
            s.rate = h.rate
        at = nxt
    s.junk += max(0, end - at) if at < end else 0
    return s


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def payload_of(data: bytes, s: Stream) -> tuple[bytes, int]:
    """The stored payload and its unpadded length, from the frames' main data."""
    n = int(s.tags.get("PAYLOAD", "0"))
    size = max(64, -(-n // 64) * 64)
    return b"".join([data[a:b] for a, b in s.bodies])[:size], n


STORED = "doc_id long, media binary"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_us long, n_samples long, sample_rate int, seek_offsets array<long>"


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in by_bytes(batch, 1):
                media = [encode(*padded(x)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED)


def probe(media: DataFrame) -> DataFrame:
    """Features of stored media, from the stored bytes alone."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        for batch in batches:
            for part in by_bytes(batch, 1):
                rows = []
                for i, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = decode(data)
                    payload, n = payload_of(data, s)
                    spread = f"{min(s.kbps)}-{max(s.kbps)}" if s.kbps else "none"
                    feature = f"mpeg1-layer3 {s.rate}Hz mono kbps={spread} frames={len(s.offsets)} us={s.duration_us} crc={s.crc_ok}ok/{s.crc_bad}bad junk={s.junk} vbr={s.vbr.get('frames')}/{s.vbr.get('bytes')}"
                    rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(s.offsets), s.duration_us, s.samples, s.rate, s.offsets))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.mapInArrow(run, RESULT)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as MPEG audio in a table of the shared folder, read it back and probe it."""
    return probe(materialize(store(docs), "mpeg"))
