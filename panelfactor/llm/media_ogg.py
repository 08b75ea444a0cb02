"""Media columns (3): Ogg.

`read` takes the bytes of an Ogg file: it verifies each page's checksum,
demultiplexes pages by serial number, reassembles packets from lacing values
(across pages where a page continues a packet), and derives the time of every
packet from granule positions.  `write` is its counterpart.

The stored form here is 8-bit mono PCM in two logical streams: a header packet
and blocks of BLOCK samples, dealt to the streams in turn.  A page's granule
position is the number of samples of the whole signal up to the end of the
last packet completed on it, so blocks merge back in order of time.

The checksum is CRC-32 with polynomial 0x04C11DB7, high bit first, from 0.  On
bit-reversed bytes that is the CRC-32 of zlib without its initial and final
inversions, which makes it a table translation and a library call.

Defined cases: a null text is empty and its payload 64 zero bytes; equal texts
give equal values, as serial numbers come from the payload; damaged pages are
counted and skipped, with the packets that they interrupt; rows stay as they
are, with any id.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.llm import _words as W
from panelfactor.llm._spark import arrow, documents, findable

RATE, BLOCK = 8000, 4000
#: lacing values on a page at most (the format allows 255): a block of samples takes 16, so its packet goes over two pages
SEGMENTS = 12
MAGIC = b"PCM8\x01"
#: of the header packet: number of the stream, rate, samples of a block
_FORMAT = struct.Struct("<BII")

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


def crc(data: bytes) -> int:
    """The Ogg page checksum."""
    x = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    check = crc(head + body)
    return head[:22] + check.to_bytes(4, "little") + head[26:] + body


class Writer:
    """One logical stream: packets in, pages out."""

    def __init__(self, serial: int, segments: int = SEGMENTS):
        self.serial, self.segments, self.number = serial, segments, 0

    def pages(self, packet: bytes, granule: int, last: bool = False) -> Iterator[bytes]:
        """The pages of one packet; only the page that ends it has its granule position."""
        lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        for k in range(0, len(lacing), self.segments):
            own = lacing[k : k + self.segments]
            ends = k + self.segments >= len(lacing)
            body = packet[k * 255 : k * 255 + sum(own)]
            flags = CONTINUED * (k > 0) + FIRST * (self.number == 0) + LAST * (last and ends)
            yield page(flags, granule if ends else -1, self.serial, self.number, own, body)
            self.number += 1


def write(payload: bytes, rate: int = RATE, block: int = BLOCK) -> bytes:
    """Store samples as an Ogg file of two logical streams."""
    seed = zlib.crc32(payload)
    streams = [Writer(seed), Writer(seed ^ 0x5BD1E995)]
    out = [b"".join(s.pages(MAGIC + _FORMAT.pack(k, rate, block), 0)) for k, s in enumerate(streams)]
    blocks = range(0, len(payload), block)
    for k, at in enumerate(blocks):
        end = min(at + block, len(payload))
        out += streams[k % 2].pages(payload[at:end], end, k + 2 >= len(blocks))
    if len(blocks) < 2:  # the second stream ends without a block
        out += streams[1].pages(b"", 0, True)
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[tuple[bytes, int]] = field(default_factory=list)  # bytes, granule position (-1: unknown)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _part: list[bytes] = field(default_factory=list)
    _open: bool = False
    _next: int | None = None


@dataclass
class Media:
    streams: dict[int, Stream]
    pages: int
    damaged: int


def read(data: bytes) -> Media:
    """Pages, checksums and packets of an Ogg file; bytes between pages are skipped."""
    streams: dict[int, Stream] = {}
    at, pages, damaged = data.find(b"OggS"), 0, 0
    while at >= 0 and at + _HEAD.size <= len(data):
        _, version, flags, granule, serial, number, check, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data) or crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != check:
            damaged += 1
            at = data.find(b"OggS", at + 4)
            continue
        pages += 1
        s = streams.setdefault(serial, Stream(serial))
        s.pages += 1
        s.ended |= bool(flags & LAST)
        gap = s._next is not None and number != s._next
        s._next = (number + 1) & 0xFFFFFFFF
        if s._open and (gap or not flags & CONTINUED):  # what was begun has no end
            s.lost += 1
            s._part, s._open = [], False
        skip = bool(flags & CONTINUED) and not s._open  # the end of a packet whose begin is missing
        s.lost += skip
        place, done = at + 27 + n, []
        for x in lacing:
            if not skip:
                s._part.append(data[place : place + x])
                s._open = True
            place += x
            if x < 255:
                if not skip:
                    done.append(b"".join(s._part))
                skip, s._part, s._open = False, [], False
        # the granule position is that of the last packet that ends here
        s.packets += [(p, granule if k == len(done) - 1 else -1) for k, p in enumerate(done)]
        at = data.find(b"OggS", end)
    return Media(streams, pages, damaged)


def rate_of(stream: Stream) -> int | None:
    """Samples a second, from the stream's header packet; None for streams of other kinds."""
    head = stream.packets[0][0] if stream.packets else b""
    return _FORMAT.unpack_from(head, len(MAGIC))[1] if head.startswith(MAGIC) and len(head) == len(MAGIC) + _FORMAT.size else None


def positions(stream: Stream) -> list[int | None]:
    """The position at which each packet ends.

    A page tells that of the last packet which ends on it.  One before it is
    known where the durations are: one sample for each byte in streams of our
    own kind.
    """
    out: list[int | None] = [None if g < 0 else g for _, g in stream.packets]
    if rate_of(stream) is not None:
        for k in range(len(out) - 2, 0, -1):
            if out[k] is None and out[k + 1] is not None:
                out[k] = out[k + 1] - len(stream.packets[k + 1][0])
    return out


def timeline(media: Media) -> list[tuple[int, int, bytes]]:
    """(first sample, last sample + 1, samples) of all blocks by time, from both streams."""
    out = []
    for s in media.streams.values():
        if rate_of(s) is None:
            continue
        for p, granule in s.packets[1:]:
            if granule >= 0 and p:
                out.append((granule - len(p), granule, p))
    return sorted(out)


def payload_of(text: bytes) -> bytes:
    """text with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def features(media: Media, blocks: list[tuple[int, int, bytes]], payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    n = len(x)
    total = int(x.sum(dtype=np.int64))
    square = int((x.astype(np.int64) ** 2).sum())
    cross = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    packets = sum(len(s.packets) for s in media.streams.values())
    rate = next((r for r in map(rate_of, media.streams.values()) if r), RATE)
    end_ms = blocks[-1][1] * 1000 // rate if blocks else 0
    return f"streams={len(media.streams)};pages={media.pages};damaged={media.damaged};packets={packets};end_ms={end_ms};mean_milli={total * 1000 // n};square_mean={square // n};peak={int(x.max())};crossings={cross}"


def measure(text: bytes) -> tuple:
    """What op3 tells of one text."""
    stored = write(payload_of(text))
    media = read(stored)
    blocks = timeline(media)
    back = b"".join(b for _, _, b in blocks)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media, blocks, back)


_FIELDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            rows = [measure((t or "").encode()) for t in part.column("text").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in _FIELDS]
            yield pa.record_batch([part.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, _FIELDS.values(), strict=True))], names=["doc_id", *_FIELDS])


def encode(df: DataFrame, column: str, out: str = "media") -> DataFrame:
    """df with the binary (or string) column stored as Ogg in column `out`; null stays null."""
    findable(df.sparkSession)

    @F.pandas_udf("binary")
    def apply(x):
        return x.map(lambda v: None if v is None else write(payload_of(bytes(v))))

    return df.withColumn(out, apply(F.col(column).cast("binary")))


def packets(df: DataFrame, column: str = "media") -> DataFrame:
    """df's other columns with one row per packet of its Ogg column: serial, packet, granule, time_ms, bytes, valid pages and damaged pages of the file.

    Pages and packets are those of any Ogg file.  Granule positions count samples
    here; time_ms needs the rate in the header packet of our own kind of stream,
    and is null for other streams and where the position is unknown.
    """
    findable(df.sparkSession)

    @F.pandas_udf("array<struct<serial: long, packet: int, granule: long, time_ms: long, bytes: binary, pages: int, damaged: int>>")
    def apply(x):
        def one(v):
            if v is None:
                return []
            m = read(bytes(v))
            rows = ((s, rate_of(s), k, p, g) for s in m.streams.values() for k, ((p, _), g) in enumerate(zip(s.packets, positions(s), strict=True)))
            return [{"serial": s.serial, "packet": k, "granule": g, "time_ms": None if g is None or not rate else g * 1000 // rate, "bytes": p, "pages": m.pages, "damaged": m.damaged} for s, rate, k, p, g in rows]

        return x.map(one)

    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.inline(apply(column)))


def op3_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow(rows, _measure, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
