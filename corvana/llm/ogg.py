"""Media columns in Ogg: pages, packets, logical streams and times.

Writing makes a file of two logical streams: the samples as raw 8-bit PCM packets
and a comment stream; reading checks each page's checksum and sequence number,
joins packets over lacing values and pages, demultiplexes streams by serial number
and turns granule positions into seconds.

A page is `OggS`, version 0, flags (1: continues a packet, 2: first page of a
stream, 4: last), granule position, serial and sequence numbers, checksum, and the
lacing table. The checksum is the crc32 with polynomial 04c11db7 from 0, neither
reflected nor inverted; zlib's reflected one over bit-reversed bytes gives its bits
in reverse.

Defined cases: a null text is an empty one; the payload is padded with bytes 255
up to a positive multiple of FRAME_BYTES, so that an empty text gives one frame.
Equal texts give equal bytes. A damaged page, a gap in the sequence numbers, a
packet that never ends or bytes between pages raise ValueError with the offset.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvana.llm.common import lean

PAGE = struct.Struct("<4sBBqIII")
CONTINUED, FIRST, LAST = 1, 2, 4
FRAME_BYTES = 576
#: Sample bytes of a packet at most, and the frames a second that granule positions count.
PACKET_BYTES, RATE = 32 * FRAME_BYTES, 8000
#: Lacing values of a page at most.
LACING = 255
PCM_MAGIC, COMMENT_MAGIC = b"PCM     ", b"comment\0"
PCM_HEAD = struct.Struct(">8sHHIIBBHI")

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """Ogg's crc32 of a page whose checksum field is zero."""
    crc = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def page(packets: bytes, lacing: bytes, flags: int, granule: int, serial: int, sequence: int) -> bytes:
    head = PAGE.pack(b"OggS", 0, flags, granule, serial, sequence, 0)
    tail = bytes([len(lacing)]) + lacing + packets
    crc = checksum(head + tail)
    return head[:22] + struct.pack("<I", crc) + tail


def lace(size: int) -> bytes:
    """The lacing values of a packet: as many 255 as fit, then the rest, which may be 0."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def paginate(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """The pages of one logical stream of (packet, granule position at its end); the first packet stands alone."""
    values = b"".join(lace(len(p)) for p, _ in packets)
    data = b"".join(p for p, _ in packets)
    ends = np.cumsum([len(p) // 255 + 1 for p, _ in packets])
    cuts = [*range(0, int(ends[0]), LACING), *range(int(ends[0]), len(values), LACING)]
    cuts = sorted({c for c in cuts if c < len(values)}) + [len(values)]
    out, at = [], 0
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = values[a:b]
        size = sum(part)
        done = int(np.searchsorted(ends, b, side="right"))
        complete = done > int(np.searchsorted(ends, a, side="right"))
        flags = (CONTINUED if a and values[a - 1] == 255 else 0) | (FIRST if k == 0 else 0) | (LAST if b == len(values) else 0)
        out.append(page(data[at : at + size], part, flags, packets[done - 1][1] if complete else -1, serial, k))
        at += size
    return out


@dataclass
class Stream:
    """A logical stream: its packets, and the granule positions of its pages."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[tuple[int, int]] = field(default_factory=list)  # packets ended so far, position
    pages: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """offset, flags, granule position, serial number, lacing and body of every page, checked."""
    at = 0
    while at < len(data):
        if len(data) - at < 27 or data[at : at + 4] != b"OggS":
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc = PAGE.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + data[at + 26]]
        end = at + 27 + len(lacing) + sum(lacing)
        if version or end > len(data) or len(lacing) != data[at + 26]:
            raise ValueError(f"a page is cut or unknown at byte {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"a page's checksum is wrong at byte {at}")
        yield at, flags, granule, (serial << 32) | sequence, lacing, data[end - sum(lacing) : end]
        at = end


def demultiplex(data: bytes) -> dict[int, Stream]:
    """serial number -> logical stream, its packets whole."""
    streams: dict[int, Stream] = {}
    for at, flags, granule, number, lacing, body in read_pages(data):
        serial, sequence = number >> 32, number & 0xFFFFFFFF
        if bool(flags & FIRST) == (serial in streams):
            raise ValueError(f"a stream begins twice or not at all at byte {at}")
        s = streams.setdefault(serial, Stream(serial))
        if s.ended or sequence != s.pages or bool(flags & CONTINUED) != bool(s.open):
            raise ValueError(f"a page is missing before byte {at}")
        s.pages += 1
        begin = end = 0
        for value in lacing:
            end += value
            if value < 255:
                s.open.append(body[begin:end])
                s.packets.append(b"".join(s.open))
                s.open, begin = [], end
        if begin < end:
            s.open.append(body[begin:end])
        if granule >= 0:
            s.granules.append((len(s.packets), granule))
        s.ended = bool(flags & LAST)
    for s in streams.values():
        if s.open or not s.ended:
            raise ValueError(f"stream {s.serial} does not end")
    return streams


def store(text: str | None) -> tuple[bytes, int, int]:
    """The file of a text, the bytes of the text, and those of the padded payload."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw.ljust(max(1, -(-len(raw) // FRAME_BYTES)) * FRAME_BYTES, b"\xff")
    serial = zlib.crc32(payload)
    head = PCM_HEAD.pack(PCM_MAGIC, 0, 0, 1, RATE, 8, 1, FRAME_BYTES, 1)
    packets, at = [(head, 0)], 0
    while at < len(payload):
        part = payload[at : at + PACKET_BYTES]
        at += len(part)
        packets.append((part, at))
    comment = COMMENT_MAGIC + struct.pack("<Q", len(raw))
    samples, notes = paginate(packets, serial), paginate([(comment, 0)], serial ^ 0xFFFFFFFF)
    # First pages of all streams come before any other page.
    return b"".join([samples[0], *notes, *samples[1:]]), len(raw), len(payload)


@dataclass
class Clip:
    payload: bytes
    text_bytes: int
    pages: int
    packets: int
    seconds: float
    times: list[float]


def load(data: bytes) -> Clip:
    """The samples of a stored file, with the times at which its pages end."""
    streams = demultiplex(data)
    samples = next((s for s in streams.values() if s.packets and s.packets[0].startswith(PCM_MAGIC)), None)
    notes = next((s for s in streams.values() if s.packets and s.packets[0].startswith(COMMENT_MAGIC)), None)
    if samples is None or notes is None:
        raise ValueError("the streams of samples and comments are not both there")
    _, _, _, kind, rate, _, _, _, _ = PCM_HEAD.unpack_from(samples.packets[0])
    if kind != 1 or not rate:
        raise ValueError("the samples are not 8-bit")
    payload = b"".join(samples.packets[1:])
    times = [g / rate for _, g in samples.granules if g]
    sizes = np.cumsum([0, *map(len, samples.packets[1:])])
    if any(int(sizes[n - 1]) != g for n, g in samples.granules if n):
        raise ValueError("a granule position does not match the samples")
    return Clip(payload, struct.unpack_from("<Q", notes.packets[0], len(COMMENT_MAGIC))[0], samples.pages + notes.pages, len(samples.packets) + len(notes.packets), times[-1] if times else 0.0, times)


def feature(clip: Clip) -> str:
    """Duration, pages, packets, mean level and roughness of the samples."""
    levels = np.frombuffer(clip.payload, dtype=np.uint8)
    rough = int(np.abs(np.diff(levels.astype(np.int16))).sum(dtype=np.int64)) // max(1, len(levels) - 1)
    return f"s={clip.seconds:.3f};pages={clip.pages};packets={clip.packets};mean={int(levels.sum(dtype=np.int64)) // len(levels)};rough={rough}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and media: the Ogg file that stores the text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([store(t)[0] for t in batch.column(1).to_pylist()], pa.binary())], [id_col, "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind}, media binary")


def probe(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored bytes hold: sizes, digests, times and a feature string; the payload itself stays behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                clip = load(data)
                rows.append((clip.text_bytes, len(clip.payload), hashlib.sha256(clip.payload).hexdigest(), zlib.crc32(clip.payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(clip), clip.times))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], [id_col, *PROBED])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "media").mapInArrow(lean(run), f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, page_times array<double>")


PROBED = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "page_times"]
