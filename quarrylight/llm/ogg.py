"""Ogg media columns: texts stored as 8-bit samples in an Ogg file each, and read back.

A file has two logical streams. The first carries the samples: a header packet (rate, channels),
then packets of 576 samples, whose granule positions count samples. The second carries one
header packet with the number of bytes before padding. `read` trusts nothing: it verifies each
page's checksum and sequence number, puts packets together from the lacing values (also across
pages), deals the pages to their streams by serial number and derives times from the granules.

Results: null and empty texts are stored as one packet of padding; equal texts give equal files,
wherever they stand; a null doc_id stays null; an empty table gives an empty one; other columns
are not read. Texts are stored whole, in as many pages as they need.
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

from quarrylight.llm.blocks import frugal

RATE = 8000
PACKET = 576
PAD = 255
PAGE_PACKETS = 85  # 85 packets of 3 lacing values fill a page
CONTINUED, FIRST, LAST = 1, 2, 4
_PAGE = struct.Struct("<4sBBqIIIB")
_SOUND = struct.Struct("<8sII")
_NOTE = struct.Struct("<8sQ")
#: Fixed values of the format: the capture pattern, and the names of our two codecs.
CAPTURE, SOUND, NOTE = b"OggS", b"\x80pcm-u8\0", b"\x81length\0"

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class BadPage(ValueError):
    """A page that isn't whole, or whose checksum or place is wrong."""


def checksum(*parts: bytes) -> int:
    """Ogg's CRC-32: the common polynomial, but most significant bit first, from 0, not inverted at the end.

    With the bits of every byte mirrored this is the register that zlib keeps, mirrored.
    """
    register = 0xFFFFFFFF
    for part in parts:
        register = zlib.crc32(part.translate(_MIRROR), register)
    return int.from_bytes(int.to_bytes(register ^ 0xFFFFFFFF, 4, "little").translate(_MIRROR), "big")


def page(body: bytes, lacing: bytes, kind: int, granule: int, serial: int, number: int) -> bytes:
    head = _PAGE.pack(CAPTURE, 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head, body)) + head[26:] + body


def lace(size: int) -> bytes:
    """Lacing values of one packet: 255 as long as it goes on, then the rest (0 too)."""
    return b"\xff" * (size // 255) + bytes((size % 255,))


def pad(text: bytes) -> bytes:
    """The bytes with 255 appended up to a positive multiple of a packet."""
    return text + bytes((PAD,)) * (max(1, -(-len(text) // PACKET)) * PACKET - len(text))


def write(text: bytes) -> bytes:
    """An Ogg file of the text's samples and, in its second stream, of its length."""
    payload = pad(text)
    serial = zlib.crc32(payload)
    other = serial ^ 0xFFFFFFFF
    sound, note = _SOUND.pack(SOUND, RATE, 1), _NOTE.pack(NOTE, len(text))
    out = [
        page(sound, lace(len(sound)), FIRST, 0, serial, 0),
        page(note, lace(len(note)), FIRST | LAST, 0, other, 0),
    ]
    step = PAGE_PACKETS * PACKET
    full = lace(PACKET) * PAGE_PACKETS
    for number, at in enumerate(range(0, len(payload), step), 1):
        body = payload[at : at + step]
        last = at + step >= len(payload)
        out.append(page(body, full[: len(body) // PACKET * 3], LAST * last, at + len(body), serial, number))
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of each page on which a packet ends
    ends: list[int] = field(default_factory=list)  # packets that end up to there
    pages: int = 0
    open: bytes | None = None  # of a packet that goes on on the next page
    closed: bool = False

    def times(self, size: int = PACKET, rate: int = RATE) -> np.ndarray:
        """Seconds at which each sound packet ends, derived from the granule of its page backwards."""
        out, before = [], 1
        for granule, end in zip(self.granules[1:], self.ends[1:]):
            n = end - before
            out.append((granule - size * np.arange(n - 1, -1, -1)) / rate)
            before = end
        return np.concatenate(out) if out else np.zeros(0)


def read(file: bytes) -> dict[int, Stream]:
    """The logical streams of a file by serial number; raises BadPage for what isn't whole."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(file)
    while at < len(file):
        if len(file) - at < _PAGE.size:
            raise BadPage("a cut header")
        mark, version, kind, granule, serial, number, check, n = _PAGE.unpack_from(file, at)
        if mark != CAPTURE or version:
            raise BadPage("no page begins here")
        lacing = file[at + 27 : at + 27 + n]
        body_at = at + 27 + n
        size = int(np.frombuffer(lacing, np.uint8).sum(dtype=np.int64))
        end = body_at + size
        if len(lacing) < n or end > len(file):
            raise BadPage("a cut page")
        if checksum(file[at : at + 22], b"\0\0\0\0", file[at + 26 : end]) != check:
            raise BadPage("a wrong checksum")
        stream = streams.setdefault(serial, Stream(serial))
        if stream.closed or stream.pages != number or bool(kind & FIRST) != (number == 0) or bool(kind & CONTINUED) != (stream.open is not None):
            raise BadPage("a page out of place")
        values = np.frombuffer(lacing, np.uint8)
        ends = np.cumsum(values, dtype=np.int64)
        cuts = ends[values < 255]
        begin = body_at
        for cut in (cuts + body_at).tolist():
            packet = bytes(view[begin:cut])
            if stream.open is not None:
                packet, stream.open = stream.open + packet, None
            stream.packets.append(packet)
            begin = cut
        if n and values[-1] == 255:
            stream.open = (stream.open or b"") + bytes(view[begin:end])
        if len(cuts):
            stream.granules.append(granule)
            stream.ends.append(len(stream.packets))
        stream.pages += 1
        stream.closed = bool(kind & LAST)
        at = end
    if any(s.open is not None or not s.closed for s in streams.values()):
        raise BadPage("a stream without its end")
    return streams


def contents(file: bytes) -> tuple[bytes, int, dict[str, Stream]]:
    """The samples read back, the length before padding, and the streams by what they carry."""
    by = {s.packets[0][:8]: s for s in read(file).values()}
    sound, note = by[SOUND], by[NOTE]
    return b"".join(sound.packets[1:]), _NOTE.unpack(note.packets[0])[1], {"sound": sound, "note": note}


def feature(samples: np.ndarray, sound: Stream) -> str:
    """Packets, milliseconds, mean, effective value, crossings of the middle, most frequent sample and its count."""
    times = sound.times()
    counts = np.bincount(samples, minlength=256)
    n, level = len(samples), np.arange(256) - 128
    high = samples >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    total, power = int(counts @ level), int(counts @ level**2)
    top = int(counts.argmax())
    return f"packets={len(times)};ms={round(1000 * float(times[-1]))};mean={total / n:.4f};rms={(power / n) ** 0.5:.4f};crossings={crossings};top={top}x{int(counts[top])}"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text's Ogg file, for those who want the files themselves."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            files = [write((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, media binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """What is read back from each text's Ogg file: sizes, digests, features."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for text in part.column(1).to_pylist():
                    file = write((text or "").encode())
                    payload, n, streams = contents(file)
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(np.frombuffer(payload, np.uint8), streams["sound"])))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
