"""Media columns: Ogg.

A byte payload becomes 8-bit PCM samples in an Ogg stream beside a comment stream. Reading
verifies page checksums, reassembles packets from lacing values across pages, demultiplexes the
logical streams and derives timestamps from granule positions.
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
from pyspark.sql import functions as F

from filigraph.llm.shared import cut, text_or_empty

RATE = 8000
PACKET = 8192
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    """The bytes are not a whole and valid Ogg stream."""


def checksum(data: bytes) -> int:
    """The page checksum: CRC-32 of polynomial 0x04c11db7 over unreflected bits, zero at both ends.

    It equals the common reflected CRC-32 of the bit-reversed bytes, started and ended without inversion, and reversed again.
    """
    reflected = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def paginate(packets: list[tuple[bytes, int]], serial: int, first: int = 0, last: bool = True) -> list[tuple[int, bytes]]:
    """Pages (granule, bytes) of one logical stream. A page has up to 255 segments; packets run on over pages."""
    segments: list[tuple[bytes, int, bool]] = []  # data, granule after it, ends a packet
    for data, granule in packets:
        for at in range(0, len(data) + 1, 255):
            part = data[at : at + 255]
            segments.append((part, granule, len(part) < 255))
    pages, open_packet, number = [], False, first
    for at in range(0, len(segments), 255):
        part = segments[at : at + 255]
        granule = max((g for _, g, end in part if end), default=-1)
        kind = CONTINUED * open_packet | FIRST * (number == 0) | LAST * (last and at + 255 >= len(segments))
        pages.append((granule, page(kind, granule, serial, number, bytes(len(s) for s, _, _ in part), b"".join(s for s, _, _ in part))))
        open_packet, number = not part[-1][2], number + 1
    return pages


def encode(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg file of two logical streams: ``payload`` as unsigned 8-bit mono samples, and a comment with its length."""
    serial = zlib.crc32(payload)
    other = serial ^ 0xFFFFFFFF
    header = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, 1, packet, 0)
    note = b"LENGTH=" + str(len(payload)).encode()
    sound = [(payload[at : at + packet], min(at + packet, len(payload))) for at in range(0, len(payload), packet)]
    out = [p for _, p in paginate([(header, 0)], serial, last=not sound)] + [p for _, p in paginate([(b"NOTE\0", 0)], other, last=False)]
    pages = [p for _, p in paginate(sound, serial, first=1)] if sound else []
    notes = [p for _, p in paginate([(note, 0)], other, first=1)]
    return b"".join(out + pages[:1] + notes + pages[1:])


@dataclass
class Stream:
    """One logical stream: its packets and, for each, the granule position at its end (-1 inside a page)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: list[bytes] | None = None


def decode(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number. Raises :class:`OggError` at the first fault."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise OggError("a page is cut short")
        magic, version, kind, granule, serial, number, crc, count = _HEAD.unpack_from(data, at)
        body = at + _HEAD.size + count
        lacing = data[at + _HEAD.size : body]
        end = body + sum(lacing)
        if magic != b"OggS" or version or end > len(data):
            raise OggError(f"no whole page at byte {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"the page at byte {at} has another checksum")
        if bool(kind & FIRST) == (serial in streams):
            raise OggError(f"stream {serial} begins wrongly")
        stream = streams.setdefault(serial, Stream())
        if number != stream.pages or stream.ended or bool(kind & CONTINUED) != (stream.partial is not None):
            raise OggError(f"page {number} of stream {serial} doesn't follow")
        stream.pages, parts, ended = stream.pages + 1, stream.partial or [], 0
        inside = stream.partial is not None
        for size in lacing:
            parts.append(data[body : body + size])
            body, inside = body + size, True
            if size < 255:
                stream.packets.append(b"".join(parts))
                stream.granules.append(-1)
                parts, inside, ended = [], False, ended + 1
        if ended:
            stream.granules[-1] = granule
        stream.partial, stream.ended, at = parts if inside else None, bool(kind & LAST), end
    if any(not s.ended or s.partial is not None for s in streams.values()):
        raise OggError("a stream doesn't end")
    return streams


def packet_samples(stream: Stream) -> list[tuple[int, int]]:
    """First and last sample (exclusive) of each data packet of a PCM stream, from the granule positions of its pages.

    A page tells where its last finished packet ends; the packets before it on the page end as many samples earlier as the later ones have. Packets
    that leave a gap or overlap raise :class:`OggError`.
    """
    found: list[tuple[int, int]] = []
    end = None
    for packet, granule in zip(reversed(stream.packets[1:]), reversed(stream.granules[1:])):
        if granule >= 0 and end is not None and granule != end:
            raise OggError("the granule positions don't fit the packets")
        end = granule if granule >= 0 else end
        if end is None:
            raise OggError("the last packet has no granule position")
        found.append((end - len(packet), end))
        end -= len(packet)
    if found and found[-1][0] != 0:
        raise OggError("the first packet doesn't begin at zero")
    return found[::-1]


def sound_and_note(data: bytes) -> tuple[tuple[int, Stream], tuple[int, Stream], int]:
    """The PCM stream and the comment stream, each with its serial number, and the sampling rate."""
    streams = decode(data)
    sound = [(k, s) for k, s in streams.items() if s.packets and s.packets[0][:8] == b"PCM     "]
    notes = [(k, s) for k, s in streams.items() if s.packets and s.packets[0] == b"NOTE\0"]
    if len(sound) != 1 or len(notes) != 1:
        raise OggError("one PCM and one comment stream are expected")
    return sound[0], notes[0], struct.unpack_from(">I", sound[0][1].packets[0], 16)[0]


def read_media(data: bytes) -> tuple[bytes, dict]:
    """The samples of the PCM stream and what its pages say: rate, packets, pages, seconds, and when each packet begins and ends."""
    (_, sound), (_, note), rate = sound_and_note(data)
    samples = b"".join(sound.packets[1:])
    places = packet_samples(sound)
    seconds = places[-1][1] / rate if places else 0.0
    if note.packets[1] != b"LENGTH=" + str(len(samples)).encode() or (places[-1][1] if places else 0) != len(samples):
        raise OggError("the sample count differs")
    return samples, {"rate": rate, "packets": len(places), "pages": sound.pages + note.pages, "seconds": seconds, "times": [(a / rate, b / rate) for a, b in places]}


def describe(samples: bytes, info: dict) -> str:
    """Features of the signal: duration, when its last packet begins and how long packets are, mean, root mean square and zero crossings around the middle level."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    rms = float(np.sqrt(np.mean((x - 128.0) ** 2)))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    times = info["times"]
    longest = max(b - a for a, b in times)
    return f"rate={info['rate']};seconds={info['seconds']:.6f};packets={info['packets']};last_start={times[-1][0]:.6f};longest={longest:.6f};pages={info['pages']};mean={x.mean():.6f};rms={rms:.6f};peak={int(x.max())};crossings={crossings}"


def padded(text: str, unit: int = 64) -> tuple[int, bytes]:
    """The UTF-8 length of a text, and its bytes with zeros up to a positive multiple of ``unit``."""
    data = text.encode()
    return len(data), data.ljust(max(1, -(-len(data) // unit)) * unit, b"\0")


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as an Ogg file. A null or empty text gives 64 zero samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                made = [padded(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([encode(p) for _, p in made], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Digests and features of a ``doc_id, n_bytes, media`` table, from the bytes it holds. A fault in a file stops the job."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch, out = big.slice(at, 500), []
                for data in batch.column(2).to_pylist():
                    samples, info = read_media(data)
                    out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), describe(samples, info)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], [x.split()[0] for x in schema.split(", ")])

    return media.mapInArrow(run, schema)


def packets(media: DataFrame) -> DataFrame:
    """``doc_id, serial, stream, packet, start_s, end_s, n_bytes``: every data packet of both logical streams of a ``doc_id, media`` table, with its time in seconds.

    Packets of the comment stream have the time of its granule position, which is zero. A null ``media`` gives no rows.
    """
    schema = "doc_id long, serial long, stream string, packet int, start_s double, end_s double, n_bytes long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                doc_id, data = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                if data is None:
                    continue
                (serial, sound), (other, note), rate = sound_and_note(data)
                rows = [(doc_id, serial, "pcm", i, a / rate, b / rate, b - a) for i, (a, b) in enumerate(packet_samples(sound))]
                rows += [(doc_id, other, "comment", i, g / rate, g / rate, len(p)) for i, (p, g) in enumerate(zip(note.packets[1:], note.granules[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in schema.split(", ")])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, schema)


def ogg_features(docs: DataFrame) -> DataFrame:
    """Stores every text as Ogg in the shared folder, reads the stored bytes back and describes them.

    One row per input row; ids may be null or repeat, and equal texts give equal values.
    """
    return features(cut(encode_column(docs), "media", compression="zstd"))
