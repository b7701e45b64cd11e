"""Media columns: Ogg containers written to and read from binary columns.

The writer packs a payload into the audio stream of a container with two logical streams; the reader verifies
every page's checksum, reassembles packets from lacing values, demultiplexes the streams by serial number and
turns granule positions into timestamps. Both run on Arrow batches inside tasks, a record at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

# Fixed values of the container format (RFC 3533).
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
PAGE = struct.Struct("<4sBBqIIIB")

#: One sample is one byte; a payload is a whole number of frames of so many samples.
FRAME = 192
RATE = 8000
PACKET = 10 * FRAME
SERIAL_AUDIO, SERIAL_INDEX = 1, 2
_HEAD = struct.Struct("<8sIIQ")
_MAGIC = b"pcm8raw\x00"
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """Damaged or malformed container."""


def page_crc(page: bytes) -> int:
    """CRC-32 of polynomial 04C11DB7, most significant bit first, from 0, no final inversion.

    zlib computes the mirrored form, so the bytes are mirrored first and its result after.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


class _Stream:
    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0

    def page(self, lacing: bytes, body: bytes, granule: int, flags: int) -> bytes:
        head = PAGE.pack(CAPTURE, 0, flags, granule, self.serial, self.sequence, 0, len(lacing)) + lacing
        self.sequence += 1
        page = bytearray(head + body)
        page[22:26] = page_crc(bytes(page)).to_bytes(4, "little")
        return bytes(page)

    def pages(self, packets: list[bytes], granules: list[int], most: int, last: bool) -> Iterator[bytes]:
        """Pages of at most ``most`` lacing values; a packet may go on in the next page."""
        lacing, body, granule, flags, n = bytearray(), bytearray(), -1, 0, len(packets)
        for k, (packet, position) in enumerate(zip(packets, granules)):
            at = 0
            while True:
                piece = min(255, len(packet) - at)
                lacing.append(piece)
                body += packet[at : at + piece]
                at += piece
                ended = piece < 255
                if ended:
                    granule = position
                if len(lacing) == most or (ended and k == n - 1):
                    final = LAST if last and ended and k == n - 1 else 0
                    yield self.page(bytes(lacing), bytes(body), granule, flags | final)
                    lacing, body, granule, flags = bytearray(), bytearray(), -1, 0 if ended else CONTINUED
                if ended:
                    break


def encode(payload: bytes, n_bytes: int, packet: int = PACKET, segments: int = 60) -> bytes:
    """An Ogg file of ``payload`` as 8-bit mono samples, with an index stream that lists its packets' ends."""
    audio, index = _Stream(SERIAL_AUDIO), _Stream(SERIAL_INDEX)
    packets = [payload[k : k + packet] for k in range(0, len(payload), packet)]
    ends = np.minimum(np.arange(1, len(packets) + 1) * packet, len(payload)).tolist()
    head = _HEAD.pack(_MAGIC, RATE, FRAME, n_bytes)
    out = [audio.page(bytes([len(head)]), head, 0, FIRST), index.page(bytes([8]), b"pcmindex", 0, FIRST)]
    pages = list(audio.pages(packets, ends, segments, True))
    listed = np.asarray(ends, "<i8").tobytes()
    notes = list(index.pages([listed], [len(payload)], 255, True))
    for k, page in enumerate(pages):  # interleaved, so that reading has to demultiplex
        out.append(page)
        if k < len(notes):
            out.append(notes[k])
    return b"".join(out + notes[len(pages) :])


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, list[int], bytes]]:
    """(serial, sequence, flags, granule, lacing, body) of each page, its checksum verified."""
    at = 0
    while at < len(media):
        if len(media) - at < PAGE.size:
            raise OggError("truncated page header")
        capture, version, flags, granule, serial, sequence, crc, n = PAGE.unpack_from(media, at)
        if capture != CAPTURE or version != 0:
            raise OggError("lost page synchronisation")
        lacing = media[at + PAGE.size : at + PAGE.size + n]
        body = at + PAGE.size + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError("truncated page")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"checksum of page {sequence} of stream {serial} differs")
        yield serial, sequence, flags, granule, lacing, media[body:end]
        at = end


def demultiplex(media: bytes) -> dict[int, dict]:
    """Per serial number: packets, the granule position that each packet's page ends with (-1: none yet), pages."""
    streams: dict[int, dict] = {}
    for serial, sequence, flags, granule, lacing, body in read_pages(media):
        if flags & FIRST:
            if serial in streams:
                raise OggError("stream begins twice")
            streams[serial] = {"packets": [], "granules": [], "pages": 0, "open": bytearray(), "going": False, "ended": False}
        s = streams.get(serial)
        if s is None or s["ended"] or sequence != s["pages"] or bool(flags & CONTINUED) != s["going"]:
            raise OggError(f"page {sequence} of stream {serial} is out of order")
        s["pages"] += 1
        at, done = 0, len(s["packets"])
        for value in lacing:
            s["open"] += body[at : at + value]
            at += value
            s["going"] = value == 255
            if not s["going"]:
                s["packets"].append(bytes(s["open"]))
                s["granules"].append(-1)
                s["open"] = bytearray()
        if len(s["packets"]) > done:
            s["granules"][-1] = granule
        s["ended"] = bool(flags & LAST)
    if any(s["going"] or not s["ended"] for s in streams.values()):
        raise OggError("stream without an end")
    return streams


def timestamps(granules: list[int], sizes: list[int], rate: int) -> list[float]:
    """Seconds at the end of each packet: from its page's granule position, or counted back from the next known one."""
    out, known = [0.0] * len(granules), 0
    for k in range(len(granules) - 1, -1, -1):
        known = granules[k] if granules[k] >= 0 else known - sizes[k + 1] if k + 1 < len(granules) else 0
        out[k] = known / rate
    return out


def decode(media: bytes) -> tuple[bytes, int, dict]:
    """Payload, its unpadded bytes, and features of the container and its samples."""
    streams = demultiplex(media)
    heads = {s["packets"][0][:8]: s for s in streams.values() if s["packets"]}
    audio, index = heads.get(_MAGIC), heads.get(b"pcmindex")
    if audio is None or index is None:
        raise OggError("no audio or no index stream")
    _, rate, frame, n_bytes = _HEAD.unpack(audio["packets"][0])
    packets = audio["packets"][1:]
    payload = b"".join(packets)
    times = timestamps(audio["granules"][1:], [len(p) for p in packets], rate)
    ends = np.frombuffer(index["packets"][1], "<i8")
    if ends.tolist() != [round(t * rate) for t in times]:
        raise OggError("timestamps differ from the index stream")
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return payload, n_bytes, {
        "streams": len(streams), "pages": sum(s["pages"] for s in streams.values()), "packets": len(packets), "frames": len(payload) // frame,
        "end_ms": round(times[-1] * 1000), "mean": f"{samples.sum() / len(samples):.6f}", "rms": f"{float(np.sqrt((samples * samples).sum() / len(samples))):.6f}",
        "crossings": int(np.count_nonzero(np.signbit(samples[1:]) != np.signbit(samples[:-1]))),
    }


def pad(text: bytes) -> bytes:
    """Blanks appended up to a positive multiple of FRAME."""
    return text + b" " * (-len(text) % FRAME if text else FRAME)


_MEDIA = pa.schema([("doc_id", pa.int64()), ("media", pa.large_binary())])


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``media``, the Ogg file of each whole text; a null text counts as empty, repeated rows are kept."""

    def run(batches):
        for batch in pieces(batches, 16 << 20):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encode(pad(x), len(x)) for x in texts], pa.large_binary())], schema=_MEDIA)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of the payload in each row's ``media``; a null one gives nulls, a damaged one fails the job."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                if not x.is_valid:
                    out.append({"doc_id": doc})
                    continue
                raw = x.as_py()
                payload, n_bytes, feature = decode(raw)
                out.append({
                    "doc_id": doc, "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
                    "media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest(), "feature": ";".join(f"{k}={v}" for k, v in feature.items()),
                })
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in FIELDS.split(", "))]))

    return media.select("doc_id", "media").mapInArrow(run, FIELDS)


FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
