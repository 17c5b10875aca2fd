"""Ogg containers as columns: mux payloads into logical streams, and read them back with every check.

A payload is cut into packets; packet i goes to logical stream i mod ``STREAMS``. Pages hold segments with lacing
values, a granule position (samples ended so far in the stream, one byte a sample) and the container's CRC-32. The
reader verifies each page's checksum and sequence number, demultiplexes by serial number, reassembles packets from
lacing values across pages, and derives each packet's timestamp from granule positions.
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

from .util import slices, table

STREAMS, PACKET, RATE = 2, 1500, 8000
#: Fixed values of the container format: capture pattern, header layout, header flags, and the granule of a page on which no packet ends.
CAPTURE, _HEAD = b"OggS", struct.Struct("<4sBBqIII")
CONTINUED, FIRST, LAST, NO_GRANULE = 1, 2, 4, -1
_IDENT = struct.Struct("<8sIIIQ")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: Segments of a page at most.
SEGMENTS = 255


def page_crc(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, not reflected, from 0: zlib's reflected CRC over bytes with reversed bits, its result reversed."""
    state = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(state.to_bytes(4, "little").translate(_REVERSED), "big")


def _pages(serial: int, packets: list[bytes], granules: list[int], segments: int = SEGMENTS) -> list[tuple[int, bytes]]:
    """(granule in force when the page begins, page) of one logical stream."""
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, at, flags, room = bytearray(), [], NO_GRANULE, 0, FIRST, segments

    def flush(more: int, last: bool) -> None:
        nonlocal lacing, body, granule, flags
        head = _HEAD.pack(CAPTURE, 0, flags | (LAST if last else 0), granule, serial, len(out), 0) + bytes([len(lacing)]) + bytes(lacing)
        page = head + b"".join(body)
        out.append((at, page[:22] + struct.pack("<I", page_crc(page)) + page[26:]))
        lacing, body, granule, flags = bytearray(), [], NO_GRANULE, more

    for i, (packet, end) in enumerate(zip(packets, granules, strict=True)):
        lo, values = 0, bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        while values:
            take = values[: room - len(lacing)]
            size = sum(take)
            lacing += take
            body.append(packet[lo : lo + size])
            lo, values = lo + size, values[len(take) :]
            if not values:
                granule = end
            if len(lacing) == room and (values or i < len(packets) - 1):
                flush(CONTINUED if values else 0, False)
        at = end
        if i == 0 and len(packets) > 1 and lacing:
            flush(0, False)  # an identification header has a page of its own
    flush(0, True)
    return out


def mux(payload: bytes, packet: int = PACKET, streams: int = STREAMS, rate: int = RATE) -> bytes:
    """An Ogg file of a payload. Equal payloads give equal files: serial numbers derive from the payload's CRC."""
    base, pages = zlib.crc32(payload), []
    for s in range(streams):
        parts = [payload[i : i + packet] for i in range(s * packet, len(payload), streams * packet)]
        ends = np.cumsum([0, *map(len, parts)]).tolist()
        ident = _IDENT.pack(b"\x01u8pcm__"[:8], s, streams, rate, len(payload))
        own = _pages((base + s) & 0xFFFFFFFF, [ident, *parts], ends)
        pages += [(k > 0, start, s, k, page) for k, (start, page) in enumerate(own)]
    return b"".join(p[-1] for p in sorted(pages, key=lambda p: p[:4]))


def demux(media: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Packets of each logical stream by serial number, with the granule position of the page on which they end (None where others end after them there)."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        capture, version, flags, granule, serial, number, crc = _HEAD.unpack_from(media, at)
        n = media[at + 26]
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if capture != CAPTURE or version or end > len(media) or len(lacing) < n:
            raise ValueError(f"no whole page at byte {at}")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"page {number} of stream {serial}: wrong checksum")
        s = streams.setdefault(serial, {"packets": [], "open": None, "next": 0, "over": False})
        if number != s["next"] or bool(flags & FIRST) != (number == 0) or s["over"] or bool(flags & CONTINUED) != (s["open"] is not None):
            raise ValueError(f"page {number} of stream {serial}: out of place")
        s["next"], s["over"] = number + 1, bool(flags & LAST)
        body, parts, ended = at + 27 + n, s["open"] or [], None
        lo = body
        for v in lacing:
            body += v
            if v < 255:
                parts.append(media[lo:body])
                s["packets"].append((b"".join(parts), None))
                ended, parts, lo = len(s["packets"]) - 1, [], body
        if lo < body or (n and lacing[-1] == 255):
            parts.append(media[lo:body])
        s["open"] = parts or None
        if ended is not None:
            s["packets"][ended] = (s["packets"][ended][0], granule)
        at = end
    if any(s["open"] is not None or not s["over"] for s in streams.values()):
        raise ValueError("a stream does not end")
    return {k: s["packets"] for k, s in streams.items()}


def decode(media: bytes) -> tuple[bytes, list[tuple[int, float, int]]]:
    """The payload, and (stream, time of a packet's end in seconds, size) of each packet, in the payload's order.

    A packet that isn't the last to end on its page gets its time by counting back from the page's granule position.
    """
    by_stream: dict[int, list[tuple[bytes, float]]] = {}
    total = 0
    for packets in demux(media).values():
        _, s, streams, rate, total = _IDENT.unpack(packets[0][0])
        times, after = [], None
        for data, granule in reversed(packets[1:]):
            after = granule if granule is not None else after
            times.append((data, after / rate))
            after -= len(data)
        if after not in (None, 0):
            raise ValueError(f"stream {s}: granule positions don't match its samples")
        by_stream[s] = times[::-1]
    out, marks = [], []
    for i in range(max((len(x) for x in by_stream.values()), default=0)):
        for s in sorted(by_stream):
            if i < len(by_stream[s]):
                data, time = by_stream[s][i]
                out.append(data), marks.append((s, time, len(data)))
    payload = b"".join(out)
    if len(payload) != total:
        raise ValueError("the payload isn't whole")
    return payload, marks


def features(payload: bytes, marks: list[tuple[int, float, int]]) -> str:
    """Packets, duration in seconds, mean level, mean step and zero crossings around the middle of 8-bit samples."""
    x = np.frombuffer(payload, np.uint8)
    step = np.abs(np.diff(x.astype(np.int16)))
    crossings = np.count_nonzero(np.diff(x >= 128))
    return f"packets={len(marks)};seconds={max(t for _, t, _ in marks):.4f};mean={x.mean():.3f};step={step.mean():.3f};crossings={crossings}"


def pad(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and the text in UTF-8 with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column of documents: ``doc_id, n_bytes, media`` (an Ogg file). Null and empty texts hold 64 bytes 0; other columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            padded = [pad(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in padded], pa.int64()), pa.array([mux(p) for _, p in padded], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read a media column back: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` and, if asked for, ``payload`` and ``packets`` (stream, seconds, size).

    A null file gives nulls; a damaged one raises an error that names the page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            rows = []
            for d, n, m in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                if m is None:
                    rows.append({"doc_id": d, "n_bytes": n})
                    continue
                payload, marks = decode(m)
                row = {"doc_id": d, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": features(payload, marks)}
                rows.append(row | ({"payload": payload, "packets": [{"stream": s, "seconds": t, "size": z} for s, t, z in marks]} if with_payload else {}))
            yield pa.RecordBatch.from_pylist(rows, kinds)

    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if with_payload:
        kinds = kinds.append(pa.field("payload", pa.binary())).append(pa.field("packets", pa.list_(pa.struct([("stream", pa.int32()), ("seconds", pa.float64()), ("size", pa.int64())]))))
        schema += ", payload binary, packets array<struct<stream: int, seconds: double, size: long>>"
    return media.mapInArrow(run, schema)


def op5_ogg_media(spark, sf_dir: str) -> DataFrame:
    return read_media(to_media(table(spark, sf_dir, "documents")))
