"""Media columns in ISO base media files: writing lossless 8-bit samples, reading the tables of any such file.

``store`` puts bytes into a container of one uncompressed video track (``ftyp``, ``moov``, ``mdat``), a sample
of ``SAMPLE`` bytes a frame of 8 x 8 pixels of three 8-bit values.  ``probe`` walks the nested boxes of a container,
decodes its sample tables and gives codec, duration and the byte ranges of keyframes; payloads are never decoded.

Null text is empty; every payload is padded with spaces to a positive multiple of 192 bytes, so an
empty text is one sample.  Equal texts give equal values; repeated rows and a null doc_id are carried through; an
empty table gives no rows.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.textual import blocks, string_buffers

SAMPLE = 192
#: Samples a second, in a chunk, and from one keyframe to the next.
RATE, CHUNK, KEY_EVERY = 25, 64, 12
#: Boxes that hold boxes, and how many bytes of their own come before those.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"moof": 0, b"traf": 0}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def store(payload: bytes) -> bytes:
    """A container with ``payload``, a positive multiple of ``SAMPLE`` bytes, as its samples."""
    n, rest = divmod(len(payload), SAMPLE)
    if rest or not n:
        raise ValueError("the payload isn't whole samples")
    chunks = -(-n // CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    groups = [(1, CHUNK, 1)] if chunks > 1 else []
    if chunks == 1 or n % CHUNK:
        groups.append((chunks, n - CHUNK * (chunks - 1), 1))
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")

    def movie(base: int) -> bytes:
        table = box(
            b"stbl",
            full_box(b"stsd", 0, struct.pack(">I", 1), entry),
            full_box(b"stts", 0, struct.pack(">III", 1, n, 1)),
            full_box(b"stss", 0, struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", 0, struct.pack(">I", len(groups)), *(struct.pack(">III", *g) for g in groups)),
            full_box(b"stsz", 0, struct.pack(">II", SAMPLE, n)),
            full_box(b"co64", 0, struct.pack(">I", chunks), (np.arange(chunks, dtype=np.int64) * CHUNK * SAMPLE + base).astype(">u8").tobytes()),
        )
        information = box(b"minf", full_box(b"vmhd", 1, bytes(8)), box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1))), table)
        media = box(b"mdia", full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full_box(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"\0"), information)
        track = box(b"trak", full_box(b"tkhd", 3, struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), matrix, struct.pack(">II", 8 << 16, 8 << 16)), media)
        return box(b"moov", full_box(b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), track)

    kind = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    head = 8 if len(payload) + 8 < 1 << 32 else 16
    base = len(kind) + len(movie(0)) + head
    return b"".join((kind, movie(base), box(b"mdat", payload)))


def walk(data: bytes, low: int = 0, high: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box below a span as (path of kinds, where its body begins, where it ends)."""
    high = len(data) if high is None else high
    while low + 8 <= high:
        size, kind = struct.unpack_from(">I4s", data, low)
        body = low + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        end = high if size == 0 else low + size
        if end > high or end < body:
            raise ValueError(f"box {kind!r} at {low} runs to {end}, its parent to {high}")
        yield (*path, kind), body, end
        if kind in CONTAINERS:
            yield from walk(data, body + CONTAINERS[kind], end, (*path, kind))
        low = end


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    #: Of each sample, its place and size in the file, and whether decoding can begin there.
    offsets: np.ndarray
    sizes: np.ndarray
    key: np.ndarray


def _table(data: bytes, body: int, width: int, skip: int = 8) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, body + skip - 4)
    return np.frombuffer(data, dtype=f">u{width}", count=n, offset=body + skip).astype(np.int64)


def probe(data: bytes) -> list[Track]:
    """The tracks of a container, from its tables."""
    tracks: list[dict[bytes, int]] = []
    for path, body, _ in walk(data):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak"):
            tracks[-1][path[-1]] = body
    out = []
    for t in tracks:
        version = data[t[b"mdhd"]]
        timescale, duration = struct.unpack_from(">IQ" if version else ">II", data, t[b"mdhd"] + (20 if version else 12))
        fixed, n = struct.unpack_from(">II", data, t[b"stsz"] + 4)
        sizes = np.full(n, fixed, dtype=np.int64) if fixed else _table(data, t[b"stsz"], 4, 12)
        chunks = _table(data, t[b"co64"], 8) if b"co64" in t else _table(data, t[b"stco"], 4)
        (groups,) = struct.unpack_from(">I", data, t[b"stsc"] + 4)
        spread = np.frombuffer(data, dtype=">u4", count=3 * groups, offset=t[b"stsc"] + 8).reshape(-1, 3).astype(np.int64)
        in_chunk = np.repeat(spread[:, 1], np.diff(np.append(spread[:, 0], len(chunks) + 1)))
        first = np.cumsum(in_chunk) - in_chunk
        before = np.cumsum(sizes) - sizes
        offsets = np.repeat(chunks - before[first], in_chunk) + before
        key = np.ones(n, dtype=bool)
        if b"stss" in t:
            key[:] = False
            key[_table(data, t[b"stss"], 4) - 1] = True
        out.append(Track(data[t[b"stsd"] + 12 : t[b"stsd"] + 16].decode("latin-1"), timescale, duration, offsets, sizes, key))
    return out


def samples(data: bytes, track: Track) -> bytes:
    """The bytes of all samples in order; neighbours are read in one piece."""
    ends = track.offsets + track.sizes
    breaks = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    lows, highs = np.append(0, breaks), np.append(breaks, len(ends)) - 1
    return b"".join(data[track.offsets[a] : ends[b]] for a, b in zip(lows, highs, strict=True))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = string_buffers(batch.column("text"))
        raw = data.tobytes()
        for low, high in blocks(offsets):
            at = offsets[low : high + 1].tolist()
            made = [store(raw[a:b] + b" " * (-(b - a) % SAMPLE or SAMPLE * (a == b))) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(np.diff(at)), pa.array(made, type=pa.binary())], names=["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's padded bytes in a container."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n_bytes, value in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "media")), strict=True):
            data = value.as_py()
            track = probe(data)[0]
            payload = samples(data, track)
            lows = track.offsets[track.key]
            rows.append(
                {
                    "doc_id": doc_id.as_py(), "n_bytes": n_bytes.as_py(), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
                    "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "codec": track.codec, "duration_ms": track.duration * 1000 // track.timescale,
                    "keyframes": [{"offset": int(a), "bytes": int(b)} for a, b in zip(lows, track.sizes[track.key], strict=True)],
                }
            )
            if len(rows) == 512:
                yield pa.RecordBatch.from_pylist(rows, schema=_PROBED)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=_PROBED)


_PROBED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("duration_ms", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())])))])


def probe_column(media: DataFrame) -> DataFrame:
    """Reads ``doc_id, n_bytes, media``: hashes, codec, duration and keyframe byte ranges of each."""
    return media.mapInArrow(_probe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_ms long, keyframes array<struct<offset: long, bytes: long>>")
