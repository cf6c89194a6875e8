"""Media columns: payloads as PNG images in binary columns, and hashes of their low frequencies.

A payload (a whole number of 64-byte rows) becomes an 8-bit greyscale PNG 64 samples wide: signature, IHDR, one zlib
stream in IDAT chunks, IEND, each chunk with its checksum. Reading back tests every checksum and the stream's, inflates,
undoes the row filters in numpy and returns the very bytes. The hash takes the signs of the lowest frequencies of the
image's cosine transform against their median, 64 bits in a binary column; alike images differ in few bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import arrow_column, bounded

WIDTH = 64
#: zlib level, bytes of an IDAT chunk, most rows of an image's filter choice worked on at a time.
LEVEL, CHUNK, ROWS = 3, 1 << 20, 1 << 14
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the image that the cosine transform sees, and of its low-frequency corner.
SIDE, LOW = 32, 8


def padded(text: str | bytes | None, multiple: int = WIDTH) -> bytes:
    """UTF-8 of a text with zeros up to a positive multiple; null is empty."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data + bytes((-len(data)) % multiple or (0 if data else multiple))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(image: np.ndarray) -> Iterator[bytes]:
    """Rows with the filter of least absolute sum in front: none, left or above (PNG types 0, 1 and 2)."""
    for i in range(0, len(image), ROWS):
        x = image[i : i + ROWS]
        left, above = x.copy(), x.copy()
        left[:, 1:] -= x[:, :-1]
        above[1:] -= x[:-1]
        if i:
            above[0] -= image[i - 1]
        tried = np.stack((x, left, above))
        cost = np.minimum(tried, np.uint8(0) - tried).sum(2, dtype=np.int64)
        best = cost.argmin(0)
        out = np.empty((len(x), x.shape[1] + 1), np.uint8)
        out[:, 0] = best
        out[:, 1:] = tried[best, np.arange(len(x))]
        yield out.tobytes()


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """An 8-bit greyscale PNG of a payload that is a positive multiple of the width long."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    packer = zlib.compressobj(level)
    stream = b"".join([*(packer.compress(x) for x in _filtered(image)), packer.flush()])
    parts = [_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", stream[i : i + CHUNK]) for i in range(0, len(stream), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _unfilter(kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Undoes PNG filters 0 to 4 on rows of one-byte pixels."""
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    left = kinds == 1
    x[left] = np.cumsum(x[left], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1], [True])))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if kinds[i] == 2:
            if i:
                x[i] += x[i - 1]
            x[i:j] = np.cumsum(x[i:j], axis=0, dtype=np.uint8)
        elif kinds[i] > 2:
            for r in range(i, j):
                up = x[r - 1].astype(int).tolist() if r else [0] * x.shape[1]
                row, a, c = x[r].tolist(), 0, 0
                for k, b in enumerate(up):
                    if kinds[i] == 3:
                        guess = (a + b) // 2
                    else:
                        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                    row[k] = a = (row[k] + guess) & 255
                    c = b
                x[r] = row
    return x


def decode_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlace; ValueError where a checksum or length is wrong."""
    if png[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, kinds, data, head = 8, [], [], None
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a PNG chunk is cut off")
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"wrong checksum in PNG chunk {kind!r}")
        kinds.append(kind)
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or kinds[0] != b"IHDR" or kinds[-1] != b"IEND" or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG")
    width, height = head[:2]
    unpacker = zlib.decompressobj()
    rows = np.frombuffer(unpacker.decompress(b"".join(data)) + unpacker.flush(), np.uint8)
    if not unpacker.eof or len(rows) != height * (width + 1):
        raise ValueError("the PNG's stream has another length than its header says")
    rows = rows.reshape(height, width + 1)
    return _unfilter(rows[:, 0], rows[:, 1:].copy())


def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE)) * np.where(k == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))


def _resized(image: np.ndarray) -> np.ndarray:
    """Means over SIDE x SIDE areas; an image of fewer rows or columns is repeated to fill them."""
    out = image
    for axis in (0, 1):
        n = out.shape[axis]
        if n < SIDE:
            out = np.repeat(out, -(-SIDE // n), axis)
            n = out.shape[axis]
        edges = np.arange(SIDE) * n // SIDE
        sums = np.add.reduceat(out, edges, axis=axis, dtype=np.int64 if out.dtype == np.uint8 else np.float64)
        out = sums / np.diff(np.concatenate((edges, [n]))).reshape((-1, 1) if axis == 0 else (1, -1))
    return out


def low_frequency_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the LOW x LOW lowest frequencies (the constant one left out of the median) exceed the median."""
    basis = _cosines()
    low = np.round((basis @ _resized(image) @ basis.T).ravel(), 6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def with_media(df: DataFrame, text: Column, name: str = "media") -> DataFrame:
    """df with the PNG of a text's payload in the binary column `name` (replacing one of that name). Null is an empty
    text, whose payload is one row of zeros."""

    def encode(texts: pa.Array) -> pa.Array:
        return pa.array((encode_png(padded(x.as_py())) for x in texts), pa.binary())

    bounded(df.sparkSession)
    return df.withColumn(name, arrow_column(encode, "binary")(text.cast("string")))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, low_hash binary"


def features(media: Column) -> Column:
    """struct of what a stored image gives, all read back from its bytes: the payload's length, SHA-256 and the unsigned
    CRC-32 of its last 64 bytes, the image's length and SHA-256, and the low-frequency hash. Null gives null fields; a
    damaged image fails the query."""

    def of(png: bytes | None) -> dict | None:
        if png is None:
            return None
        image = decode_png(png)
        payload = image.tobytes()
        return {
            "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-64:]),
            "media_bytes": len(png),
            "media_sha256": hashlib.sha256(png).hexdigest(),
            "low_hash": low_frequency_hash(image),
        }

    kind = pa.struct(
        [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64())]
        + [("media_sha256", pa.string()), ("low_hash", pa.binary())]
    )

    return arrow_column(lambda images: pa.array([of(x.as_py()) for x in images], kind), FEATURES)(media)
