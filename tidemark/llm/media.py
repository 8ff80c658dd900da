"""Media columns: PNG files in binary columns, read back with checks, and a low-frequency cosine-transform hash.

encode() writes 8-bit samples as PNG (signature, IHDR, one IDAT of zlib data, IEND, each chunk with its CRC). decode()
reads any non-interlaced 8-bit PNG: it tests every chunk's CRC and zlib's own checksum, and undoes the five row filters
with numpy. phash() shrinks the samples to a square by area means, takes the two-dimensional cosine transform and
compares its lowest frequencies with their median.

Cases: an empty payload is not an image (op callers pad first); damaged files raise ValueError; every text gives one row;
null text counts as empty; equal texts give equal values; a null doc_id stays null; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, clean_text, record_batch, text_slices

WIDTH = 64
SIDE, LOW = 32, 8
# Fixed values of the PNG format: signature, samples per pixel by colour type, filter numbers.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: np.ndarray, level: int = 1, row_filter: int | None = None) -> bytes:
    """A PNG of (height, width) or (height, width, channels) 8-bit samples.

    Rows use filter NONE, SUB or UP: the given one, or that of them which makes the smallest file.
    """
    if row_filter is None:
        return min((encode(samples, level, k) for k in (NONE, SUB, UP)), key=len)
    height, width = samples.shape[:2]
    channels = samples.shape[2] if samples.ndim == 3 else 1
    colour = next(k for k, v in CHANNELS.items() if v == channels)
    rows = np.ascontiguousarray(samples).reshape(height, width * channels)
    filtered = np.empty((height, width * channels + 1), dtype=np.uint8)
    filtered[:, 0], body = row_filter, filtered[:, 1:]
    body[:] = rows
    if row_filter == UP:
        body[1:] -= rows[:-1]
    elif row_filter == SUB:
        body[:, channels:] -= rows[:, :-channels]
    elif row_filter != NONE:
        raise ValueError("unsupported filter for writing")
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, content) of each chunk, after testing its checksum."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("chunk cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        content = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + content):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        yield kind, content
        at += 12 + size
        if kind == b"IEND":
            return
    raise ValueError("no IEND chunk")


def _unfiltered_row(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of samples from its AVERAGE or PAETH differences; these need the sample to the left first."""
    out = row.astype(np.int64)
    up = above.astype(np.int64)
    for x in range(len(out)):
        left = int(out[x - step]) if x >= step else 0
        if kind == AVERAGE:
            guess = (left + int(up[x])) // 2
        else:
            corner = int(up[x - step]) if x >= step else 0
            base = left + int(up[x]) - corner
            guess = min((left, int(up[x]), corner), key=lambda v: abs(base - v))
        out[x] = (int(out[x]) + guess) & 255
    return out.astype(np.uint8)


def unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Samples of (height, 1 + row bytes) filtered rows. Runs of equal NONE, SUB or UP filters are undone at once."""
    kinds, body = raw[:, 0], raw[:, 1:]
    out = np.empty_like(body)
    first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])).tolist()
    above = np.zeros(body.shape[1], dtype=np.uint8)
    for a, b in zip(first, [*first[1:], len(kinds)], strict=True):
        kind, rows = int(kinds[a]), body[a:b]
        if kind == NONE:
            out[a:b] = rows
        elif kind == SUB:
            lanes = rows.reshape(b - a, -1, step)
            out[a:b] = np.cumsum(lanes, axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == UP:
            out[a:b] = np.cumsum(rows, axis=0, dtype=np.uint8) + above
        elif kind in (AVERAGE, PAETH):
            for k in range(a, b):
                out[k] = _unfiltered_row(kind, body[k], out[k - 1] if k else above, step)
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[b - 1]
    return out


def decode(data: bytes) -> np.ndarray:
    """The samples of a PNG, as (height, width) or (height, width, channels)."""
    header, body = None, []
    for kind, content in chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
    if header is None:
        raise ValueError("no IHDR chunk")
    width, height, depth, colour, _, _, interlace = header
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only non-interlaced 8-bit samples are read")
    step = CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    except zlib.error as e:
        raise ValueError(f"image data: {e}") from e
    if len(raw) != height * (1 + width * step):
        raise ValueError("image data has another size than the header says")
    out = unfilter(raw.reshape(height, 1 + width * step), step)
    return out if step == 1 else out.reshape(height, width, step)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    """The lowest rows of the orthonormal cosine transform of SIDE values."""
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    matrix = np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE)) * np.sqrt(2 / SIDE)
    matrix[0] /= np.sqrt(2)
    return matrix


def _area_means(samples: np.ndarray, axis: int) -> np.ndarray:
    """SIDE area means along an axis: exact integrals over equal intervals of a step function."""
    n = samples.shape[axis]
    total = np.insert(np.cumsum(samples, axis=axis, dtype=np.float64), 0, 0, axis=axis)
    edges = np.arange(SIDE + 1) * n / SIDE
    whole = np.minimum(edges.astype(np.int64), n)
    part = edges - whole
    shape = [1, 1]
    shape[axis] = -1
    at = np.take(total, whole, axis=axis) + part.reshape(shape) * np.take(samples, np.minimum(whole, n - 1), axis=axis)
    return np.diff(at, axis=axis) * SIDE / n


def phash(samples: np.ndarray) -> str:
    """64 bits in hex: which of the lowest 8 x 8 frequencies exceed their median (the mean level itself is left out)."""
    grey = samples.astype(np.float64) if samples.ndim == 2 else samples.mean(axis=2)
    small = _area_means(_area_means(grey, 0), 1)
    low = np.round(_cosines() @ small @ _cosines().T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def padded(text: str | None) -> tuple[int, bytes]:
    """Byte count, and the bytes with zeros up to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FEATURES = pa.schema([*_STORED, ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row of (doc_id, text): the padded bytes of the text as a PNG of WIDTH samples a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch):
                payloads = [padded(t) for t in texts]
                files = [encode(np.frombuffer(p, dtype=np.uint8).reshape(-1, WIDTH)) for _, p in payloads]
                yield record_batch(_STORED, {"doc_id": batch.column(0).slice(start, len(texts)), "n_bytes": [n for n, _ in payloads], "media": files})

    return docs.select(F.col("doc_id").cast("long"), clean_text("text").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def described(media: DataFrame) -> DataFrame:
    """Rows of stored() with what reading their files back gives: payload size and digests, the file's own, and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, files in text_slices(batch, "media"):
                samples = [decode(f) for f in files]
                back = [s.tobytes() for s in samples]
                digest = lambda parts: [hashlib.sha256(x).hexdigest() for x in parts]
                own = batch.slice(start, len(files))
                found = {"payload_bytes": [len(b) for b in back], "payload_sha256": digest(back), "tail_crc32": [zlib.crc32(b[-WIDTH:]) for b in back]}
                found |= {"media_bytes": [len(f) for f in files], "media_sha256": digest(files), "feature": [phash(s) for s in samples]}
                yield record_batch(_FEATURES, {name: own.column(name) for name in _STORED.names} | found)

    schema = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Write each text of (doc_id, text) as a PNG to a binary column of a stored table, read that back, and describe it."""
    return described(checkpointed(stored(docs)))
