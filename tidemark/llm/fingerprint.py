"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every run of three bytes is hashed into one of BUCKETS buckets. The digest holds the length class, the ratios of the
bucket counts' quartiles, and two bits per bucket that say in which quartile its count lies. The difference of two
digests adds bucket steps (an opposite quartile counts double) and header steps, and is bounded by BOUND; the likeness
is 1 - difference / BOUND.

neighbours() pairs each row with the next one in descending order of doc_id (null ids last, then by hash of the text)
after a range partition; only the first and last text of each partition meet in a second, small step.

Cases: null text is empty, with an all-zero digest of length class 0; texts under three bytes have no triplets; the last
row's next is the first row (a single row is its own next); repeated rows are neighbours of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, clean_text, record_batch, text_slices

BUCKETS = 128
BOUND = 300
_STEP = np.asarray([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int64)


def triplet_counts(texts: list[bytes]) -> np.ndarray:
    """(texts x BUCKETS) counts of hashed triplets; none spans two texts."""
    sizes = np.asarray([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    out = np.zeros(len(texts) * BUCKETS, dtype=np.int64)
    if len(raw) > 2:
        mixed = ((raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]) * np.uint32(0x9E3779B1)
        bucket = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(25)
        owner = np.repeat(np.arange(len(texts)), sizes)[:-2]
        ends = np.cumsum(sizes)
        inside = np.arange(len(bucket)) + 2 < ends[owner]
        out = np.bincount((owner * BUCKETS + bucket)[inside], minlength=len(out))
    return out.reshape(len(texts), BUCKETS)


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x 3) headers (length class, two quartile ratios) and (texts x BUCKETS) quartile codes."""
    counts = triplet_counts(texts)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    codes = (counts > q1[:, None]).astype(np.int64) + (counts > q2[:, None]) + (counts > q3[:, None])
    sizes = np.asarray([len(t) for t in texts], dtype=np.float64)
    length = np.minimum(255, np.ceil(8 * np.log2(sizes + 1))).astype(np.int64)
    scale = np.maximum(q3, 1)
    return np.stack([length, q1 * 15 // scale, q2 * 15 // scale], axis=1), codes


def as_text(headers: np.ndarray, codes: np.ndarray) -> list[str]:
    """Digests in hex: two digits of length, one for each ratio, then two bits for each bucket."""
    bits = np.stack([codes >> 1, codes & 1], axis=2).reshape(len(codes), -1).astype(np.uint8)
    body = np.packbits(bits, axis=1)
    return [f"{h[0]:02x}{h[1]:x}{h[2]:x}{b.tobytes().hex()}" for h, b in zip(headers.tolist(), body, strict=True)]


def from_text(digest: str) -> tuple[np.ndarray, np.ndarray]:
    header = np.asarray([int(digest[:2], 16), int(digest[2], 16), int(digest[3], 16)])
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(digest[4:]), dtype=np.uint8)).astype(np.int64)
    return header, bits[::2] * 2 + bits[1::2]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, 1 - bounded difference / BOUND."""
    length = np.abs(a[0][:, 0] - b[0][:, 0])
    ratios = np.abs(a[0][:, 1:] - b[0][:, 1:])
    header = np.maximum(length - 1, 0) + (np.minimum(ratios, 16 - ratios)).sum(axis=1)
    steps = _STEP[a[1], b[1]].sum(axis=1)
    return 1.0 - np.minimum(header + steps, BOUND) / BOUND


def compare(one: str, other: str) -> float:
    """Likeness (0 to 1) of two digests in hex."""
    a, b = from_text(one), from_text(other)
    return float(likeness((a[0][None], a[1][None]), (b[0][None], b[1][None]))[0])


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) characters replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULTS, _EDGES = pa.schema(_ROW), pa.schema([*_ROW, ("part", pa.int32()), ("role", pa.string()), ("text", pa.string())])
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _described(ids: list, texts: list[str], nexts: list[str]) -> dict[str, list]:
    """Result columns of rows with their following texts."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    changed = [edited(t, n).encode("utf-8", "replace") for t, n in zip(texts, nexts, strict=True)]
    own, other = digests(raw), digests(changed)
    following = (own[0][1:], own[1][1:])
    last = digests([nexts[-1].encode("utf-8", "replace")])
    after = (np.concatenate([following[0], last[0]]), np.concatenate([following[1], last[1]]))
    return {"doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed], "fingerprint": as_text(*own), "edited_fingerprint": as_text(*other), "near_edited": likeness(own, other), "near_next": likeness(own, after)}


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their next ones; its first and last rows once more, with their texts."""
    part, held, first = TaskContext.get().partitionId(), None, None

    def edge(row: tuple, role: str) -> pa.RecordBatch:
        return record_batch(_EDGES, {f.name: [None] for f in _EDGES} | {"doc_id": [row[0]], "text": [row[1]], "part": [part], "role": [role]})

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for start, texts in text_slices(batch):
            own = ids[start : start + len(texts)]
            if held is not None:
                own, texts = [held[0], *own], [held[1], *texts]
            elif first is None:
                first = (own[0], texts[0])
                yield edge(first, "first")
            held = (own[-1], texts[-1])
            if len(texts) > 1:
                rows = len(texts) - 1
                yield record_batch(_EDGES, _described(own[:-1], texts[:-1], texts[1:]) | {"part": [part] * rows, "role": [None] * rows, "text": [None] * rows})
    if held is not None:
        yield edge(held, "last")


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, text, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield record_batch(_RESULTS, _described([ids], [text], [following]))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of (doc_id, text)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long"), clean_text("text").alias("text"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = checkpointed(rows.mapInArrow(_in_order, f"{_SCHEMA}, part int, role string, text string"))
    # One narrow row for each partition that has rows.
    parts = sorted(r.part for r in found.where("role = 'first'").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    last = found.where("role = 'last'").select("part", "doc_id", "text").join(F.broadcast(follows), "part")
    first = found.where("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    edges = last.join(first, "next_part").select("doc_id", "text", "next_text").mapInArrow(_edge_rows, _SCHEMA)
    return found.where("role is null").select(*(f.name for f in _RESULTS)).union(edges)
