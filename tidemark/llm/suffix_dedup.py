"""Suffix-array dedup: remove every byte covered by a 100-byte string that also starts earlier in the table.

Strings are brought together by content. Each 100-byte window belongs to its minimizer, the least hash among its 32-byte
substrings, so equal windows always share one; runs of windows with the same minimizer occurrence are one segment. Then:

1. each task cuts its texts into segments and collapses equal ones, keeping the earliest (the rest repeat it, whole);
2. segments meet by minimizer: later copies of an equal segment are covered, and minimizers with one segment are done;
3. what is left are different segments around one minimizer: their bytes are cut from the texts and
4. meet again by minimizer, where external induced sorting puts all their suffixes in order with common prefixes; of
   windows that agree in 100 bytes all but the earliest are covered;
5. spans meet their texts.

Everything moves as compressed blocks per bucket, so the number of rows shuffled is small. A minimizer with more than
HOT_SEGMENTS different segments is divided further, by window content, so no bucket depends on one passage's frequency.

Order is (doc_id, start), null ids last; rows that share a doc_id are ordered by a hash of their text, and fully repeated
rows count as one document, all getting the same result. Cases: null text is empty; texts under 100 bytes lose nothing;
an empty table gives an empty result; bytes that are no longer whole characters stay in the digests but not in texts.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import checkpointed, clean_text, mix64, record_batch, span_hashes, trim
from tidemark.llm.induced_sort import Pool, suffixes

LENGTH = 100
GRAM = 32
#: Bytes of text that one vectorised step holds, and steps after which a task hands its segments on.
PIECE = 1 << 19
STEPS = 12
#: Bytes of text for each partition of segments and documents, and for each of open segments (about four bytes to one of
#: text), beyond what spark.sql.shuffle.partitions asks for.
PARTITION_BYTES = 64 << 20
OPEN_BYTES = 16 << 20
#: Bytes of open segments that a task holds before it hands them on, and whose suffixes are sorted at a time.
HELD_BYTES = 16 << 20
SORTED_BYTES = 1 << 20
HOT_SEGMENTS = 20_000
_KEEP_BITS = np.uint64(24)
_LAST_ID = (1 << 63) - 1
_BLOCK_SCHEMA = "bucket int, kind int, block binary"
_BLOCKS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])
_RESULT = "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
SEGMENT = np.dtype([("mh", "u8"), ("sh", "u8"), ("doc", "i8"), ("hash", "i8"), ("start", "u4"), ("n", "u1")])
SPAN = np.dtype([("doc", "i8"), ("hash", "i8"), ("start", "u4"), ("n", "u4"), ("mh", "u8"), ("open", "u1")])
_TABLES = [mix64(np.arange(256, dtype=np.uint64) + np.uint64(k)) for k in (1000, 7000)]
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _pack(array: np.ndarray, payload: bytes = b"") -> bytes:
    """Records column by column, then a payload, compressed."""
    columns = b"".join(np.ascontiguousarray(array[f]).tobytes() for f in array.dtype.names)
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<qq", len(array), len(payload)) + columns + payload)


def _unpack(block: bytes, dtype: np.dtype) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, size = struct.unpack_from("<qq", raw)
    out, at = np.empty(n, dtype=dtype), 16
    for f in dtype.names:
        out[f] = np.frombuffer(raw, dtype=dtype[f], count=n, offset=at)
        at += n * dtype[f].itemsize
    return out, raw[at : at + size]


def segments(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of concatenated pieces of text: start in raw, windows, minimizer hash, content hash.

    Every window that lies within a piece is in exactly one segment. A segment has at most LENGTH - GRAM + 1 windows.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    n = len(raw)
    if n < LENGTH:
        return none
    m = _MULTIPLIER
    h1 = _TABLES[0][raw]
    with np.errstate(over="ignore"):
        h2 = h1[:-1] * m + h1[1:]
        h4 = h2[:-2] * m**2 + h2[2:]
        h8 = h4[:-4] * m**4 + h4[4:]
        h16 = h8[:-8] * m**8 + h8[8:]
        gram = mix64(h16[:-16] * m**16 + h16[16:])
    low = (gram & ~((np.uint64(1) << _KEEP_BITS) - np.uint64(1))) | np.arange(len(gram), dtype=np.uint64)
    least, reach, width = low, 1, LENGTH - GRAM + 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(low) - width + 1], least[width - reach :])
    at = (least & ((np.uint64(1) << _KEEP_BITS) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(lengths)
    inside = np.zeros(len(at) + 1, dtype=np.int8)
    real = lengths >= LENGTH
    np.add.at(inside, (ends - lengths)[real], 1)
    np.add.at(inside, (ends - LENGTH + 1)[real], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(begins)
    begins[np.concatenate([~inside, [True]])[:-1]] = True
    after = np.flatnonzero(begins)
    stop = np.concatenate([after, [len(at)]])[np.searchsorted(after, first) + 1]
    content = span_hashes(_TABLES[1][raw], first, stop + LENGTH - 1)
    return first, stop - first, gram[at[first]], content


def _earliest_first(s: np.ndarray) -> np.ndarray:
    """Segments sorted by minimizer, content, document and start."""
    return s[np.lexsort((s["start"], s["hash"], s["doc"], s["sh"], s["mh"]))]


def _spans_of(s: np.ndarray, is_open: int) -> np.ndarray:
    out = np.empty(len(s), dtype=SPAN)
    for f in ("doc", "hash", "start", "n", "mh"):
        out[f] = s[f]
    out["open"] = is_open
    return out


def _collapsed(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of each kind of equal segments, and the spans of the others."""
    s = _earliest_first(s)
    first = np.ones(len(s), dtype=bool)
    first[1:] = (s["sh"][1:] != s["sh"][:-1]) | (s["mh"][1:] != s["mh"][:-1])
    # Fully repeated rows: the same document and start again is not a later copy.
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(s) else np.zeros(0, np.int64)
    same = (s["doc"] == s["doc"][lead]) & (s["hash"] == s["hash"][lead]) & (s["start"] == s["start"][lead])
    return s[first], _spans_of(s[~first & ~same], 0)


def _merged_spans(spans: np.ndarray) -> np.ndarray:
    """Closed spans of each document as few disjoint or touching-free runs of windows; open ones as they are."""
    closed, others = spans[spans["open"] == 0], spans[spans["open"] == 1]
    if not len(closed):
        return others
    closed = closed[np.lexsort((closed["start"], closed["hash"], closed["doc"]))]
    start, end = closed["start"].astype(np.int64), closed["start"].astype(np.int64) + closed["n"]
    fresh = np.ones(len(closed), dtype=bool)
    fresh[1:] = (closed["doc"][1:] != closed["doc"][:-1]) | (closed["hash"][1:] != closed["hash"][:-1])
    group = np.cumsum(fresh) - 1
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    out = closed[first].copy()
    out["n"] = reach[np.concatenate([first[1:], [len(closed)]]) - 1] - start[first]
    return np.concatenate([out, others])


def _by_bucket(records: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(first, [*first[1:], len(bucket)], strict=True):
        yield int(bucket[a]), kind, _pack(records[a:b])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return record_batch(_BLOCKS, {"bucket": [r[0] for r in rows], "kind": [r[1] for r in rows], "block": [r[2] for r in rows]})


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(np.asarray(doc).astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, text hashes, all bytes of the texts, and where each text begins (with the end appended)."""
    column = batch.column(2).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), data, offsets


def _cut(buckets: int):
    """Step 1: segments of each batch, collapsed, to buckets of minimizers; spans of their copies to buckets of documents."""

    def flush(pieces: list[tuple[int, int, int, int]], data: np.ndarray, ids: np.ndarray, hashes: np.ndarray, out: list[np.ndarray]) -> None:
        row, begin, end, text_begin = np.asarray(pieces, dtype=np.int64).T
        raw = np.concatenate([data[a:b] for _, a, b, _ in pieces])
        first, n, mh, sh = segments(raw, end - begin)
        if len(first):
            ends = np.cumsum(end - begin)
            piece = np.searchsorted(ends, first, side="right")
            s = np.empty(len(first), dtype=SEGMENT)
            s["mh"], s["sh"], s["doc"], s["hash"], s["n"] = mh, sh, ids[row[piece]], hashes[row[piece]], n
            s["start"] = first - (ends - (end - begin))[piece] + (begin - text_begin)[piece]
            out.append(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(found: list[np.ndarray]) -> pa.RecordBatch:
            kept, copies = _collapsed(np.concatenate(found))
            rows = list(_by_bucket(kept, (kept["mh"] % np.uint64(buckets)).astype(np.int64), 0))
            copies = _merged_spans(copies)
            return _batch([*rows, *_by_bucket(copies, _doc_bucket(copies["doc"], buckets), 1)])

        found: list[np.ndarray] = []
        for batch in batches:
            ids, hashes, data, offsets = _texts(batch)
            pieces: list[tuple[int, int, int, int]] = []
            size = 0
            for row in range(len(ids)):
                begin, end = int(offsets[row]), int(offsets[row + 1])
                at = begin
                while end - at >= LENGTH:
                    # A long text goes in pieces that overlap by one window less a byte.
                    stop = min(end, at + PIECE)
                    pieces.append((row, at, stop, begin))
                    size += stop - at
                    if size >= PIECE:
                        flush(pieces, data, ids, hashes, found)
                        pieces, size = [], 0
                        if len(found) >= STEPS:
                            yield handed(found)
                            found = []
                    at = stop - LENGTH + 1 if stop < end else end
            if pieces:
                flush(pieces, data, ids, hashes, found)
        if found:
            yield handed(found)
        trim()

    return run


def _meet(buckets: int):
    """Step 2: per minimizer, copies become closed spans and segments still to be compared become open ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            passed = []
            for bucket, kind, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if kind:
                    passed.append((bucket, kind, block))
                else:
                    held.append(_unpack(block, SEGMENT)[0])
            if passed:
                yield _batch(passed)
        if not held:
            return
        s = np.concatenate(held)
        held.clear()
        s = s[np.argsort(s["mh"], kind="stable")]
        alone = np.ones(len(s), dtype=bool)
        same = s["mh"][1:] == s["mh"][:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        kept, copies = _collapsed(s[~alone])
        del s
        shared = np.zeros(len(kept), dtype=bool)
        same = kept["mh"][1:] == kept["mh"][:-1]
        shared[1:] |= same
        shared[:-1] |= same
        kept = kept[shared]
        spans = _spans_of(kept, 1)
        fresh = np.concatenate([[True], kept["mh"][1:] != kept["mh"][:-1]]) if len(kept) else np.zeros(0, bool)
        group = np.cumsum(fresh) - 1
        spans["open"][np.bincount(group)[group] > HOT_SEGMENTS if len(kept) else []] = 2
        spans = np.concatenate([spans, _merged_spans(copies)])
        out = list(_by_bucket(spans, _doc_bucket(spans["doc"], buckets), 1))
        if out:
            yield _batch(out)
        trim()

    return run


def _text_blocks(buckets: int):
    """Texts by bucket of documents: (id, hash, size) records, the bytes, and any further columns as an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, data, offsets = _texts(batch)
            bucket = _doc_bucket(ids, buckets)
            order = np.argsort(bucket, kind="stable")
            rows, at = [], 0
            while at < len(order):
                end, size = at, 0
                while end < len(order) and bucket[order[end]] == bucket[order[at]] and size < PIECE:
                    size += int(offsets[order[end] + 1] - offsets[order[end]])
                    end += 1
                own = order[at:end]
                heads = np.empty(len(own), dtype=_HEAD)
                heads["doc"], heads["hash"], heads["size"] = ids[own], hashes[own], offsets[own + 1] - offsets[own]
                payload = b"".join(data[offsets[k] : offsets[k + 1]].tobytes() for k in own)
                if batch.num_columns > 3:
                    further = pa.RecordBatch.from_arrays(batch.columns[3:], names=batch.schema.names[3:]).take(pa.array(own))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, further.schema) as stream:
                        stream.write_batch(further)
                    payload += sink.getvalue().to_pybytes()
                rows.append((int(bucket[order[at]]), 2, _pack(heads, payload)))
                at = end
            if rows:
                yield _batch(rows)

    return run


_HEAD = np.dtype([("doc", "i8"), ("hash", "i8"), ("size", "i8")])
_PIECE = np.dtype([("key", "u8"), ("doc", "i8"), ("hash", "i8"), ("start", "u4"), ("n", "u1")])


class _Spans:
    """Spans by document, from blocks; texts come after all spans of their partition."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.sorted: np.ndarray | None = None

    def add(self, block: bytes, wanted: int) -> None:
        spans = _unpack(block, SPAN)[0]
        self.held.append(spans[(spans["open"] > 0) == bool(wanted)])

    def of(self, heads: np.ndarray) -> list[np.ndarray]:
        if self.sorted is None:
            spans = np.concatenate(self.held) if self.held else np.zeros(0, dtype=SPAN)
            self.sorted = spans[np.lexsort((spans["start"], spans["hash"], spans["doc"]))]
            self.held = []
            fresh = np.ones(len(self.sorted), dtype=bool)
            fresh[1:] = (self.sorted["doc"][1:] != self.sorted["doc"][:-1]) | (self.sorted["hash"][1:] != self.sorted["hash"][:-1])
            first = np.flatnonzero(fresh).tolist()
            ends = [*first[1:], len(self.sorted)] if first else []
            self.where = {(int(self.sorted["doc"][a]), int(self.sorted["hash"][a])): (a, b) for a, b in zip(first, ends, strict=True)}
        return [self.sorted[slice(*self.where.get((int(d), int(h)), (0, 0)))] for d, h in zip(heads["doc"], heads["hash"], strict=True)]


def _contents(buckets: int):
    """Step 3: the bytes of open segments, by bucket of their key (minimizer, or window content if that is hot)."""

    def handed(held: list[tuple[np.ndarray, bytes]]) -> pa.RecordBatch:
        pieces, text = np.concatenate([p for p, _ in held]), b"".join(t for _, t in held)
        bucket = (pieces["key"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
        begins = _begins(pieces)
        return _batch([(int(bucket[order[a]]), 3, _pack(pieces[order[a:b]], _texts_of(pieces, begins, text, order[a:b]))) for a, b in zip(first, [*first[1:], len(order)], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = _Spans()
        held: list[tuple[np.ndarray, bytes]] = []
        size = 0
        for batch in batches:
            for kind, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == 1:
                    spans.add(block, 1)
                    continue
                heads, payload = _unpack(block, _HEAD)
                raw = np.frombuffer(payload, dtype=np.uint8)
                begins = np.cumsum(heads["size"]) - heads["size"]
                records, wheres = [], []
                for own, begin in zip(spans.of(heads), begins.tolist(), strict=True):
                    if not len(own):
                        continue
                    hot = own[own["open"] == 2]
                    if len(hot):
                        each = np.repeat(hot, hot["n"])
                        each["start"] += (np.arange(len(each)) - np.repeat(np.cumsum(hot["n"]) - hot["n"], hot["n"])).astype(np.uint32)
                        each["n"] = 1
                        windows = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[begin + each["start"].astype(np.int64)]
                        each["mh"] = [int.from_bytes(hashlib.blake2b(w.tobytes(), digest_size=8).digest(), "little") for w in windows]
                        own = np.concatenate([own[own["open"] == 1], each])
                    piece = np.empty(len(own), dtype=_PIECE)
                    piece["key"] = own["mh"]
                    for f in ("doc", "hash", "start", "n"):
                        piece[f] = own[f]
                    records.append(piece)
                    wheres.append(begin + own["start"].astype(np.int64))
                if not records:
                    continue
                pieces, where = np.concatenate(records), np.concatenate(wheres)
                text = b"".join(payload[w : w + n + LENGTH - 1] for w, n in zip(where.tolist(), pieces["n"].tolist(), strict=True))
                held.append((pieces, text))
                size += len(text)
                if size >= HELD_BYTES:
                    yield handed(held)
                    held, size = [], 0
        if held:
            yield handed(held)
        trim()

    return run


def _begins(pieces: np.ndarray) -> np.ndarray:
    """Where each piece's text begins, when they follow each other."""
    sizes = pieces["n"].astype(np.int64) + LENGTH - 1
    return np.cumsum(sizes) - sizes


def _texts_of(pieces: np.ndarray, begins: np.ndarray, text: bytes, own: np.ndarray) -> bytes:
    """The texts of some pieces, one after another."""
    return b"".join(text[b : b + n + LENGTH - 1] for b, n in zip(begins[own].tolist(), pieces["n"][own].tolist(), strict=True))


def _repeats(pieces: np.ndarray, raw: np.ndarray, pool: Pool) -> np.ndarray:
    """Windows of the pieces that an earlier piece's window equals, as closed spans of one window each."""
    sizes = pieces["n"].astype(np.int64) + LENGTH - 1
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), dtype=np.uint16)
    inside = np.ones(len(text), dtype=bool)
    inside[begins + sizes] = False
    text[inside] = raw.astype(np.uint16) + 1
    windows, classes, number = [], [], 0
    piece_of = np.repeat(np.arange(len(pieces)), sizes + 1)
    for at, lcp in suffixes(text, 257, pool):
        piece = piece_of[at]
        valid = at - begins[piece] < pieces["n"][piece]
        # A suffix joins the class of the one before it if they agree in LENGTH symbols; none of these is a separator
        # where the window is valid, so classes of valid windows never mix with others.
        joined = lcp >= LENGTH
        group = number + np.cumsum(~joined)
        number = int(group[-1])
        follows = np.concatenate([joined[1:], [True]])
        keep = valid & (joined | follows)
        windows.append(at[keep])
        classes.append(group[keep])
    at, group = np.concatenate(windows), np.concatenate(classes)
    piece = piece_of[at]
    start = pieces["start"][piece].astype(np.int64) + at - begins[piece]
    order = np.lexsort((start, pieces["hash"][piece], pieces["doc"][piece], group))
    first = np.ones(len(order), dtype=bool)
    first[1:] = group[order][1:] != group[order][:-1]
    lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
    doc, text_hash = pieces["doc"][piece], pieces["hash"][piece]
    same = (doc[order] == doc[lead]) & (text_hash[order] == text_hash[lead]) & (start[order] == start[lead])
    later = order[~same]
    out = np.zeros(len(later), dtype=SPAN)
    out["doc"], out["hash"], out["start"], out["n"] = doc[later], text_hash[later], start[later], 1
    return out


def _compare(buckets: int, budget: int):
    """Step 4: sort the suffixes of pieces and close the windows that occur earlier.

    Pieces of one key are sorted together, in groups of about SORTED_BYTES, so sorting costs the same for each byte of the
    input and doesn't come to scratch files as tables grow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, bytes]] = []
        for batch in batches:
            held += [_unpack(block, _PIECE) for block in batch.column(2).to_pylist()]
        if not held:
            return
        pieces, text = np.concatenate([p for p, _ in held]), b"".join(t for _, t in held)
        held.clear()
        begins = _begins(pieces)
        groups = 1 + len(text) // SORTED_BYTES
        group = (mix64(pieces["key"]) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(groups + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a == b:
                continue
            own = order[a:b]
            found = _merged_spans(_repeats(pieces[own], np.frombuffer(_texts_of(pieces, begins, text, own), dtype=np.uint8), Pool(budget=budget, depth=LENGTH)))
            if len(found):
                yield _batch(list(_by_bucket(found, _doc_bucket(found["doc"], buckets), 1)))
        del pieces, text
        trim()

    return run


def _whole_characters(kept: np.ndarray, raw: np.ndarray) -> bytes:
    """The kept bytes without characters of which a byte is removed."""
    lead = (raw & 0xC0) != 0x80
    character = np.cumsum(lead) - 1
    broken = np.zeros(int(character[-1]) + 1 if len(raw) else 0, dtype=bool)
    broken[character[~kept]] = True
    return raw[kept & ~broken[character]].tobytes()


def _cut_text(text: bytes, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's bytes and which of them are kept."""
    edges = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(edges, spans["start"].astype(np.int64), 1)
    np.add.at(edges, spans["start"].astype(np.int64) + spans["n"].astype(np.int64) + LENGTH - 1, -1)
    return np.frombuffer(text, dtype=np.uint8), np.cumsum(edges[:-1]) == 0


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, bytes, list[tuple[bytes, np.ndarray]]]]:
    """Blocks of texts (heads, what follows the texts) with each text and its spans."""
    spans = _Spans()
    for batch in batches:
        for kind, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if kind == 1:
                spans.add(block, 0)
                continue
            heads, payload = _unpack(block, _HEAD)
            ends = np.cumsum(heads["size"]).tolist()
            texts = [payload[end - size : end] for size, end in zip(heads["size"].tolist(), ends, strict=True)]
            yield heads, payload[ends[-1] :], list(zip(texts, spans.of(heads), strict=True))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 5: measure what the spans remove from their texts."""
    for heads, _, texts in _documents(batches):
        out = {f.name: [] for f in _RESULTS}
        for head, (text, spans) in zip(heads, texts, strict=True):
            size, removed, runs = len(text), 0, 0
            if len(spans):
                raw, kept = _cut_text(text, spans)
                gone = ~kept
                removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & kept[:-1]).sum())
                text = raw[kept].tobytes()
            for name, value in zip(out, (int(head["doc"]), int(head["hash"]), size, removed, runs, hashlib.sha256(text).hexdigest()), strict=True):
                out[name].append(value)
        yield record_batch(_RESULTS, out)


def _rewrite(schema: pa.Schema, further: list[str]):
    """Step 5, for whole rows: the other columns (further, in this order) as they were, the text without what is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, others, texts in _documents(batches):
            rest = pa.ipc.open_stream(others).read_next_batch()
            cut = []
            for text, spans in texts:
                if len(spans):
                    raw, kept = _cut_text(text, spans)
                    text = _whole_characters(kept, raw)
                cut.append(text.decode("utf-8", "replace"))
            columns = {name: rest.column(k) for k, name in enumerate(further)}
            columns["text"] = pa.array(cut, type=pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in cut])
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def _met(docs: DataFrame, further: list[str], budget: int) -> DataFrame:
    """All spans and texts, as sorted blocks: spans before texts in each partition."""
    spark = docs.sparkSession
    text = clean_text("text")
    size, least = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, wide = (max(least, -(-size // most)) for most in (PARTITION_BYTES, OPEN_BYTES))
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID))
    own = [ids.alias("_id"), F.xxhash64(text).alias("_hash"), text.cast("binary").alias("_text")]
    bare, whole = docs.select(*own), docs.select(*own, *(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(further)))
    meet = lambda df: df.repartition(buckets, "bucket").sortWithinPartitions("kind")
    cut = bare.mapInArrow(_cut(buckets), _BLOCK_SCHEMA)
    spans = checkpointed(cut.repartition(buckets, "bucket").mapInArrow(_meet(buckets), _BLOCK_SCHEMA))
    pieces = meet(spans.union(bare.mapInArrow(_text_blocks(buckets), _BLOCK_SCHEMA))).mapInArrow(_contents(wide), _BLOCK_SCHEMA)
    more = checkpointed(pieces.repartition(wide, "bucket").mapInArrow(_compare(buckets, budget), _BLOCK_SCHEMA))
    return meet(spans.union(more).union(whole.mapInArrow(_text_blocks(buckets), _BLOCK_SCHEMA)))


def dedup(docs: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """(doc_id, text_hash, n_bytes, n_removed, n_spans, kept_sha256) of every row of (doc_id, text).

    text_hash is xxhash64 of the text and tells rows of one doc_id apart. budget: bytes of suffix tuples that one sorter
    keeps in memory before it writes scratch files.
    """
    out = _met(docs, [], budget).mapInArrow(_apply, _RESULT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _LAST_ID, F.col("doc_id")))


def rewrite(docs: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """All rows and columns of docs, their texts without what occurs earlier; n_chars, if there, is counted anew.

    A character of which only some bytes go is removed whole. A null text becomes an empty one. Columns may have any names.
    """
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in docs.schema])
    further = [c for c in docs.columns if c != "text"]
    return _met(docs, further, budget).mapInArrow(_rewrite(schema, further), docs.schema)
