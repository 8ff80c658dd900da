"""Best-two-fit packing of tokenised documents into sequences.

Only the lengths matter for packing, and there are at most `capacity` of them, so the operator packs the histogram of
lengths: a bin is filled greedily with the largest lengths that fit; then its smallest document gives way to two unpacked
ones if some two fill the widened gap more tightly. A pattern found that way is used as often as the histogram allows, so
the work on the driver depends on the capacity alone, not on the number of documents.

Documents get their places by rank among those of equal length. Ranks come from counts per task and length (each task
numbers its own pieces), so a length that many documents share is never gathered in one task.

Tokens: distinct words are encoded once per process (a bounded table) where the tokenizer's word rule is certain to
apply; texts with other characters, apostrophes or special-token strings are encoded whole.

Cases: null text is empty and gives the end id only; a document longer than the capacity is cut into full pieces and a
rest; repeated rows are packed separately; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, clean_text, record_batch, text_slices, trim
from tidemark.llm.word_table import WordTable, per_text

CAPACITY = 2048
END = 0
CACHE_WORDS = 1 << 20
WORD_END = "</w>"
#: Printable Latin-1 text without apostrophes, for which the tokenizer's normaliser and word rule are restated below:
#: a word is a run of letters, one digit, or a run of other signs.
_PLAIN = re.compile("[\t\n\r\x20-\x26\x28-\x7e\xa1-\xac\xae-\xff]*")
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.full(256, _SIGN, dtype=np.uint8)
_KIND[[ord(c) for c in "\t\n\r "]] = _SPACE
_KIND[[ord(c) for c in "0123456789²³¹¼½¾"]] = _DIGIT
_KIND[[ord(c) for c in map(chr, range(256)) if c.isalpha()]] = _LETTER


class WordEncoder:
    """Token ids of texts by a tokenizer file, word by word where that is exact."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.table = WordTable(CACHE_WORDS)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and how many each has: encoded as one text, told apart by the tokens that end a word."""
        ids = self._whole([b" ".join(words).decode("latin-1")])[0]
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            found = self._whole([w.decode("latin-1") for w in words])
            return np.concatenate(found), np.asarray([len(f) for f in found])
        return ids, np.diff(stops, prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        raw = np.frombuffer(b"".join(t.lower().encode("latin-1") + b" " for t, p in zip(texts, plain, strict=True) if p), dtype=np.uint8)
        kind = _KIND[raw]
        begins = kind != _SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        ends = kind != _SPACE
        ends[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == _DIGIT)
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        stops = np.cumsum([len(t) + 1 for t, p in zip(texts, plain, strict=True) if p])
        ids, counts = self.table.encode(raw, begin, end, self._words)
        own = iter(np.split(ids, per_text(counts, np.searchsorted(stops, begin, side="right"), len(stops))[:-1]) if len(stops) else [])
        others = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(own) if p else next(others) for p in plain]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def two_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) patterns that together use up counts[length] documents of each length.

    counts has capacity + 1 entries; counts[0] must be 0. Lengths in a pattern are in descending order but for the two
    of a replacement, which come last.
    """
    left = counts.astype(np.int64).copy()
    lengths = np.arange(capacity + 1)
    out: list[tuple[int, list[int]]] = []
    while True:
        present = np.flatnonzero(left)
        if not len(present):
            return out
        free, gap, pattern = left.copy(), capacity, []
        least = int(present[0])
        at = len(present) - 1
        while gap >= least and at >= 0:
            at = min(at, int(np.searchsorted(present, gap, side="right")) - 1)
            while at >= 0 and not free[present[at]]:
                at -= 1
            if at < 0:
                break
            size = int(present[at])
            times = min(int(free[size]), gap // size)
            pattern += [size] * times
            free[size] -= times
            gap -= size * times
        smallest = pattern[-1]
        if gap and len(pattern):
            room = gap + smallest
            below = np.where(free > 0, lengths, 0)
            nearest = np.maximum.accumulate(below)
            second = np.where(free > 1, lengths, 0)
            previous = np.maximum.accumulate(np.concatenate([[0], below[:-1]]))
            first = np.flatnonzero(free[: room] > 0)
            rest = nearest[np.minimum(room - first, capacity)]
            rest = np.where(rest == first, np.where(second[first] > 0, first, previous[first]), rest)
            total = np.where(rest > 0, first + rest, 0)
            if len(total) and total.max() > smallest:
                best = int(total.argmax())
                pattern = pattern[:-1] + sorted([int(first[best]), int(rest[best])], reverse=True)
        used = np.bincount(pattern, minlength=capacity + 1)
        some = np.flatnonzero(used)
        times = int((left[some] // used[some]).min())
        left -= used * times
        out.append((times, pattern))


def places(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), first sequence and offset of each run of ranks."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in patterns:
        offset = 0
        for size in pattern:
            rows.append((size << 40 | used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + times
            offset += size
        sequence += times
    rows.sort()
    table = np.asarray(rows, dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("local", pa.int64())])
_PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, own = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64), encoder(path)
        end = np.uint32(END).tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin, texts in text_slices(batch):
                rows = []
                for doc_id, found in zip(ids[begin:], own.encode(texts), strict=False):
                    raw = found.tobytes() + end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
                doc_ids, numbers, starts, lengths, crcs = zip(*rows, strict=True)
                sizes = np.asarray(lengths, dtype=np.int64)
                order = np.argsort(sizes, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], sizes[order][1:] != sizes[order][:-1]]))
                runs = np.diff(np.concatenate([first, [len(order)]]))
                local = np.empty(len(order), dtype=np.int64)
                local[order] = np.arange(len(order)) - np.repeat(first, runs) + seen[sizes[order]]
                seen += np.bincount(sizes, minlength=capacity + 1)
                yield record_batch(_PIECES, {"doc_id": doc_ids, "piece": numbers, "start": starts, "length": sizes, "ids_crc32": crcs, "part": np.full(len(sizes), part), "local": local})
        # Workers outlive tasks and go on to other stages, so what was learned isn't kept.
        own.table.clear()
        trim()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), clean_text("text").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local long"
    pieces = checkpointed(rows.mapInArrow(_pieces(tokenizer_path, capacity), schema))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[size] = n
    # At most a few thousand patterns of at most `capacity` lengths in all sizes: a bound set by the capacity.
    table = spark.sparkContext.broadcast(places(two_fit(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = table.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 40) | rank, side="right") - 1
            columns = {name: batch.column(k) for k, name in enumerate(_PACKED.names[:5])}
            yield record_batch(_PACKED, columns | {"sequence_id": sequences[at] + rank - (keys[at] & ((1 << 40) - 1)), "offset": offsets[at]})

    ranked = pieces.join(shifts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("shift")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
