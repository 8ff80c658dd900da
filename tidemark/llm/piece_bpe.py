"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A unit of text is merged with a score-ordered agenda: a heap of adjacent symbol pairs whose concatenation is a piece,
best score first and leftmost among equals; stale pairs are passed over. What no piece covers becomes byte pieces.

Vocabularies whose pieces hold the space mark only at their start (or are runs of it) never merge across the boundary
between a character and a following mark, so a text is the sequence of its marked words and each distinct word is merged
once per process (a bounded table). Other vocabularies are merged as whole texts. Decoding lays out the bytes of every id
of every text from a table of pieces. Every newly merged word, and whole texts of each slice drawn by their hashes, are
checked against the sentencepiece library in one batch call; a difference raises.

Cases: null text is empty (begin and end ids only); texts of any length; a text's own space marks (U+2581) are treated
as the library does; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, record_batch, text_slices
from tidemark.llm.word_table import WordTable, per_text

MARK = "▁"
CACHE_WORDS = 1 << 20
#: Whole texts per slice, long or short, that are compared with the library besides every new word.
CHECKED_TEXTS = 4
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class MergeCodec:
    """Encoder and decoder of a BPE model file with identity normalisation."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = sentencepiece.sentencepiece_model_pb2.ModelProto() if hasattr(sentencepiece, "sentencepiece_model_pb2") else _proto()
        spec.ParseFromString(open(model_file, "rb").read())
        normal = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or not normal.add_dummy_prefix:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are read")
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.score, self.id_of, self.text_of = {}, {}, {}
        self.bytes_at: list[int] | None = [0] * 256
        for k, piece in enumerate(spec.pieces):
            if piece.type == 1:
                self.score[piece.piece], self.id_of[piece.piece] = piece.score, k
                self.text_of[k] = piece.piece.replace(MARK, " ")
            elif piece.type == 6:
                self.bytes_at[int(piece.piece[3:5], 16)] = k
            elif piece.type in (4, 5):
                raise ValueError("user-defined or unused pieces are not supported")
        self.by_word = all(MARK not in p.lstrip(MARK) for p in self.score)
        self.byte_of = {k: b for b, k in enumerate(self.bytes_at)}
        surface = [bytes([self.byte_of[k]]) if k in self.byte_of else self.text_of.get(k, " \u2047 " if k == self.unknown else "").encode() for k in range(len(spec.pieces))]
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_size = np.asarray([len(x) for x in surface], dtype=np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.table = WordTable(CACHE_WORDS)

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges."""
        n, score = len(symbols), self.score
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (s := score.get(both := symbols[a] + symbols[b])) is not None:
                heapq.heappush(agenda, (-s, a, b, both))

        for k in range(n - 1):
            offer(k, k + 1)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or right[a] != b or symbols[a] + symbols[b] != both:
                continue
            symbols[a], symbols[b] = both, ""
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s]

    def _ids(self, escaped: str) -> np.ndarray:
        """Ids of escaped text (spaces are marks)."""
        ids: list[int] = []
        for piece in self.merged(list(escaped)):
            known = self.id_of.get(piece)
            ids += [known] if known is not None else [self.bytes_at[b] for b in piece.encode()]
        return np.asarray(ids, dtype="<u4")

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge new words, and check them all against the library, which sees each of them behind a line break.

        No piece holds a line break together with anything else.
        """
        texts = [w.decode() for w in words]
        found = [self._ids(t.replace(" ", MARK)) for t in texts]
        lead = len(self.library.encode("\n"))
        for text, ids, theirs in zip(texts, found, self.library.encode(["\n" + t for t in texts], num_threads=1), strict=True):
            if ids.tobytes() != np.asarray(theirs[lead:], dtype="<u4").tobytes() or self.decode(ids.tolist(), True) != text:
                raise ValueError(f"the library encodes {text!r} in another way")
        return np.concatenate(found), np.asarray([len(f) for f in found])

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, with begin and end, little-endian unsigned 32-bit.

        A word is a run of spaces with what follows up to the next space; every text begins with the dummy prefix.
        """
        plain = [self.by_word and bool(t) and MARK not in t for t in texts]
        pieces = [b" " + t.encode("utf-8", "replace") for t, p in zip(texts, plain, strict=True) if p]
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        stops = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        begins = raw == 0x20
        begins[1:] &= raw[:-1] != 0x20
        begins[stops[:-1]] = True
        begin = np.flatnonzero(begins)
        end = np.concatenate([begin[1:], [len(raw)]]) if len(begin) else begin
        ids, counts = self.table.encode(raw, begin, end, self.learn)
        own = iter(np.split(ids, per_text(counts, np.searchsorted(stops, begin, side="right"), len(stops))[:-1]) if len(stops) else [])
        head, tail = np.uint32(self.begin).tobytes(), np.uint32(self.end).tobytes()
        out = []
        for text, p in zip(texts, plain, strict=True):
            found = next(own) if p else self._ids(MARK + text.replace(" ", MARK)) if text else np.zeros(0, "<u4")
            out.append(head + found.tobytes() + tail)
        return out

    def decode_all(self, encoded: list[bytes]) -> list[bytes]:
        """The UTF-8 bytes of what each sequence of ids (as encode returns them) decodes to.

        Texts are valid UTF-8, so runs of byte pieces are whole characters and bytes can be laid out as they are.
        """
        ids = np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int64)
        size = self.surface_size[ids]
        place = np.arange(int(size.sum())) + np.repeat(self.surface_at[ids] - (np.cumsum(size) - size), size)
        flat = self.surface[place].tobytes()
        stops = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])])].tolist()
        return [flat[a + (flat[a : a + 1] == b" " and a < b) : b] for a, b in zip(stops, stops[1:], strict=False)]

    def decode(self, ids: list[int], prefixed: bool = False) -> str:
        """Text of ids: pieces joined, runs of byte pieces as UTF-8, control ids left out, the dummy prefix dropped.

        prefixed: keep the prefix, as for a word within a text.
        """
        out: list[str] = []
        pending = bytearray()
        byte_of = self.byte_of
        for k in ids:
            if k in byte_of:
                pending.append(byte_of[k])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if k in self.text_of:
                out.append(self.text_of[k])
            elif k == self.unknown:
                out.append(" ⁇ ")
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") and not prefixed else text

    def check(self, texts: list[str], ids: list[bytes], decoded: list[bytes]) -> None:
        """Raise unless the library encodes and decodes the texts alike."""
        theirs = self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        for text, own, other, back in zip(texts, ids, theirs, decoded, strict=True):
            if own != np.asarray(other, dtype="<u4").tobytes() or self.library.decode(other).encode() != back:
                raise ValueError(f"the library encodes or decodes {text[:60]!r} in another way")


def _proto():
    from sentencepiece import sentencepiece_model_pb2

    return sentencepiece_model_pb2.ModelProto()


_codecs: dict[str, MergeCodec] = {}


def codec(model_file: str) -> MergeCodec:
    """The codec of a model file, one per process."""
    if model_file not in _codecs:
        _codecs[model_file] = MergeCodec(model_file)
    return _codecs[model_file]


def encode_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            for start, texts in text_slices(batch):
                ids = own.encode(texts)
                decoded = own.decode_all(ids)
                drawn = sorted(range(len(texts)), key=lambda k: zlib.crc32(ids[k]))[:CHECKED_TEXTS]
                odd = [k for k, (t, d) in enumerate(zip(texts, decoded, strict=True)) if t.encode("utf-8", "replace") != d]
                chosen = sorted({*drawn, *odd})
                own.check([texts[k] for k in chosen], [ids[k] for k in chosen], [decoded[k] for k in chosen])
                digest = lambda b: hashlib.sha256(b).hexdigest()
                yield record_batch(_SCHEMA, {"doc_id": batch.column(0).slice(start, len(texts)), "n_tokens": [len(b) // 4 for b in ids], "ids_sha256": [digest(b) for b in ids], "decoded_sha256": [digest(d) for d in decoded]})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), clean_text("text").alias("text")).mapInArrow(run, schema)
