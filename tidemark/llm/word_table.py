"""Token ids of words, looked up for whole batches at once.

Words are found by a 64-bit hash of their bytes in an open-addressing table of numpy arrays, and then compared byte by
byte; a batch's words are looked up, and their ids laid out, without a Python object per word. Only words that the table
doesn't hold yet are handed to a tokenizer. A full table starts anew. A batch in which two words share a hash is looked up
in a dictionary of words instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tidemark.llm.common import mix64, span_hashes

_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(4099))


class WordTable:
    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.mask = np.uint64((1 << (limit * 4 - 1).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, dtype=np.uint64)
        self.entry = np.zeros(int(self.mask) + 1, dtype=np.int32)
        self.used = self.held = 0
        self.begin, self.count = np.zeros(self.limit, dtype=np.int64), np.zeros(self.limit, dtype=np.int32)
        self.ids = np.zeros(4 * self.limit, dtype=np.uint32)
        self.at, self.size = np.zeros(self.limit, dtype=np.int64), np.zeros(self.limit, dtype=np.int64)
        self.bytes, self.bytes_held = np.zeros(8 * self.limit, dtype=np.uint8), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 for unknown ones."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        live, slot = np.arange(len(hashes)), hashes & self.mask
        while len(live):
            key = self.keys[slot]
            hit = key == hashes[live]
            out[live[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            live, slot = live[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def add(self, hashes: np.ndarray, words: list[bytes], flat: np.ndarray, counts: np.ndarray) -> None:
        """Enter different unknown hashes with their words and ids, which lie one after another."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        while self.bytes_held + len(raw) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.bytes_held : self.bytes_held + len(raw)] = raw
        while self.held + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.held : self.held + len(flat)] = flat
        numbers = np.arange(self.used, self.used + len(counts))
        self.begin[numbers] = self.held + np.cumsum(counts) - counts
        self.count[numbers] = counts
        self.size[numbers] = [len(w) for w in words]
        self.at[numbers] = self.bytes_held + np.cumsum(self.size[numbers]) - self.size[numbers]
        self.bytes_held += len(raw)
        self.used, self.held = self.used + len(counts), self.held + len(flat)
        live, slot = np.arange(len(hashes)), hashes & self.mask
        while len(live):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]], self.entry[slot[taken]] = hashes[live[taken]], numbers[live[taken]]
            rest = np.ones(len(live), dtype=bool)
            rest[taken] = False
            live, slot = live[rest], (slot[rest] + np.uint64(1)) & self.mask

    def encode(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words raw[begin:end], one after another, and how many each word has. learn: the same of new words."""
        hashes = span_hashes(_BYTE[raw], begin, end) | np.uint64(1)
        entries = self.find(hashes)
        for _ in range(2):
            missing = np.flatnonzero(entries < 0)
            if not len(missing):
                break
            new, first = np.unique(hashes[missing], return_index=True)
            if self.used + len(new) > self.limit:
                self.limit = max(self.limit, 2 * len(np.unique(hashes)))
                self.mask = np.uint64((1 << (self.limit * 4 - 1).bit_length()) - 1)
                self.clear()
                entries[:] = -1
                continue
            at = missing[first]
            data = raw.tobytes()
            words = [data[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            self.add(new, words, *learn(words))
            entries[missing] = self.find(hashes[missing])
        if not self._same(raw, begin, end, entries):
            return _one_by_one(raw, begin, end, learn)
        counts = self.count[entries].astype(np.int64)
        return self.ids[_spread(self.begin[entries], counts)], counts

    def _same(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, entries: np.ndarray) -> bool:
        """Whether the words raw[begin:end] are those of the entries."""
        size = end - begin
        return bool((self.size[entries] == size).all()) and bool((self.bytes[_spread(self.at[entries], size)] == raw[_spread(begin, size)]).all())


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans of that size, one span after another."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def _one_by_one(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    data, number = raw.tobytes(), {}
    entries = np.asarray([number.setdefault(data[a:b], len(number)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], dtype=np.int64)
    flat, counts = learn(list(number))
    counts = np.asarray(counts, dtype=np.int64)
    return flat[_spread((np.cumsum(counts) - counts)[entries], counts[entries])], counts[entries]


def per_text(counts: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Where each text's ids end, from the ids per word and the words' (ascending) texts."""
    return np.cumsum(np.bincount(owner, weights=counts, minlength=texts).astype(np.int64))
