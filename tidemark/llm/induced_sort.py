"""External induced suffix sorting: all suffixes of a text in order, with common-prefix lengths up to a depth.

Suffix tuples (position, common prefix with the tuple before) move through monotone priority queues keyed by the first
symbol. A queue is a radix tree of FIFO blocks; blocks beyond the memory budget go to scratch files, so a text may be far
larger than memory (the text itself may be a memory map). Left-to-right minima of the prefix lengths are carried per
symbol, which gives each induced tuple its own prefix length: one more than the least between its source and the source
before it in the same bucket.

One level: cut the text at its LMS positions, sort the LMS substrings by inducing, name them, sort the string of names by
recursion (or, once it fits the budget, by prefix doubling in memory), then induce all suffixes from the sorted LMS
suffixes. Suffixes that agree in their first `depth` symbols may come in any order, but always next to each other.

Scratch files are private to the calling task, live in a temporary folder that is removed when sorting ends, and are
never read by anyone else, like the files of Spark's own sorters.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

_TUPLE = np.dtype([("at", np.int64), ("lcp", np.uint8)])
BLOCK = 1 << 16


class Pool:
    """Memory for queued tuples, and scratch files for what exceeds it."""

    def __init__(self, budget: int = 64 << 20, base: int = 4_000_000, depth: int = 100, block: int = BLOCK):
        self.budget, self.base, self.depth, self.block = budget, base, min(depth, 255), block
        self.held = self.files = self.spilled = 0
        self.folder: tempfile.TemporaryDirectory | None = None

    def store(self, block: np.ndarray) -> np.ndarray | str:
        if self.held + block.nbytes <= self.budget:
            self.held += block.nbytes
            return block
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="tidemark-sort-")
        self.files += 1
        self.spilled += block.nbytes
        path = f"{self.folder.name}/{self.files}"
        block.tofile(path)
        return path

    def load(self, stored: np.ndarray | str) -> np.ndarray:
        if isinstance(stored, str):
            block = np.fromfile(stored, dtype=_TUPLE)
            os.unlink(stored)
            return block
        self.held -= stored.nbytes
        return stored

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()
            self.folder = None


class Fifo:
    """Tuples in order of arrival."""

    __slots__ = ("pool", "blocks", "tail", "small")

    def __init__(self, pool: Pool):
        self.pool, self.blocks, self.tail, self.small = pool, [], [], 0

    def push(self, block: np.ndarray) -> None:
        self.tail.append(block)
        self.small += len(block)
        if self.small >= self.pool.block:
            self.seal()

    def seal(self) -> None:
        if self.tail:
            self.blocks.append(self.pool.store(np.concatenate(self.tail)))
            self.tail, self.small = [], 0

    def pop(self, newest: bool = False) -> np.ndarray | None:
        """The oldest (or newest) block, or None."""
        if newest or not self.blocks:
            self.seal()
        return self.pool.load(self.blocks.pop(-1 if newest else 0)) if self.blocks else None


class RadixQueue:
    """Monotone priority queue over symbols: keys leave in ascending order, and equal keys in order of arrival."""

    def __init__(self, pool: Pool, symbols: int, text: np.ndarray, sign: int):
        self.pool, self.text, self.sign, self.symbols = pool, text, sign, symbols
        self.shifts = list(range(8 * max(0, (max(symbols - 1, 1).bit_length() - 1) // 8), -1, -8))
        self.levels: list[dict[int, Fifo]] = [{} for _ in self.shifts]
        self.open: list[int | None] = [None] * len(self.shifts)

    def keys(self, block: np.ndarray) -> np.ndarray:
        symbols = self.text[block["at"]].astype(np.int64)
        return symbols if self.sign > 0 else self.symbols - 1 - symbols

    def push_one(self, key: int, block: np.ndarray) -> None:
        level = 0
        while level + 1 < len(self.shifts) and self.open[level] == key >> self.shifts[level]:
            level += 1
        fifo = self.levels[level].get(key >> self.shifts[level])
        if fifo is None:
            fifo = self.levels[level][key >> self.shifts[level]] = Fifo(self.pool)
        fifo.push(block)

    def push(self, keys: np.ndarray, block: np.ndarray) -> None:
        """Blocks are sorted by key, stably."""
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
            self.push_one(int(keys[a]), block[a:b])

    def least(self) -> int | None:
        """The smallest key, after opening the tree down to it."""
        while True:
            level = len(self.shifts) - 1
            while level >= 0 and not self.levels[level]:
                level -= 1
            if level < 0:
                return None
            prefix = min(self.levels[level])
            if level == len(self.shifts) - 1:
                return prefix
            fifo = self.levels[level].pop(prefix)
            self.open[level] = prefix
            while (block := fifo.pop()) is not None:
                keys = self.keys(block)
                order = np.argsort(keys, kind="stable")
                self.push(keys[order], block[order])

    def take(self, key: int) -> np.ndarray | None:
        """The next block of the key returned by least()."""
        fifo = self.levels[-1].get(key)
        block = fifo.pop() if fifo else None
        if block is None:
            self.levels[-1].pop(key, None)
        return block


class Minima:
    """Per symbol, the least prefix length since a tuple last went to that symbol's bucket."""

    def __init__(self, symbols: int, depth: int):
        self.depth = depth
        self.since = np.zeros(symbols, dtype=np.uint8)

    def induced(self, gaps: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Prefix lengths of tuples induced at indexes `at` of a scanned block with those gaps; (keys, at) is sorted."""
        n = len(gaps)
        table = [gaps]
        while 1 << len(table) <= n:
            last, half = table[-1], 1 << (len(table) - 1)
            table.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[-half:]]))
        stacked = np.stack(table)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        begin = np.where(new, 0, np.concatenate([[0], at[:-1] + 1]))
        level = np.frexp((at - begin + 1).astype(np.float64))[1] - 1
        least = np.minimum(stacked[level, begin], stacked[level, at - (1 << level) + 1])
        least[new] = np.minimum(least[new], self.since[keys[new]])
        last = np.flatnonzero(np.concatenate([new[1:], [True]]))
        self.passed(gaps)
        behind = np.concatenate([np.minimum.accumulate(gaps[::-1])[::-1], [self.depth]])
        self.since[keys[last]] = behind[at[last] + 1]
        return np.minimum(least.astype(np.int64) + 1, self.depth).astype(np.uint8)

    def passed(self, gaps: np.ndarray) -> None:
        np.minimum(self.since, gaps.min(), out=self.since)


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, packed: np.ndarray | None = None) -> np.ndarray:
    """Common prefix lengths, up to depth, of pairs of different suffixes. packed: four_at_once(text), for many pairs."""
    out, n = np.zeros(len(a), dtype=np.uint8), len(text)
    live = np.arange(len(a))
    if packed is not None:
        for k in range(0, depth, 4):
            x, y = np.minimum(a[live] + k, n), np.minimum(b[live] + k, n)
            differ = packed[x] ^ packed[y]
            equal = np.where(differ == 0, 4, np.frexp((differ & (~differ + np.uint64(1))).astype(np.float64))[1] - 1 >> 4)
            out[live] = np.minimum(k + equal, depth)
            live = live[differ == 0]
            if not len(live):
                break
        return out
    for k in range(depth):
        x, y = a[live] + k, b[live] + k
        inside = (x < n) & (y < n)
        same = inside.copy()
        same[inside] = text[x[inside]] == text[y[inside]]
        live = live[same]
        if not len(live):
            break
        out[live] = k + 1
    return out


def four_at_once(text: np.ndarray) -> np.ndarray | None:
    """Four 16-bit symbols at each position as one number; behind the end stands a symbol that no text has."""
    if text.dtype != np.uint16:
        return None
    padded = np.concatenate([text, np.full(4, 0xFFFF, dtype=np.uint16)]).astype(np.uint64)
    return padded[:-3] | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(32) | padded[3:] << np.uint64(48)


def _tuples(at: np.ndarray, lcp: np.ndarray | int) -> np.ndarray:
    block = np.empty(len(at), dtype=_TUPLE)
    block["at"], block["lcp"] = at, lcp
    return block


def _induce(text: np.ndarray, symbols: int, seeds: Fifo, pool: Pool, lcps: bool) -> Iterator[np.ndarray]:
    """All suffixes in descending order, as blocks of (position, common prefix with the suffix before, which is larger).

    seeds: LMS positions, sorted by first symbol, with the common prefix of each with the one before it.
    """

    def scan(block: np.ndarray, symbol: int, queue: RadixQueue, minima: Minima | None, reach: int) -> None:
        """Induce the tuples before those of a block whose symbol is at least (or at most) `reach`."""
        source = np.flatnonzero(block["at"] > 0)
        before = block["at"][source] - 1
        found = text[before].astype(np.int64)
        fits = found >= reach if queue.sign > 0 else found <= reach
        source, before, found = source[fits], before[fits], found[fits]
        if not len(source):
            if minima:
                minima.passed(block["lcp"])
            return
        keys = found if queue.sign > 0 else symbols - 1 - found
        order = np.argsort(keys.astype(np.uint16) if symbols <= 1 << 16 else keys, kind="stable")
        source, before, keys = source[order], before[order], keys[order]
        queue.push(keys, _tuples(before, minima.induced(block["lcp"], source, keys) if minima else 0))

    def edge(block: np.ndarray, before: int | None) -> None:
        """Set the first tuple's prefix with the tuple scanned before it, which came from another queue."""
        if lcps:
            block["lcp"][0] = 0 if before is None else common(text, np.array([before]), block["at"][:1], pool.depth)[0]

    # Ascending: L suffixes from the LMS suffixes.
    queue, minima, found = RadixQueue(pool, symbols, text, 1), Minima(symbols, pool.depth) if lcps else None, Fifo(pool)
    last_symbol = int(text[-1])
    queue.push_one(last_symbol, _tuples(np.array([len(text) - 1]), 0))
    seed = seeds.pop()
    last: int | None = None
    while True:
        symbol, seed_symbol = queue.least(), int(text[seed["at"][0]]) if seed is not None else None
        if symbol is None and seed_symbol is None:
            break
        if symbol is not None and (seed_symbol is None or symbol <= seed_symbol):
            fresh = True
            while (block := queue.take(symbol)) is not None:
                if fresh:
                    edge(block, last)
                fresh, last = False, int(block["at"][-1])
                found.push(block)
                scan(block, symbol, queue, minima, symbol)
            continue
        fresh = True
        while seed is not None and int(text[seed["at"][0]]) == seed_symbol:
            size = int(np.searchsorted(text[seed["at"]], seed_symbol, side="right"))
            block, rest = seed[:size].copy(), seed[size:]
            if fresh:
                edge(block, last)
            fresh, last = False, int(block["at"][-1])
            scan(block, seed_symbol, queue, minima, seed_symbol + 1)
            seed = rest if len(rest) else seeds.pop()
    # Descending: S suffixes from the L suffixes.
    queue, minima, last = RadixQueue(pool, symbols, text, -1), Minima(symbols, pool.depth) if lcps else None, None
    block, carried = found.pop(newest=True), 0
    larger = None if block is None else _reversed(block)
    while True:
        key = queue.least()
        symbol = None if key is None else symbols - 1 - key
        other = None if larger is None else int(text[larger["at"][0]])
        if symbol is None and other is None:
            return
        if symbol is not None and (other is None or symbol >= other):
            fresh = True
            while (block := queue.take(key)) is not None:
                if fresh:
                    edge(block, last)
                fresh, last = False, int(block["at"][-1])
                yield block
                scan(block, symbol, queue, minima, symbol)
            continue
        fresh = True
        while larger is not None and int(text[larger["at"][0]]) == other:
            size = int(np.searchsorted(-text[larger["at"]].astype(np.int64), -other, side="right"))
            block, rest = larger[:size].copy(), larger[size:]
            if fresh:
                edge(block, last)
            fresh, last = False, int(block["at"][-1])
            yield block
            scan(block, other, queue, minima, other - 1)
            if not len(rest):
                carried = int(larger["next"][-1]) if "next" in (larger.dtype.names or ()) else 0
                more = found.pop(newest=True)
                rest = None if more is None else _reversed(more, carried)
            larger = rest


_REVERSED = np.dtype([("at", np.int64), ("lcp", np.uint8), ("next", np.uint8)])


def _reversed(block: np.ndarray, before: int = 0) -> np.ndarray:
    """An ascending block backwards: lcp is with the larger neighbour, next with the smaller one."""
    out = np.empty(len(block), dtype=_REVERSED)
    out["at"], out["next"] = block["at"][::-1], block["lcp"][::-1]
    out["lcp"][1:] = out["next"][:-1]
    out["lcp"][0] = before
    return out


def _lms(text: np.ndarray) -> np.ndarray:
    """Positions of S suffixes that follow an L suffix."""
    n = len(text)
    step = np.full(n, -1, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    known = np.where(step != 0, np.arange(n), n - 1)
    known = np.minimum.accumulate(known[::-1])[::-1]
    small = step[known] > 0
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _named(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, from their sorted order, and how many names there are."""
    ends = np.concatenate([lms[1:] + 1, [len(text)]])
    base = np.uint64(0x9E3779B97F4A7C15)
    powers = np.cumprod(np.full(len(text) + 1, base, dtype=np.uint64))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * powers[:-1])])
    size = ends - lms
    # Shifted to a common power instead of divided by one.
    shift = powers[len(text) - lms]
    digest = (prefix[ends] - prefix[lms]) * shift
    number = np.empty(len(text), dtype=np.int64)
    number[lms] = np.arange(len(lms))
    rank_of = number[order]
    d, s = digest[rank_of], size[rank_of]
    fresh = np.concatenate([[0], np.cumsum((d[1:] != d[:-1]) | (s[1:] != s[:-1]))])
    names = np.empty(len(lms), dtype=np.int32 if len(lms) < 1 << 31 else np.int64)
    names[rank_of] = fresh
    return names, int(fresh[-1]) + 1


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a string of names by prefix doubling, until names or depth are exhausted.

    A suffix's rank is the place of its group in the order; only groups of several suffixes are sorted again.
    """
    n, reach = len(names), 1
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    live = order
    same = np.concatenate([[False], names[order][1:] == names[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    while True:
        tied = same.copy()
        tied[:-1] |= same[1:]
        live = live[tied]
        if not len(live) or reach >= depth or reach >= n:
            return order
        ahead = np.where(live + reach < n, rank[np.minimum(live + reach, n - 1)] + 1, 0)
        group = rank[live]
        by = np.argsort(group * (n + 1) + ahead)
        live, ahead, group = live[by], ahead[by], group[by]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        same = np.concatenate([[False], (ahead[1:] == ahead[:-1]) & ~first[1:]])
        at = np.arange(len(live))
        start = np.maximum.accumulate(np.where(first, at, 0))
        place = group + at - start
        order[place] = live
        rank[live] = place[np.maximum.accumulate(np.where(same, 0, at))]
        reach *= 2


def _sorted_lms(text: np.ndarray, symbols: int, pool: Pool) -> np.ndarray:
    """LMS positions in suffix order."""
    lms = _lms(text)
    if len(lms) < 2:
        return lms
    seeds = Fifo(pool)
    for part in np.array_split(lms[np.argsort(text[lms], kind="stable")], -(-len(lms) // pool.block)):
        seeds.push(_tuples(part, 0))
    is_lms = np.zeros(len(text), dtype=bool)
    is_lms[lms] = True
    order = np.concatenate([b["at"][is_lms[b["at"]]] for b in _induce(text, symbols, seeds, pool, False)])[::-1]
    names, count = _named(text, lms, order)
    if count == len(lms):
        return order
    if len(names) <= pool.base:
        return lms[_doubled(names, pool.depth)]
    return lms[np.concatenate([b["at"] for b in _suffixes(names, count, pool, False)])[::-1]]


def _suffixes(text: np.ndarray, symbols: int, pool: Pool, lcps: bool) -> Iterator[np.ndarray]:
    order = _sorted_lms(text, symbols, pool)
    lcp = np.zeros(len(order), dtype=np.uint8)
    if lcps and len(order) > 1:
        lcp[1:] = common(text, order[:-1], order[1:], pool.depth, four_at_once(text))
    seeds = Fifo(pool)
    for part in np.array_split(np.arange(len(order)), -(-len(order) // pool.block)) if len(order) else []:
        seeds.push(_tuples(order[part], lcp[part]))
    yield from _induce(text, symbols, seeds, pool, lcps)


def suffixes(text: np.ndarray, symbols: int, pool: Pool | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, common prefix with the suffix before) over all suffixes in descending order.

    text holds symbols below `symbols`; prefix lengths stop at the pool's depth. An empty text has no suffixes.
    """
    pool = pool or Pool()
    try:
        if len(text):
            for block in _suffixes(text, symbols, pool, True):
                yield block["at"].copy(), block["lcp"].copy()
    finally:
        pool.close()
