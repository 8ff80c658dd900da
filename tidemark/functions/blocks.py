"""Longest matching blocks of sequences, for many pairs at once.

A rectangle is a stretch of one sequence against a stretch of another. Its longest common block (of several the first in the
one sequence, then in the other) splits it in two, before and after; stretches without a common block remain. All open
rectangles of a level are split together: their stretches lie in one array, ended by marks that occur once, whose suffixes are
ranked by doubling. Neighbours in rank order have the longest common prefixes, so one pass over them finds every rectangle's
block. Everything is vectorised; nothing is done rectangle by rectangle.
"""

from __future__ import annotations

import numpy as np

#: Columns of rectangles: a number that stays with them, and both stretches.
OWNER, A0, A1, B0, B1 = range(5)
#: Signs after which share_in_order() looks whether so many can still be reached.
LOOK_SIGNS = 64


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all stretches, one stretch after another."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def _ranks(text: np.ndarray, rect: np.ndarray, side: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their next 1, 2, 4, ... signs, until no rectangle's sides share so many. Marks are negative."""
    size = len(text)
    levels = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    while True:
        step = 1 << (len(levels) - 1)
        held = levels[-1]
        # A rectangle's sides share this many signs if some rank of it occurs on both.
        key = rect * size + held
        order = np.argsort(key, kind="stable")
        same = (key[order][1:] == key[order][:-1]) & (side[order][1:] != side[order][:-1])
        if not same.any() or step >= size:
            return levels
        ahead = np.full(size, -1, dtype=np.int64)
        ahead[: size - step] = held[step:]
        levels.append(np.unique(held * (size + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64))


def _common(levels: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many signs the suffixes at p and q share."""
    size, total = len(levels[0]), np.zeros(len(p), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = p + total, q + total
        inside = (x < size) & (y < size)
        equal = np.zeros(len(p), dtype=bool)
        equal[inside] = levels[level][x[inside]] == levels[level][y[inside]]
        total[equal] += 1 << level
    return total


def longest_blocks(a: np.ndarray, b: np.ndarray, rects: np.ndarray) -> np.ndarray:
    """(rects x 3): begin in a, begin in b and length of each rectangle's longest common block; length 0 without one.

    a and b hold signs as numbers of at least zero; rects are rows (owner, a0, a1, b0, b1).
    """
    out = np.zeros((len(rects), 3), dtype=np.int64)
    if not len(rects):
        return out
    # Each rectangle lies as a's stretch, a mark, b's stretch, a mark.
    begin = np.stack([rects[:, A0], np.zeros(len(rects), dtype=np.int64), rects[:, B0], np.zeros(len(rects), dtype=np.int64)], axis=1).ravel()
    width = np.stack([rects[:, A1] - rects[:, A0], np.ones(len(rects), dtype=np.int64), rects[:, B1] - rects[:, B0], np.ones(len(rects), dtype=np.int64)], axis=1).ravel()
    place = _spread(begin, width)
    kind = np.repeat(np.tile(np.arange(4), len(rects)), width)
    rect, side = np.repeat(np.repeat(np.arange(len(rects)), 4), width), kind >> 1
    text = np.empty(len(place), dtype=np.int64)
    text[kind == 0], text[kind == 2] = a[place[kind == 0]], b[place[kind == 2]]
    marks = np.flatnonzero(kind & 1)
    text[marks] = -1 - np.arange(len(marks))
    levels = _ranks(text, rect, side)
    own = np.flatnonzero(~(kind & 1).astype(bool))
    order = own[np.lexsort((levels[-1][own], rect[own]))]
    p, q = order[:-1], order[1:]
    together = rect[p] == rect[q]
    shared = np.where(together, _common(levels, p, q), 0)
    across = np.where(side[p] != side[q], shared, 0)
    best = np.zeros(len(rects), dtype=np.int64)
    np.maximum.at(best, rect[q], across)
    # Neighbours that share the best length of their rectangle form groups, which have one block each.
    starts = np.concatenate([[True], ~together | (shared < np.maximum(best[rect[q]], 1))])
    group = np.cumsum(starts) - 1
    far = np.iinfo(np.int64).max
    first = np.full((int(group[-1]) + 1 if len(group) else 0, 2), far, dtype=np.int64)
    np.minimum.at(first, (group, side[order]), place[order])
    of = rect[order[starts]]
    both = np.flatnonzero((first != far).all(axis=1) & (best[of] > 0))
    both = both[np.lexsort((first[both, 0], of[both]))]
    hit, at = np.unique(of[both], return_index=True)
    out[hit, 0], out[hit, 1], out[hit, 2] = first[both[at], 0], first[both[at], 1], best[hit]
    return out


def split(a: np.ndarray, b: np.ndarray, rects: np.ndarray, levels: int | None = None, small: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(open, left): rectangles after some levels of splitting (all, if None), and those that have no common block.

    With small, splitting ends where no rectangle has more signs than that. What is left has no empty rectangles.
    """
    left = [np.zeros((0, 5), dtype=np.int64)]
    while len(rects):
        sizes = rects[:, A1] - rects[:, A0], rects[:, B1] - rects[:, B0]
        one_sided = (sizes[0] == 0) | (sizes[1] == 0)
        left.append(rects[one_sided & (sizes[0] + sizes[1] > 0)])
        rects = rects[~one_sided]
        if levels == 0 or (small and not ((rects[:, A1] - rects[:, A0] + rects[:, B1] - rects[:, B0]) > small).any()):
            break
        found = longest_blocks(a, b, rects)
        none = found[:, 2] == 0
        left.append(rects[none])
        rects, found = rects[~none], found[~none]
        before = np.stack([rects[:, OWNER], rects[:, A0], found[:, 0], rects[:, B0], found[:, 1]], axis=1)
        after = np.stack([rects[:, OWNER], found[:, 0] + found[:, 2], rects[:, A1], found[:, 1] + found[:, 2], rects[:, B1]], axis=1)
        rects = np.concatenate([before, after])
        levels = None if levels is None else levels - 1
    return rects, np.concatenate(left)


def numbered(*lists: list) -> list[np.ndarray]:
    """Each list with its elements as numbers; equal elements have equal numbers in all lists."""
    number: dict = {}
    return [np.asarray([number.setdefault(x, len(number)) for x in one], dtype=np.int64) for one in lists]


def ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Twice the matched signs over all signs of each pair of texts; 1 for two empty ones."""
    a, b = numbered("".join(x for x, _ in pairs), "".join(y for _, y in pairs))
    one, other = (np.asarray([len(p[k]) for p in pairs], dtype=np.int64) for k in (0, 1))
    ends = np.cumsum(one), np.cumsum(other)
    _, left = split(a, b, np.stack([np.arange(len(pairs)), ends[0] - one, ends[0], ends[1] - other, ends[1]], axis=1))
    unmatched = np.bincount(left[:, OWNER], weights=left[:, A1] - left[:, A0], minlength=len(pairs))
    return np.where(one + other > 0, 2.0 * (one - unmatched) / np.maximum(one + other, 1), 1.0)


def places(text: str) -> dict[str, int]:
    """The places of each sign of a text, as bits of a number."""
    out, place = dict.fromkeys(text, 0), 1
    for c in text:
        out[c] |= place
        place <<= 1
    return out


def share_in_order(held: dict[str, int], size: int, other: str, least: int) -> bool:
    """Whether a text of size signs, given by its places(), and another one have a common subsequence of at least so many signs.

    The zeros among the first k bits of open_ are the longest one of the text's first k signs and what was read of the other.
    If least are shared, at most spare of the text are not, so those shared with what was read lie in its first read + spare.
    """
    if min(size, len(other)) < least:
        return False
    open_ = whole = (1 << size) - 1
    spare, unshared = size - least, len(other) - least
    for lo in range(0, len(other), LOOK_SIGNS):
        part = other[lo : lo + LOOK_SIGNS]
        for c in part:
            hit = open_ & held.get(c, 0)
            if hit:
                open_ = (open_ + hit) | (open_ - hit)
        open_ &= whole
        read = lo + len(part)
        first = min(size, read + spare)
        if read - (first - (open_ & ((1 << first) - 1)).bit_count()) > unshared:
            return False
    return True
