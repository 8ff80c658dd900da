"""Alignment of two token streams by longest matching blocks, spread over tasks.

A pair of streams begins as one rectangle. In rounds, rectangles of over LOCAL_TOKENS are split at their longest blocks, a few
levels a round, and dealt out anew with only the tokens of their own stretches; once all are small, each task splits many of
them to the end together. What has no common block is a region where the streams differ. Only the first round of a pair sees
all its tokens in one place, as one row.

Ties between blocks of one length go to the first in the base, then in the other. A stream that is missing or empty makes one
region of the whole of the other; two empty ones make none and have ratio 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import blocks
from tidemark.functions import text as tx
from tidemark.operators.sequence import KEY
from tidemark.operators.stages import stored

#: Tokens of a rectangle that one task may split to the end, levels that a large one is split at a time, signs of one step.
LOCAL_TOKENS, SPLIT_LEVELS, STEP_SIGNS = 60_000, 4, 120_000
_PIECE = "is_open boolean, a_at long, b_at long, a array<string>, b array<string>, times array<double>"


def _steps(sizes: list[int] | np.ndarray, most: int) -> list[tuple[int, int]]:
    """Where to cut so that the sizes of a step add up to about so much at most, unless one alone is larger."""
    steps = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=-1)).tolist() + [len(sizes)]
    return list(zip(steps, steps[1:], strict=False))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the signs in matching blocks over all signs of two texts; all pairs of a step are matched at once."""
    pairs = list(zip(a, b, strict=True))
    return pd.Series([r for lo, hi in _steps([len(x) + len(y) for x, y in pairs], STEP_SIGNS) for r in blocks.ratios(pairs[lo:hi]).tolist()], dtype="float64")


#: Bins that signs are counted in, signs (and bins) that are counted at a time, signs of the longest text that is read for an order.
SIGN_BINS, COUNT_SIGNS, ORDER_SIGNS = 256, 2_000_000, 100_000


def _signs(texts: list[str]) -> np.ndarray:
    """How many signs of each text fall into each bin."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % SIGN_BINS
    first = np.repeat(np.arange(len(texts)) * SIGN_BINS, [len(t) for t in texts])
    return np.bincount(first + codes, minlength=len(texts) * SIGN_BINS).reshape(len(texts), SIGN_BINS)


def may_reach(pairs: list[tuple[str, str]], ratio: float) -> np.ndarray:
    """False only for pairs whose similarity() is surely less than the ratio.

    Matching blocks follow each other in both texts, so they hold no more signs than both texts share in one order, and these
    are no more than they share in any order, which is counted first. Pairs with longer texts than ORDER_SIGNS, for which the
    order would take longer than the blocks, are only counted.
    """
    n = np.asarray([len(a) + len(b) for a, b in pairs], dtype=np.int64)
    least = np.ceil(ratio * n / 2 - 1e-6)
    out = np.ones(len(pairs), dtype=bool)
    for lo, hi in _steps(n + SIGN_BINS, COUNT_SIGNS):
        number: dict[str, int] = {}
        at = np.asarray([[number.setdefault(t, len(number)) for t in p] for p in pairs[lo:hi]])
        counts = _signs(list(number))
        out[lo:hi] = np.minimum(counts[at[:, 0]], counts[at[:, 1]]).sum(axis=1) >= least[lo:hi]
    held, of = {}, ""
    for k in np.flatnonzero(out).tolist():
        a, b = pairs[k]
        if max(len(a), len(b)) <= ORDER_SIGNS:
            # A row is met by several before it, one after the other.
            if a != of:
                held, of = blocks.places(a), a
            out[k] = blocks.share_in_order(held, len(a), b, int(least[k]))
    return out


def similarity_from(ratio: float):
    """similarity(), but 0 for pairs that surely stay below the ratio; these are not matched, nor are equal texts (1)."""

    @F.pandas_udf(T.DoubleType())
    def found(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b, strict=True))
        out = np.zeros(len(pairs))
        same = np.asarray([x == y for x, y in pairs], dtype=bool)
        out[same] = 1.0
        at = np.flatnonzero(~same)
        at = at[may_reach([pairs[k] for k in at], ratio)]
        if len(at):
            out[at] = similarity.func(pd.Series([pairs[k][0] for k in at]), pd.Series([pairs[k][1] for k in at]))
        return pd.Series(out)

    return found


def streams(segments: DataFrame) -> DataFrame:
    """(recording_id, words, times): a rendering's tokens in order, the time of each, and at the end the last time again."""
    told = segments.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("start_s", "ord", tx.tokens("text").alias("words")))).alias("s"))
    words = F.flatten(F.transform(F.filter("s", lambda s: s["words"].isNotNull()), lambda s: s["words"]))
    times = F.flatten(F.transform(F.filter("s", lambda s: s["words"].isNotNull()), lambda s: F.array_repeat(s["start_s"], F.size(s["words"]))))
    last = F.when(F.size(times) > 0, F.get(times, F.size(times) - 1)).otherwise(0.0)
    return told.select(KEY, words.alias("words"), F.concat(times, F.array(last)).alias("times"))


def _pieces(keys: list, rows: list[tuple], rects: np.ndarray, is_open: bool) -> dict[str, list]:
    """Stretches of rows (a_at, b_at, a, b, times) as rows of their own."""
    out: dict[str, list] = {c: [] for c in ("key", "is_open", "a_at", "b_at", "a", "b", "times")}
    for owner, a0, a1, b0, b1 in rects.tolist():
        a_at, b_at, a, b, times = rows[owner]
        for c, v in zip(out, (keys[owner], is_open, a_at + a0, b_at + b0, a[a0:a1], b[b0:b1], times[a0 : a1 + 1]), strict=True):
            out[c].append(v)
    return out


def _splitter(levels: int | None, small: int):
    """Splits rows (key, is_open, a_at, b_at, a, b, times): open stretches stay open until they have no common block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = total = 0
            sizes = (np.asarray(batch.column(4).value_lengths()) + np.asarray(batch.column(5).value_lengths())).tolist()
            for k, size in enumerate([*sizes, STEP_SIGNS + 1]):
                if k > start and total + size > STEP_SIGNS:
                    yield from split(batch.slice(start, k - start))
                    start, total = k, 0
                total += size

    def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, rows = batch.column(0).to_pylist(), list(zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True))
        a, b = blocks.numbered([w for r in rows for w in r[2]], [w for r in rows for w in r[3]])
        ends = [np.concatenate([[0], np.cumsum([len(r[k]) for r in rows])]).astype(np.int64) for k in (2, 3)]
        whole = np.stack([np.arange(len(rows)), ends[0][:-1], ends[0][1:], ends[1][:-1], ends[1][1:]], axis=1)
        for found, is_open in zip(blocks.split(a, b, whole, levels, small), (True, False), strict=True):
            found[:, 1:3] -= ends[0][found[:, 0]][:, None]
            found[:, 3:5] -= ends[1][found[:, 0]][:, None]
            piece = _pieces(keys, rows, found, is_open)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(piece.values(), batch.schema, strict=True)], schema=batch.schema)

    return run


def paired(base: DataFrame, other: DataFrame) -> DataFrame:
    """One open rectangle for each recording that either rendering has."""
    both = streams(base).join(streams(other).select(KEY, F.col("words").alias("b")), KEY, "full")
    none = F.array().cast("array<string>")
    return both.select(KEY, F.lit(True).alias("is_open"), F.lit(0).cast("long").alias("a_at"), F.lit(0).cast("long").alias("b_at"), F.coalesce("words", none).alias("a"), F.coalesce("b", none).alias("b"), F.coalesce("times", F.array(F.lit(0.0))).alias("times"))


def _size() -> Column:
    return F.size("a") + F.size("b")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), KEY, "a_at", "b_at")


def opened(pairs: DataFrame, local: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(open, closed): paired() rows cut until no open one has more than local tokens, and what turned out to share nothing."""
    schema, closed = f"{KEY} {pairs.schema[KEY].dataType.simpleString()}, {_PIECE}", []
    large = _size() > (local or LOCAL_TOKENS)
    while pairs.where(large).limit(1).count():
        cut = _dealt(pairs.where(large)).mapInArrow(_splitter(SPLIT_LEVELS, local or LOCAL_TOKENS), schema)
        rows = stored(pairs.where(~large).unionByName(cut))
        closed.append(rows.where("not is_open"))
        pairs = rows.where("is_open")
    return pairs, closed


def differences(pairs: DataFrame, local: int | None = None) -> DataFrame:
    """The stretches of paired() rows that have nothing in common, as rows with is_open false."""
    rows, closed = opened(pairs, local)
    found = _dealt(rows).mapInArrow(_splitter(None, 0), rows.schema).where("not is_open")
    for part in closed:
        found = found.unionByName(part)
    return found


def _told(found: DataFrame) -> DataFrame:
    tag = F.when((F.size("a") > 0) & (F.size("b") > 0), "replace").when(F.size("a") > 0, "delete").otherwise("insert")
    return found.select(KEY, "a_at", "b_at", tag.alias("tag"), F.get("times", F.lit(0)).alias("at_s"), F.greatest(F.size("a"), F.size("b")).cast("long").alias("size"), "a", "b", tx.is_salient(F.concat("a", "b")).alias("is_salient"))


def align(base: DataFrame, other: DataFrame, least: int = 3) -> DataFrame:
    """(recording_id, ratio, regions, substantial, salient): token alignment of two renderings of each recording."""
    pairs = stored(paired(base, other))
    counted = _told(differences(pairs)).groupBy(KEY).agg(
        F.count("*").alias("regions"), F.count_if(F.col("size") >= least).alias("substantial"), F.count_if("is_salient").alias("salient"), F.sum(F.size("a")).alias("unmatched")
    )
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    words = F.col("n_a") + F.col("n_b")
    ratio = F.when(words > 0, 2.0 * (F.col("n_a") - none("unmatched")) / words).otherwise(1.0)
    return pairs.select(KEY, F.size("a").alias("n_a"), F.size("b").alias("n_b")).join(counted, KEY, "left").select(KEY, ratio.alias("ratio"), none("regions").alias("regions"), none("substantial").alias("substantial"), none("salient").alias("salient"))


def regions(base: DataFrame, other: DataFrame, least: int = 3) -> DataFrame:
    """(recording_id, rank, tag, at_s, size, base, other, is_salient) where two renderings differ, as align() counts them.

    Small regions count only if they are salient; salient ones come first, then by size, then as they stand. at_s is the
    base's time.
    """
    shown = _told(differences(stored(paired(base, other)))).where((F.col("size") >= least) | F.col("is_salient"))
    order = Window.partitionBy(KEY).orderBy(F.desc("is_salient"), F.desc("size"), "a_at", "b_at")
    rank = (F.row_number().over(order) - 1).cast("long")
    return shown.select(KEY, rank.alias("rank"), "tag", "at_s", "size", F.array_join("a", " ").alias("base"), F.array_join("b", " ").alias("other"), "is_salient")


#: Fixed value: lines that a hunk shows around what changed.
CONTEXT = 3


def _span(start: int, size: int) -> str:
    return f"{start + (size > 0)}" + ("" if size == 1 else f",{size}")


def _hunks(a: list[str], b: list[str], changed: list[list[int]]) -> str:
    """The unified difference of lines, from the stretches (a0, a1, b0, b1) that have nothing in common."""
    groups: list[list[list[int]]] = []
    for c in sorted(changed):
        if groups and c[0] - groups[-1][-1][1] <= 2 * CONTEXT:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = ["--- before\n", "+++ after\n"] if groups else []
    for group in groups:
        lead, tail = min(CONTEXT, group[0][0], group[0][2]), min(CONTEXT, len(a) - group[-1][1], len(b) - group[-1][3])
        a0, a1, b0, b1 = group[0][0] - lead, group[-1][1] + tail, group[0][2] - lead, group[-1][3] + tail
        out.append(f"@@ -{_span(a0, a1 - a0)} +{_span(b0, b1 - b0)} @@\n")
        for c in group:
            out += [" " + x for x in a[a0 : c[0]]] + ["-" + x for x in a[c[0] : c[1]]] + ["+" + x for x in b[c[2] : c[3]]]
            a0 = c[1]
        out += [" " + x for x in a[a0:a1]]
    return "".join(out)


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """The unified difference of two texts by their lines, empty where they are equal; a batch's texts are matched at once."""
    pairs = [((x or "").splitlines(keepends=True), (y or "").splitlines(keepends=True)) for x, y in zip(old, new, strict=True)]
    a, b = blocks.numbered([x for p in pairs for x in p[0]], [y for p in pairs for y in p[1]])
    ends = [np.concatenate([[0], np.cumsum([len(p[k]) for p in pairs])]).astype(np.int64) for k in (0, 1)]
    _, left = blocks.split(a, b, np.stack([np.arange(len(pairs)), ends[0][:-1], ends[0][1:], ends[1][:-1], ends[1][1:]], axis=1))
    changed: list[list[list[int]]] = [[] for _ in pairs]
    for owner, a0, a1, b0, b1 in left.tolist():
        changed[owner].append([a0 - int(ends[0][owner]), a1 - int(ends[0][owner]), b0 - int(ends[1][owner]), b1 - int(ends[1][owner])])
    return pd.Series([_hunks(*p, c) for p, c in zip(pairs, changed, strict=True)], dtype="object")
