"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups (equal texts) are ordered by a 64-bit hash and never divided. The smallest shard capacity for which a greedy pass
over the ordered group sizes needs at most n_shards shards is found by binary search; the greedy cuts at that capacity
are the shards. Law: `bytes`.

No task or driver sees all groups. The driver holds sums of hash-prefix segments only; segments near a possible cut are
split by more hash bits, level by level, until only single groups are left there, and then the search is exact. Each
level brings at most LEVEL_SEGMENTS sums per round of splitting. Slots come from a range partition of the rows, so a
group of a third of all rows is spread over many tasks.

Cases: null text counts as empty; an empty table gives an empty result; a group larger than total / n_shards makes that
group's size the capacity; fewer groups than shards leave later shards empty; repeated rows get slots of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, clean_text

FIRST_BITS, STEP_BITS = 12, 6
LEVEL_SEGMENTS = 200_000
#: Added to a signed hash so that its order is that of an unsigned one.
_TOP = 1 << 63


def _position(h: int, bits: int) -> int:
    return (h + _TOP) >> (64 - bits)


def _prefix(h: Column, bits: int) -> Column:
    """The leading bits of a hash as an unsigned number, in the order of the signed hash."""
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(-_TOP)), 64 - bits)


class Segments:
    """Consecutive runs of groups: bytes, largest group, number of groups, leading bits of their hashes."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        rows = sorted(rows, key=lambda r: r[1] << (64 - r[0]))
        self.rows = rows
        self.sums = np.asarray([r[2] for r in rows], dtype=np.int64)
        self.largest = np.asarray([r[3] for r in rows], dtype=np.int64)
        self.groups = np.asarray([r[4] for r in rows], dtype=np.int64)
        self.ends = np.cumsum(self.sums)

    def cuts(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy ends (segment counts) with each segment whole, or None if shards don't suffice."""
        if len(self.sums) and capacity < self.sums.max():
            return None
        ends, at, base = [], 0, 0
        for _ in range(shards):
            at = int(np.searchsorted(self.ends, base + capacity, side="right"))
            ends.append(at)
            base = int(self.ends[at - 1]) if at else 0
            if at == len(self.ends):
                return ends + [at] * (shards - len(ends))
        return None

    def smallest(self, shards: int) -> int:
        low, high = max(-(-int(self.ends[-1]) // shards), int(self.sums.max())), int(self.ends[-1])
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.cuts(middle, shards) else (middle + 1, high)
        return low

    def unsettled(self, shards: int) -> list[int]:
        """Segments of several groups in which a greedy cut of some capacity still possible may fall."""
        high = self.smallest(shards)
        low = max(-(-int(self.ends[-1]) // shards), int(self.largest.max()))
        many = self.groups > 1
        out = many & (self.sums > low)
        least = 0
        for k in range(1, shards + 1):
            first = int(np.searchsorted(self.ends, least + low, side="right"))
            last = int(np.searchsorted(self.ends, k * high, side="right"))
            out[first : last + 1] |= many[first : last + 1]
            least = int(self.ends[first - 1]) if first else 0
        return np.flatnonzero(out).tolist()


def boundaries(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Capacity, and the (unsigned) hash at which each shard after the first begins, of (h, bytes) groups."""

    def sums(bits: int, within: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        kept = groups
        if within:
            wide = within[0][0]
            wanted = groups.sparkSession.createDataFrame([(p,) for _, p in within], "wide long")
            kept = groups.withColumn("wide", _prefix(F.col("h"), wide)).join(F.broadcast(wanted), "wide", "left_semi")
        found = kept.groupBy(_prefix(F.col("h"), bits).alias("p")).agg(F.sum("bytes"), F.max("bytes"), F.count("*")).collect()
        return [(bits, int(p) & ((1 << bits) - 1), int(s), int(m), int(n)) for p, s, m, n in found]

    segments = Segments(sums(FIRST_BITS, []))
    if not segments.rows:
        return 0, []
    while todo := segments.unsettled(shards):
        chosen = set(todo)
        rows = [r for k, r in enumerate(segments.rows) if k not in chosen]
        for bits in sorted({segments.rows[k][0] for k in todo}):
            own = [segments.rows[k] for k in todo if segments.rows[k][0] == bits]
            deeper = min(60, bits + STEP_BITS if sum(r[4] for r in own) > LEVEL_SEGMENTS else 60)
            rows += sums(deeper, [(r[0], r[1]) for r in own]) if bits < 60 else [(*r[:4], 1) for r in own]
        segments = Segments(rows)
    capacity = segments.smallest(shards)
    starts = []
    for end in segments.cuts(capacity, shards)[: shards - 1]:
        row = segments.rows[end] if end < len(segments.rows) else None
        starts.append(row[1] << (64 - row[0]) if row else 1 << 64)
    return capacity, starts


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of (doc_id, text)."""
    text = clean_text("text")
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    # Rows of a group lie together, and a large group is spread over several partitions, since doc_id orders it too.
    # Groups are runs of equal hash: equal texts always share one; the length and crc32 only order texts within it.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpointed(rows.repartitionByRange(n, "h", "size", "text_crc32", "doc_id").sortWithinPartitions("h", "size", "text_crc32", "doc_id"))
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes"))
    _, starts = boundaries(groups, shards)
    own = sum(((F.col("h") >= F.lit(s - _TOP)).cast("int") for s in starts if s < 1 << 64), F.lit(0))
    # The row's number in its partition is in the lower 33 bits of this id; the partition's number is above them.
    numbered = rows.select("*", own.cast("int").alias("shard"), F.monotonically_increasing_id().alias("at"))
    numbered = numbered.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("local"))
    pieces = numbered.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("local").alias("first")).collect()
    offsets, seen = [], {}
    for shard_no, part, count, first in sorted(map(tuple, pieces)):
        offsets.append((shard_no, part, seen.get(shard_no, 0) - first))
        seen[shard_no] = seen.get(shard_no, 0) + count
    table = docs.sparkSession.createDataFrame(offsets, "shard int, part long, shift long")
    out = numbered.join(F.broadcast(table), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("local") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
