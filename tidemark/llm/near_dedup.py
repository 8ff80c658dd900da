"""Near-duplicate components by MinHash with tensored banding, every link verified on full shingle sets.

A document is its set of distinct 5-word shingles. Two collections of COLLECTION sub-hashes (ROWS minimum hashes each)
are computed; each pair of one sub-hash from either collection is a table key, so COLLECTION ** 2 tables of 2 * ROWS rows
cost 2 * COLLECTION * ROWS minimum hashes only. At a similarity of 0.75 a link is missed with probability below 3.1e-4,
at 0.8 below 2.1e-5, at 0.9 below 1e-9.

Documents with equal sets are one class from the start. Table keys that several classes share are compared in rounds: in
each, every class meets one leader of its keys, links are verified, and keys whose members are connected by then are done.
After ROUNDS of these (whose leaders differ), classes of different components that share a key meet in blocks of a bounded
size, two blocks at a time (never two of one component). A block is one row, so joins take rows by blocks and by classes, not
for each class and meeting; no pair leaves a task before it is known to be a link, and a link is lost only where no table
brings its ends together. No partner is dropped by number. Signatures of WIDE two-bit minimum hashes stop pairs that
they put far below the threshold (6 standard deviations: one link in 10^9) before their texts are fetched; all others are
decided by the exact condition 100 * |A and B| >= 75 * |A or B|.

Cases: null or empty texts have no shingles and no links; texts under five words are one shingle of all their words;
rows with a null doc_id are kept, unlinked, with a null component; rows that share a doc_id are one node of the graph, so all
its texts and what they link with are one component; repeated rows share a result; texts of any length are read whole; an
empty table gives no row; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import MANY, SLICE_CHARS, IdFilter, at_most, checkpointed, clean_text, mix64, record_batch, release, span_hashes, tasks_for, text_slices, trim

WORDS = 5
PERCENT = 75
COLLECTION, ROWS = 16, 3
HASHES = 2 * COLLECTION * ROWS
ROUNDS = 2
#: Two-bit hashes of a wide signature. Two sets agree in a quarter of them by chance.
WIDE = 512
_CHANCE = 0.25 + 0.75 * PERCENT / 100
LEAST_AGREEING = int(WIDE * _CHANCE - 6 * (WIDE * _CHANCE * (1 - _CHANCE)) ** 0.5)
#: Texts that meet in one group of comparisons: members of a star, and of either of two parts of a family.
STAR_CHUNK = 200
FAMILY_BLOCK = 128
#: Parts whose signatures are one block.
BLOCK_PARTS = 8
EDGES_A_TASK = 100_000
#: Exchanges of fewer rows than this for each of their partitions are read by fewer tasks.
ROWS_A_TASK = 4000
#: Values that a product of membership matrices takes at a time.
MATRIX_COLUMNS = 1 << 15
_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(31))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = mix64(np.arange(HASHES + WIDE, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
_ADD = mix64(np.arange(HASHES + WIDE, dtype=np.uint64) + np.uint64(7700))
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int32()))])
_WIDE = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_HOPEFUL = pa.schema([("g", pa.int64()), ("part", pa.int64()), ("reps", pa.list_(pa.int64()))])


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, text after text, and the number of each text."""
    raw = np.frombuffer(b"".join((t or "").encode("utf-8", "replace") + b"\n" for t in texts), dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    begin = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)
    words = span_hashes(_BYTE[raw], begin, end)
    stops = np.cumsum([len((t or "").encode("utf-8", "replace")) + 1 for t in texts])
    owner = np.searchsorted(stops, begin, side="right")
    per_text = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(per_text) - per_text
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        long_enough = np.arange(max(0, len(words) - WORDS + 1))
        long_enough = long_enough[owner[long_enough] == owner[long_enough + WORDS - 1]] if len(long_enough) else long_enough
        shingle = np.zeros(len(long_enough), dtype=np.uint64)
        for k in range(WORDS):
            shingle = shingle * multiplier + words[long_enough + k]
        short = np.flatnonzero((per_text > 0) & (per_text < WORDS))
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(WORDS - 1):
            more = per_text[short] > k
            whole[more] = whole[more] * multiplier + words[first[short[more]] + k]
        whole += per_text[short].astype(np.uint64)
    value = mix64(np.concatenate([shingle, whole]))
    of = np.concatenate([owner[long_enough], short])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[fresh], np.bincount(of[fresh], minlength=len(texts))


def minimum_hashes(values: np.ndarray, sizes: np.ndarray, which: range) -> np.ndarray:
    """(texts x hashes) mixed minimum hashes of sets as shingle_sets returns them; zero for empty sets."""
    least = np.zeros((len(sizes), len(which)), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        first = (np.cumsum(sizes) - sizes)[some]
        with np.errstate(over="ignore"):
            for at, k in enumerate(which):
                least[some, at] = np.minimum.reduceat(values * _ODD[k] + _ADD[k], first)
    return mix64(least)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_slices(batch):
            values, sizes = shingle_sets(texts)
            some = np.flatnonzero(sizes)
            first = (np.cumsum(sizes) - sizes)[some]
            keys = np.zeros((len(texts), 2), dtype=np.uint64)
            grouped = minimum_hashes(values, sizes, range(HASHES)).reshape(len(texts), 2 * COLLECTION, ROWS)
            with np.errstate(over="ignore"):
                if len(some):
                    keys[some, 0] = np.add.reduceat(values, first)
                    keys[some, 1] = np.add.reduceat(mix64(values ^ np.uint64(0x5555555555555555)), first)
                sub = grouped[:, :, 0].copy()
                for k in range(1, ROWS):
                    sub = mix64(sub * np.uint64(3) + grouped[:, :, k])
            sub = sub.view(np.int64)
            yield record_batch(_SIGNED, {"doc_id": batch.column(0).slice(start, len(texts)), "n": sizes, "k1": keys[:, 0].view(np.int64), "k2": keys[:, 1].view(np.int64), "a": list(sub[:, :COLLECTION]), "b": list(sub[:, COLLECTION:].astype(np.int32))})


def _sign_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_slices(batch):
            values, sizes = shingle_sets(texts)
            two = (minimum_hashes(values, sizes, range(HASHES, HASHES + WIDE)) >> np.uint64(9)).astype(np.uint8) & 3
            packed = two[:, ::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6
            yield record_batch(_WIDE, {"rep": batch.column(0).slice(start, len(texts)), "n": sizes, "sig": [s.tobytes() for s in packed]})


def agreeing(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many of their hashes rows of packed signatures (as 64-bit words) agree."""
    differ = one ^ other
    differ = (differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return WIDE - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64)


def _unpacked(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint64).reshape(-1, WIDE // 32)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2, a, b) of every row: set size, set key, the two sub-hash collections."""
    schema = "doc_id long, n long, k1 long, k2 long, a array<long>, b array<int>"
    return docs.select(F.col("doc_id").cast("long"), clean_text("text").alias("text")).mapInArrow(_sign, schema)


def table_members(classes: DataFrame, tasks: int = MANY) -> DataFrame:
    """(key, rep, least) of the tensored table keys that several classes share; least is the key's smallest class.

    Sub-hashes of the first collection that only one class has can't be part of a shared key and are left out first.
    """
    firsts = classes.select("rep", F.posexplode("a").alias("i", "av"))
    shared = firsts.groupBy("i", "av").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("i", "av")
    company = firsts.join(shared, ["i", "av"]).transform(at_most, tasks).join(classes.select("rep", "b"), "rep").transform(at_most, tasks)
    keys = company.select("rep", "i", "av", F.posexplode("b").alias("j", "bv")).select(F.xxhash64("i", "j", "av", "bv").alias("key"), "rep")
    least = keys.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("hi")).where("least < hi").select("key", "least")
    return keys.join(least, "key").transform(at_most, tasks)


def _agreeing(pairs: DataFrame, wide: DataFrame, tasks: int = MANY) -> DataFrame:
    """The (a, b) pairs whose sizes and signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (_unpacked(batch.column(k).to_pylist()) for k in (2, 3))
            keep = pa.array(agreeing(one, other) >= LEAST_AGREEING)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=_PAIR)

    side = lambda name: wide.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    joined = pairs.transform(at_most, tasks).join(side("a"), "a").transform(at_most, tasks).join(side("b"), "b").transform(at_most, tasks).where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long").distinct().transform(at_most, tasks)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, a, b, text), the texts of a group (b is null) before its pairs: the pairs that pass the exact test.

    An id with several texts is linked if any of them is.
    """
    owner, sets = None, {}
    for batch in batches:
        g, a, b = (batch.column(k).to_pylist() for k in range(3))
        for start, texts in text_slices(batch):
            values, sizes = shingle_sets(texts)
            ends = np.cumsum(sizes)
            found = []
            for k in range(len(texts)):
                if g[start + k] != owner:
                    owner, sets = g[start + k], {}
                if b[start + k] is None:
                    sets.setdefault(a[start + k], []).append(values[ends[k] - sizes[k] : ends[k]].copy())
                elif any(_similar(one, other) for one in sets[a[start + k]] for other in sets[b[start + k]]):
                    found.append((a[start + k], b[start + k]))
            if found:
                yield record_batch(_PAIR, dict(zip("ab", zip(*found, strict=True), strict=True)))


def _similar(one: np.ndarray, other: np.ndarray) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(one) + len(other) - both)


def in_stars(pairs: DataFrame, tasks: int = MANY) -> DataFrame:
    """(g, a, b): pairs by their leader a, large stars in several groups."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_CHUNK).alias("chunks"))
    return pairs.join(sizes, "a").transform(at_most, tasks).select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("chunks"))).alias("g"), "a", "b")


def verified(grouped: DataFrame, texts: DataFrame, tasks: int = MANY) -> DataFrame:
    """The (a, b) pairs of (g, a, b) that are links; a group's texts are held by one task at a time."""
    n = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = grouped.select("g", F.explode(F.array("a", "b")).alias("doc_id")).distinct().transform(at_most, tasks)
    needed = ids.join(texts, "doc_id").transform(at_most, tasks).select("g", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = needed.union(grouped.select("g", "a", "b", F.lit(None).cast("string"))).repartition(n, "g")
    return rows.sortWithinPartitions("g", F.col("b").asc_nulls_first()).transform(at_most, tasks).mapInArrow(_linked, "a long, b long")


def _with_least(rows: DataFrame, tasks: int) -> DataFrame:
    """(u, v) rows with m, the least v of their u. In one task that is a window, which needs no exchange; a join has one of either side even there."""
    if tasks == 1:
        return rows.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return rows.join(rows.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame, tasks: int = MANY) -> DataFrame:
    """(node, component) of every node of (a, b) edges, by alternating large and small stars; component: smallest node."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().transform(at_most, tasks)
    edges, state = checkpointed(edges), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        # Few edges need few tasks, each of which would write to all others; those that fit one task need no exchange.
        edges = edges.coalesce(tasks := 1 + now.n // EDGES_A_TASK)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        state = now
        both = edges.union(edges.select("v", "u")).coalesce(tasks)
        large = _with_least(both, tasks).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u > v")
        small = _with_least(large, tasks).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").coalesce(tasks).distinct()
        edges = checkpointed(small)


def blocks_of(members: DataFrame, tasks: int = MANY) -> DataFrame:
    """(rep, label, block, part, pool): classes in parts of about FAMILY_BLOCK, and in blocks of BLOCK_PARTS of these, that
    lie together by the smallest class they share a key with.

    A component that fills a part has parts and blocks of its own (pool is its label); the classes of small ones share them
    (pool is null).
    """
    least = members.groupBy("key").agg(F.min("rep").alias("least"))
    homes = members.join(least, "key").transform(at_most, tasks).groupBy("rep").agg(F.min("least").alias("home"), F.first("label").alias("label"))
    counted = homes.groupBy("home", "label").agg(F.count("*").alias("n"))
    own = F.col("n") >= FAMILY_BLOCK
    pools = counted.select("home", "label", own.alias("own"), F.when(own, F.col("label")).otherwise(0).alias("who"), "n")
    sizes = pools.groupBy("home", "own", "who").agg(F.ceil(F.sum("n") / FAMILY_BLOCK).alias("parts"))
    of = homes.join(pools.drop("n"), ["home", "label"]).transform(at_most, tasks).join(sizes, ["home", "own", "who"])
    slot = F.pmod(F.xxhash64("rep"), F.col("parts"))
    return of.select("rep", "label", F.xxhash64("home", "own", "who", F.floor(slot / BLOCK_PARTS)).alias("block"), F.xxhash64("home", "own", "who", slot, F.lit("part")).alias("part"), F.when(F.col("own"), F.col("label")).alias("pool"))


def meetings(members: DataFrame, block: DataFrame, tasks: int = MANY) -> DataFrame:
    """(g, block): the groups in which two blocks meet, or a shared one meets itself, because a key has classes of both.

    Two blocks of one component have nothing to find and never meet, so a large component that shares a key with a few
    others costs in proportion to its size. Keys with the same blocks, as those of a family mostly are, count once before
    their pairs of blocks are formed.
    """
    held = members.join(block.select("rep", "block", "pool"), "rep").transform(at_most, tasks).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("block", "pool"))).alias("blocks")).select("blocks").transform(at_most, tasks).distinct().transform(at_most, tasks)
    firsts = held.select("blocks", F.posexplode("blocks").alias("at", "b"))
    later = F.filter(F.slice("blocks", F.col("at") + 1, F.size("blocks") - F.col("at")), lambda o: o["pool"].isNull() | F.col("b.pool").isNull() | (o["pool"] != F.col("b.pool")))
    met = firsts.select(F.col("b.block").alias("one"), F.explode(later).alias("met")).select("one", F.col("met.block").alias("other")).distinct().transform(at_most, tasks)
    return met.select(F.xxhash64("one", "other").alias("g"), F.explode(F.array_distinct(F.array("one", "other"))).alias("block"))


def _promising(label: np.ndarray, n: np.ndarray, sig: np.ndarray, k: int, start: int) -> np.ndarray:
    """Which rows from start on have another label than row k, and a size and signature that allow a link with it."""
    fits = (label[start:] != label[k]) & (100 * np.minimum(n[start:], n[k]) >= PERCENT * np.maximum(n[start:], n[k]))
    other = start + np.flatnonzero(fits)
    return other[agreeing(sig[other], sig[k]) >= LEAST_AGREEING]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.StructArray]]:
    """The classes in rows (g, rows) of consecutive equal g, for each row an array; a group has two rows at most."""
    owner, held = None, []
    for batch in batches:
        for k, g in enumerate(batch.column(0).to_pylist()):
            if held and g != owner:
                yield held
                held = []
            owner = g
            held.append(batch.column(1).slice(k, 1).flatten())
    if held:
        yield held


def _columns(sides: list[pa.StructArray], names: list[str]) -> list[np.ndarray]:
    """Columns of whole numbers of all sides, one after another."""
    fields = [dict(zip((f.name for f in side.type), side.flatten(), strict=True)) for side in sides]
    return [np.concatenate([np.asarray(f[name], dtype=np.int64) for f in fields]) for name in names]


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (g, classes of a block) sorted by g the classes that may have a link: (g, part, reps), a g for each two parts.

    Two blocks compare classes of the one with those of the other only; a block by itself is a meeting of its own.
    """
    for sides in _groups(batches):
        rep, label, part, n = _columns(sides, ["rep", "label", "part", "n"])
        sig = _unpacked([s for side in sides for s in side.flatten()[-1].to_pylist()])
        parts, of = np.unique(part, return_inverse=True)
        some = np.zeros((len(rep), len(parts)), dtype=bool)
        for k in range(len(sides[0])):
            other = _promising(label, n, sig, k, len(sides[0]) if len(sides) > 1 else k + 1)
            some[k, of[other]] = True
            some[other, of[k]] = True
        for a, b in zip(*np.nonzero(np.triu([some[of == a].any(axis=0) for a in range(len(parts))])), strict=True):
            g = mix64(parts[[a]].view(np.uint64) ^ mix64(parts[[b]].view(np.uint64))).view(np.int64)[0]
            met = [(x, rep[(of == x) & some[:, y]]) for x, y in {(a, b), (b, a)}]
            yield record_batch(_HOPEFUL, {"g": [g] * len(met), "part": [parts[x] for x, _ in met], "reps": [reps for _, reps in met]})
    trim()


def _sets(texts: list[str | None]) -> list[np.ndarray]:
    values, sizes = shingle_sets(texts)
    return [own.copy() for own in np.split(values, np.cumsum(sizes)[:-1])]


def _within(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts that have about SLICE_CHARS characters."""
    start = total = 0
    for k, text in enumerate(texts):
        if total and total + len(text) > SLICE_CHARS:
            yield texts[start:k]
            start, total = k, 0
        total += len(text)
    yield texts[start:]


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of some sets share, exactly: a product of membership matrices, MATRIX_COLUMNS values at a time."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=bool)
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1 if len(values) else fresh
    owner, column = owner[common], column[common]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    out = np.zeros((len(sets), len(sets)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, MATRIX_COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + MATRIX_COLUMNS])
        held = np.zeros((len(sets), MATRIX_COLUMNS), dtype=np.float32)
        held[owner[lo:hi], column[lo:hi] - start] = 1
        out += held @ held.T
    return out.astype(np.int64)


def _meeting_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (g, classes of a part with their texts) sorted by g links that join all labels of a group which are linked, decided on full sets."""
    for sides in _groups(batches):
        rep, label = _columns(sides, ["rep", "label"])
        sets = [s for run in _within([t for side in sides for t in side.flatten()[-1].to_pylist()]) for s in _sets(run)]
        sizes = np.asarray([len(s) for s in sets])
        both = shared_counts(sets)
        linked = np.triu((both > 0) & (100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both)), 1)
        found: list[tuple[int, int]] = []
        for k, o in zip(*np.nonzero(linked), strict=True):
            if label[k] != label[o]:
                found.append((int(rep[k]), int(rep[o])))
                label[label == max(label[k], label[o])] = min(label[k], label[o])
        if found:
            yield record_batch(_PAIR, dict(zip("ab", zip(*found, strict=True), strict=True)))
    trim()


def across(members: DataFrame, wide: DataFrame, texts: DataFrame, tasks: int = MANY) -> DataFrame:
    """(a, b) links that join the components (label) of (key, rep, label) keys.

    Classes meet in blocks, two blocks to a task at a time; a block's signatures are gathered in one row before it goes to
    its meetings. They say which classes two parts of blocks need; only their texts are fetched, gathered by part likewise,
    and no pair leaves a task before it is known to be a link.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = checkpointed(blocks_of(members, tasks).transform(at_most, tasks))
    signed = block.join(wide, "rep").groupBy("block").agg(F.collect_list(F.struct("rep", "label", "part", "n", "sig")).alias("rows")).transform(at_most, tasks)
    met = meetings(members, block, tasks).join(signed, "block").transform(at_most, tasks).select("g", "rows").repartition(n, "g").sortWithinPartitions("g").transform(at_most, tasks)
    hopeful = checkpointed(met.mapInArrow(_hopeful, "g long, part long, reps array<long>"))
    release(members.sparkSession)
    wanted = hopeful.groupBy("part").agg(F.array_distinct(F.flatten(F.collect_list("reps"))).alias("reps")).select(F.explode("reps").alias("rep"))
    held = wanted.join(block.select("rep", "part", "label"), "rep").transform(at_most, tasks).join(texts.withColumnRenamed("doc_id", "rep"), "rep").transform(at_most, tasks)
    told = held.groupBy("part").agg(F.collect_list(F.struct("rep", "label", "text")).alias("rows")).transform(at_most, tasks)
    rows = hopeful.join(told, "part").transform(at_most, tasks).select("g", F.filter("rows", lambda r: F.array_contains("reps", r["rep"])).alias("rows"))
    return rows.repartition(n, "g").sortWithinPartitions("g").transform(at_most, tasks).mapInArrow(_meeting_links, "a long, b long")


def _relabelled(members: DataFrame, labels: DataFrame, tasks: int = MANY) -> DataFrame:
    """(key, rep, label) of the keys that still hold several components; of keys with the same members one."""
    rows = members.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").transform(at_most, tasks).select("key", "rep", F.coalesce("component", "rep").alias("label"))
    content = F.sum(F.xxhash64("rep").cast("decimal(20,0)"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), content.alias("content"), F.count("*").alias("size")).where("lo < hi").transform(at_most, tasks)
    return rows.join(mixed.groupBy("content", "size").agg(F.min("key").alias("key")).select("key").transform(at_most, tasks), "key").transform(at_most, tasks)


def with_shared_ids(links: DataFrame, linkable: DataFrame, classes: DataFrame, tasks: int = MANY) -> DataFrame:
    """links and those between the classes of each id that has several texts: the id is one node, so they are one component."""
    several = checkpointed(linkable.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")).where("lo <> hi").select("doc_id").transform(at_most, tasks))
    if not several.limit(1).count():
        return links
    of = linkable.join(several, "doc_id").select("doc_id", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
    first = of.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return links.union(of.join(first, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text)."""
    spark = docs.sparkSession
    signed = checkpointed(signatures(docs))
    # Every exchange is read by at most so many tasks, which grow with the rows: what few rows leave empty costs files and events only.
    tasks = tasks_for(spark, signed.count(), ROWS_A_TASK)
    linkable = signed.where("n > 0 and doc_id is not null")
    classes = checkpointed(linkable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "a", "b")).alias("r")).select("k1", "k2", F.col("r.doc_id").alias("rep"), "r.a", "r.b").transform(at_most, tasks))
    members = checkpointed(table_members(classes, tasks))
    wanted = checkpointed(members.select(F.col("rep").alias("doc_id")).distinct().transform(at_most, tasks))
    rows = docs.select(F.col("doc_id").cast("long"), clean_text("text").alias("text"))
    texts = checkpointed(IdFilter(wanted, tasks).rows(rows, "doc_id", True).join(wanted, "doc_id", "left_semi").transform(at_most, tasks))
    wide = checkpointed(texts.mapInArrow(_sign_wide, "rep long, n long, sig binary"))
    release(spark)
    # The first leader of a class is the smallest class of its keys.
    pairs = members.where("rep > least").groupBy("rep").agg(F.min("least").alias("a")).select("a", F.col("rep").alias("b"))
    links = checkpointed(with_shared_ids(verified(in_stars(checkpointed(_agreeing(pairs, wide, tasks)), tasks), texts, tasks), linkable, classes, tasks))
    release(spark)
    labels = components(links, tasks)
    members = checkpointed(_relabelled(members, labels, tasks))
    release(spark)
    for turn in range(1, ROUNDS):
        # Later leaders are the smallest by a hash that each round draws anew.
        drawn = F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), F.col("rep").alias("leader"), F.col("label").alias("of"))
        leaders = members.groupBy("key").agg(F.min(drawn).alias("l"))
        met = members.join(leaders, "key").transform(at_most, tasks).where("label <> l.of").groupBy("rep").agg(F.min("l").alias("l"))
        pairs = met.select(F.least("rep", "l.leader").alias("a"), F.greatest("rep", "l.leader").alias("b")).distinct()
        links = checkpointed(links.union(verified(in_stars(checkpointed(_agreeing(pairs, wide, tasks)), tasks), texts, tasks)))
        release(spark)
        labels = components(links, tasks)
        members = checkpointed(_relabelled(members, labels, tasks))
        release(spark)
    links = checkpointed(links.union(across(members, wide, texts, tasks)))
    release(spark)
    labels = components(links, tasks)
    of_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id")).transform(at_most, tasks)
    linked = linkable.join(of_class, ["k1", "k2"]).transform(at_most, tasks)
    alone = signed.where("not (n > 0 and doc_id is not null)").withColumn("component_id", F.col("doc_id"))
    out = linked.select("doc_id", "n", "component_id").union(alone.select("doc_id", "n", "component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
