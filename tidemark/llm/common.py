"""Helpers that the training-data operators share: shared-folder checkpoints and bounded Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: As many tasks as Spark makes.
MANY = 1 << 30
#: Characters of text that one vectorised step holds at a time; a longer text is a step of its own.
SLICE_CHARS = 300_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and read it back, so a lost executor never recomputes it.

    The folder comes from spark.checkpoint.dir. Only a session in one process (tests) gets a folder of its own; on a
    cluster, executors would write to disks that nobody else sees, so a missing folder is an error there.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-ckpt-"))
    return df.checkpoint(eager=True)


#: Rows of an Arrow batch: whole texts are in it, on both sides of the Python worker.
BATCH_ROWS = 3000
#: Bytes after which an Arrow batch takes no further row: rows that hold blocks are far longer than texts.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts and blocks, unless the session keeps them smaller still."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(name))[0]) <= most:
            spark.conf.set(name, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def clean_text(text: str | Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive runs of rows whose texts together have about limit characters."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64)
    start = total = 0
    for row, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield start, values.slice(start, row - start).to_pylist()
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield start, values.slice(start).to_pylist()
    trim()


def trim() -> None:
    """Give memory that is free back to the system: Python workers outlive tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of stages that nothing refers to any more.

    Spark removes them when the driver's JVM collects its garbage, which on a driver with little to do is long after an
    iterative job has filled the executors' disks; so it is asked to.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks_for(spark: SparkSession, amount: int, each: int) -> int:
    """Tasks that an amount is worth at so much for each of them; MANY unless that is fewer than an exchange has partitions."""
    tasks = 1 + amount // each
    return tasks if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")) else MANY


def at_most(df: DataFrame, tasks: int) -> DataFrame:
    """df in so many tasks at most; as it is for MANY."""
    return df if tasks == MANY else df.coalesce(tasks)


def record_batch(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    """Columns as a batch of that schema; numpy arrays and lists both do."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def rewritten(docs: DataFrame, change: Callable[[list[str | None]], list[str | None]]) -> DataFrame:
    """All rows and columns of docs with their text changed, and n_chars (where there is one) counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start, texts in text_slices(batch):
                part = batch.slice(start, len(texts))
                text = pa.array(change(texts), type=batch.schema.field(at).type)
                part = part.set_column(at, batch.schema.field(at), text)
                if (n := batch.schema.get_field_index("n_chars")) >= 0:
                    part = part.set_column(n, batch.schema.field(n), pc.utf8_length(text).cast(batch.schema.field(n).type))
                yield part

    return docs.mapInArrow(run, docs.schema)


def chosen(docs: DataFrame, keep: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows of docs, with all columns, whose texts keep() marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch):
                yield batch.slice(start, len(texts)).filter(pa.array(keep(texts)))

    return docs.mapInArrow(run, docs.schema)


def has_repeats(docs: DataFrame, *columns: str | Column) -> bool:
    """Whether several rows agree in the columns."""
    return bool(docs.groupBy(*columns).count().where("count > 1").limit(1).collect())


#: Bits of an id filter: what is broadcast never exceeds FILTER_BITS / 8 bytes, however many ids there are.
FILTER_BITS = 1 << 26


class IdFilter:
    """A Bloom filter of ids with two bits each: no id of the set is ever missed, few others pass until it is crowded.

    It spares rows a shuffle before an exact join and never decides anything by itself.
    """

    def __init__(self, ids: DataFrame, tasks: int = MANY):
        """ids: one column of longs; nulls are left out. Bits are gathered by task, then by word, in so many tasks at most."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
            for batch in batches:
                for place in _places(pc.drop_null(batch.column(0)).to_numpy(zero_copy_only=False)):
                    np.bitwise_or.at(words, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
            some = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(words[some].view(np.int64), pa.int64())], names=["word", "bits"])

        found = at_most(ids, tasks).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).transform(at_most, tasks).toArrow()
        words = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        self.words = ids.sparkSession.sparkContext.broadcast(words)

    def rows(self, docs: DataFrame, column: str, held: bool) -> DataFrame:
        """The rows whose id may be in the set, or those whose id surely isn't (null ids aren't)."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index(column)).cast(pa.int64())
                known = np.asarray(pc.is_valid(ids))
                maybe = known
                for place in _places(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)):
                    maybe = maybe & ((words.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
                yield batch.filter(pa.array(maybe if held else ~maybe))
            trim()

        return docs.mapInArrow(run, docs.schema)


def _places(ids: np.ndarray) -> list[np.ndarray]:
    hashed = mix64(ids.astype(np.int64).view(np.uint64))
    return [hashed % np.uint64(FILTER_BITS), (hashed >> np.uint64(32)) % np.uint64(FILTER_BITS)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = []


def _powers_upto(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, kept by the process."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, 2 * SLICE_CHARS) + 1
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, dtype=np.uint64))]) for b in (_BASE, inverse)]
    return _powers


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [begin, end) of a sequence of 64-bit values; equal contents have equal hashes."""
    powers, inverses = _powers_upto(len(values))
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[: len(values)])])
        return mix64((prefix[end] - prefix[begin]) * inverses[begin] + (end - begin).astype(np.uint64))

