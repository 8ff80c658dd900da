"""Language identification with interpolated Kneser-Ney character models.

Per language, character 4-gram counts become one interpolated Kneser-Ney model per order, kept as tables of all n-grams.
A text gets the language of the lowest length-normalised cross-entropy. A tempered softmax over the languages and a
"none of these" class (a uniform character model) gives the score; its temperature is fitted on labelled texts.

Counting is distributed over every labelled row: each task counts its own slices, Spark sums the counts. Every n-gram is
kept, whatever its count, and discounts and lower orders come from the full counts. The models never reach the driver or
a task as a whole: texts are scored through joins.

Calibration uses CALIBRATION_ROWS different labelled texts at most, drawn by their hashes from a sixteenth of all, and
their rows (all copies of a text) are left out of the counts, so error rate, temperature and rejection are measured on
texts that the models have not seen. A text is rejected if its best cross-entropy exceeds the limit of that language: half
way between what its own texts reach (their QUANTILE) and what texts of other languages start from, and for short texts
more, by the spread seen, over the root of the length.

Cases: null text or text without letters (marks, digits and signs are none) -> language "und", score 0, rejected; empty
training table -> all "und"; rows without a label are never learned from; repeated rows count as often as they occur;
other columns, whatever their names, are ignored or passed through. A language all of whose texts would be drawn for
calibration is learned from them. Letters beyond the first 65,536 code points share 6,400 symbols.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import MANY, at_most, checkpointed, mix64, record_batch, tasks_for, text_slices, trim

ORDER = 4
CALIBRATION_ROWS = 2000
#: Hashes below this, a sixteenth of all, may be drawn for calibration.
CALIBRATION_BELOW = -(1 << 63) + (1 << 60)
#: Share of a language's own texts, and of others' texts, that its rejection limit is set between.
QUANTILE = 0.99
#: Own texts that a language needs for a limit of its own; with fewer it takes the limit of all.
LEAST_TEXTS = 20
#: Characters of a part, in which each n-gram is looked up once.
PART_CHARS = 8_000_000
#: Exchanges of the n-grams of fewer characters than this for each of their partitions are read by fewer tasks.
CHARS_A_TASK = 4_000_000
UNDETERMINED = "und"
_FLUSH = 1_000_000
_SPACE, _EDGE = 32, 0
_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
_GRAMS = pa.schema([("gram", pa.int64())])
_BLOCK = pa.schema([("part", pa.int64()), ("block", pa.binary())])
_REQUESTS = pa.schema([("part", pa.int64()), ("gram", pa.int64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point -> 16-bit symbol: letters and marks keep their code, everything else is a space.

    Those beyond 16 bits share the private-use codes, which no letter has.
    """
    table = np.full(0x110000, _SPACE, dtype=np.uint16)
    for point in range(0x110000):
        if unicodedata.category(chr(point))[0] in "LM":
            table[point] = point if point < 0x10000 else 0xE000 + point % 6400
    table[0] = _EDGE
    return table


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((unicodedata.category(chr(point))[0] == "L" for point in range(0x110000)), dtype=bool, count=0x110000)


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams (four 16-bit symbols, the newest lowest) of all texts, and the first gram of each text.

    A text starts after ORDER - 1 edge symbols; runs of non-letters are one space; a text without letters has no grams.
    """
    edge = "\0" * (ORDER - 1)
    pieces = [edge + (t or "").lower().replace("\0", " ") + "\n" for t in texts]
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "replace"), dtype=np.uint32)
    symbols, sizes = _folding()[points], np.asarray([len(p) for p in pieces], dtype=np.int64)
    space, border = symbols == _SPACE, symbols == _EDGE
    first = np.cumsum(sizes) - sizes
    letters = np.concatenate([[0], np.cumsum(_letters()[points])])
    keep = np.repeat(letters[first + sizes] > letters[first], sizes)
    keep[1:] &= ~space[1:] | ~(space[:-1] | border[:-1])
    real = np.concatenate([[0], np.cumsum(keep & ~border)])
    starts = real[first]
    wide = symbols[keep].astype(np.uint64)
    packed = wide.copy()
    for back in range(1, ORDER):
        packed[back:] |= wide[:-back] << np.uint64(16 * back)
    return packed[wide != _EDGE], starts


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.concatenate([first, [len(keys)]]))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flush(lang: str) -> pa.RecordBatch:
        keys, counts = _merged(held.pop(lang))
        return record_batch(_COUNTS, {"lang": [lang] * len(keys), "gram": keys.view(np.int64), "n": counts})

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for start, texts in text_slices(batch):
            by_lang: dict[str, list[str | None]] = {}
            for lang, text in zip(langs[start:], texts, strict=False):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                grams, _ = grams_of(own)
                if len(grams):
                    held.setdefault(lang, []).append(_counted(grams))
                    if len(held[lang]) > 15:
                        held[lang] = [_merged(held[lang])]
                    if len(held[lang][0][0]) > _FLUSH:
                        yield flush(lang)
    for lang in list(held):
        yield flush(lang)


class KneserNey:
    """One language's interpolated model in memory, which the tables of fit() are tested against: per order, sorted gram hashes with log-probabilities, and context back-offs."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, symbols: int):
        self.probability: list[tuple[np.ndarray, np.ndarray]] = []
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []
        self.floor = -np.log(symbols + 1)
        levels = [(grams, counts.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):
            lower, kinds = _counted(levels[-1][0] & np.uint64((1 << 16 * order) - 1))
            levels.append((lower, kinds.astype(np.float64)))
        for order, (keys, n) in enumerate(reversed(levels), 1):
            ones, twos = float((n == 1).sum()), float((n == 2).sum())
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.75
            context = keys >> np.uint64(16)
            by = np.argsort(context, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], context[by][1:] != context[by][:-1]]))
            total, kinds = np.add.reduceat(n[by], first), np.diff(np.concatenate([first, [len(by)]]))
            which = np.empty(len(by), dtype=np.int64)
            which[by] = np.repeat(np.arange(len(first)), kinds)
            gamma = discount * kinds / total
            lower = np.exp(self.logp(keys, order - 1))
            self._store(self.backoff, context[by][first], np.log(gamma))
            self._store(self.probability, keys, np.log((n - discount) / total[which] + gamma[which] * lower))

    @staticmethod
    def _store(to: list, keys: np.ndarray, values: np.ndarray) -> None:
        hashes = mix64(keys)
        order = np.argsort(hashes)
        to.append((hashes[order], values[order].astype(np.float32)))

    @staticmethod
    def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = mix64(keys)
        at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
        return table[0][at] == hashes, table[1][at]

    def logp(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probability of each gram's newest symbol after its order - 1 earlier ones."""
        if not order:
            return np.full(len(grams), self.floor)
        keys = grams & np.uint64((1 << 16 * order) - 1) if order < 4 else grams
        hit, value = self._found(self.probability[order - 1], keys)
        out = value.astype(np.float64)
        if not hit.all():
            missed = keys[~hit]
            known, gamma = self._found(self.backoff[order - 1], missed >> np.uint64(16))
            out[~hit] = self.logp(missed, order - 1) + np.where(known, gamma, 0)
        return out


class Bank:
    """The models of all languages as tables of n-grams, and what turns entropies into a language, a score and a rejection.

    tables: per order, (key, p) with the log-probabilities of seen n-grams and (context, b) with log back-offs, both as
    arrays by language with nulls for what a language has not seen. Only they grow with the input; they stay tables.
    """

    def __init__(self, langs: list[str], symbols: int, tables: list[tuple[DataFrame, DataFrame]]):
        self.langs, self.tables = langs, tables
        self.rule = Rule(langs, float(np.log(symbols + 1)))

    def logp(self, grams: DataFrame, tasks: int = MANY) -> DataFrame:
        """(gram, logp) of distinct 4-grams: the array of the log-probabilities in each language."""
        wanted = [grams.select(F.col("gram").alias("key"))]
        for order in range(ORDER - 1, 0, -1):
            wanted.append(wanted[-1].transform(at_most, tasks).select(_suffix("key", order).alias("key")).distinct())
        found = None
        for order, keys in enumerate(reversed(wanted), 1):
            seen, contexts = self.tables[order - 1]
            rows = keys.withColumn("context", F.shiftrightunsigned("key", 16)).join(seen, "key", "left").transform(at_most, tasks).join(contexts, "context", "left").transform(at_most, tasks)
            if found is None:
                rows = rows.withColumn("s", F.array(*[F.lit(-self.rule.none)] * len(self.langs)))
            else:
                rows = rows.withColumn("lower", _suffix("key", order - 1)).join(found.select(F.col("key").alias("lower"), F.col("logp").alias("s")), "lower").transform(at_most, tasks)
            each = [F.coalesce(F.col("p")[k], F.coalesce(F.col("b")[k], F.lit(0.0)) + F.col("s")[k]) for k in range(len(self.langs))]
            found = rows.select("key", F.array(*each).alias("logp"))
        return found.select(F.col("key").alias("gram"), "logp")


class Rule:
    """What decides on entropies: the languages, the uniform model, and the figures fitted on labels."""

    def __init__(self, langs: list[str], none: float):
        self.langs, self.none = langs, none
        self.temperature, self.error = 1.0, 0.5
        self.limits, self.spreads = np.full(len(langs), none), np.zeros(len(langs))

    def posteriors(self, entropies: np.ndarray, sizes: np.ndarray, temperature: float | None = None) -> np.ndarray:
        """Tempered softmax over the languages and the uniform model; evidence grows with the root of the length.

        The share of labels that the models get wrong is spread evenly, so no score claims more than was seen.
        """
        with_none = np.concatenate([entropies, np.full((len(entropies), 1), self.none)], axis=1)
        power = -with_none * (np.sqrt(np.maximum(sizes, 1)) * (temperature or self.temperature))[:, None]
        power -= power.max(axis=1, keepdims=True)
        exp = np.exp(power)
        return (1 - self.error) * exp / exp.sum(axis=1, keepdims=True) + self.error / exp.shape[1]

    def calibrate(self, entropies: np.ndarray, sizes: np.ndarray, langs: list[str]) -> None:
        """The error rate on the given labels, the temperature with their highest likelihood, and the rejection limits."""
        rows = np.flatnonzero((sizes > 0) & np.isin(langs, self.langs))
        if not len(rows):
            return
        labels = np.searchsorted(self.langs, np.asarray(langs)[rows])
        self.error = (int((entropies[rows].argmin(axis=1) != labels).sum()) + 1) / (len(rows) + 2)
        grid = 2.0 ** np.arange(-6, 5)
        fits = [np.log(np.maximum(self.posteriors(entropies[rows], sizes[rows], t)[np.arange(len(rows)), labels], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmax(fits))])
        own = entropies[rows, labels]
        everyone = self._limit(own, sizes[rows], np.concatenate([np.delete(e, k) for e, k in zip(entropies[rows], labels, strict=True)]))
        for k in range(len(self.langs)):
            mine = labels == k
            enough = mine.sum() >= LEAST_TEXTS
            self.limits[k], self.spreads[k] = self._limit(own[mine], sizes[rows][mine], entropies[rows][~mine, k]) if enough else everyone

    def _limit(self, own: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> tuple[float, float]:
        """The limit for long texts between own and others' entropies, and what the root of a short text's length divides."""
        reached = float(np.quantile(own, QUANTILE))
        start = float(np.quantile(others, 1 - QUANTILE)) if len(others) else self.none
        spread = float(np.quantile((own - np.median(own)) * np.sqrt(sizes), QUANTILE))
        return max(reached, (reached + min(start, self.none)) / 2), max(spread, 0.0)

    def limit(self, best: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The cross-entropy beyond which a text of that many characters isn't taken for that language."""
        return self.limits[best] + self.spreads[best] / np.sqrt(np.maximum(sizes, 1))

    def decide(self, entropies: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        if not self.langs:
            rows = len(sizes)
            return [UNDETERMINED] * rows, np.zeros(rows), np.full(rows, np.nan), np.ones(rows, dtype=bool)
        empty = sizes == 0
        safe = np.where(empty[:, None], self.none, entropies)
        best, post = safe.argmin(axis=1), self.posteriors(safe, sizes)
        score = np.where(empty, 0.0, post[np.arange(len(best)), best])
        lowest = np.where(empty, np.nan, safe[np.arange(len(best)), best])
        langs = [UNDETERMINED if e else self.langs[k] for e, k in zip(empty, best, strict=True)]
        return langs, score, lowest, empty | (safe[np.arange(len(best)), best] > self.limit(best, sizes))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text), counted in the tasks before the shuffle."""
    parts = labelled.select("lang", "text").mapInArrow(_count_batches, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(gram: str, order: int) -> Column:
    """The newest order symbols of a packed n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 16 * order) - 1))


def _by_language(rows: DataFrame, key: str, value: str, name: str, langs: list[str]) -> DataFrame:
    """(key, name): the values of each key as an array by language."""
    return rows.groupBy(key).agg(F.array(*(F.max(F.when(F.col("lang") == lang, F.col(value))) for lang in langs)).alias(name))


def fit(labelled: DataFrame) -> Bank:
    """The model bank of (lang, text) rows; rows with a null lang or text are passed over."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    # The texts of the smallest hashes; only hashes are sorted, and texts stay where they are read.
    last = labelled.where(F.col("h") < F.lit(CALIBRATION_BELOW)).select("h").distinct().orderBy("h").limit(CALIBRATION_ROWS).agg(F.max("h")).first()[0]
    drawn = F.coalesce(F.col("h") <= F.lit(last).cast("long"), F.lit(False))
    found = labelled.groupBy("lang").agg(F.min(drawn).alias("all_drawn"), F.sum(F.length("text")).alias("chars")).collect()
    spared, tasks = [r.lang for r in found if r.all_drawn], tasks_for(labelled.sparkSession, sum(r.chars for r in found), CHARS_A_TASK)
    levels = [checkpointed(gram_counts(labelled.where(~drawn | F.col("lang").isin(spared))).withColumnRenamed("gram", "key").transform(at_most, tasks))]
    langs = sorted(r.lang for r in levels[0].select("lang").distinct().transform(at_most, tasks).collect())
    for order in range(ORDER - 1, 0, -1):
        levels.append(checkpointed(levels[-1].groupBy("lang", _suffix("key", order).alias("key")).agg(F.count("*").alias("n")).transform(at_most, tasks)))
    symbols = levels[-1].select("key").distinct().transform(at_most, tasks).count()
    tables, lower = [], None
    for order, level in enumerate(reversed(levels), 1) if langs else ():
        few = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).transform(at_most, tasks).collect()
        discounts = {r.lang: min(0.95, max(0.1, r.ones / (r.ones + 2 * r.twos))) if r.ones + r.twos else 0.75 for r in few}
        rows = level.withColumn("context", F.shiftrightunsigned("key", 16))
        discount = F.element_at(F.create_map(*(F.lit(x) for pair in discounts.items() for x in pair)), F.col("lang"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).withColumn("gamma", discount * F.col("kinds") / F.col("total"))
        rows = rows.join(contexts, ["lang", "context"]).transform(at_most, tasks).withColumn("lower", _suffix("key", order - 1))
        rows = rows.withColumn("q", F.lit(1.0 / (symbols + 1))) if lower is None else rows.join(lower, ["lang", "lower"])
        rows = checkpointed(rows.select("lang", "key", ((F.col("n") - discount) / F.col("total") + F.col("gamma") * F.col("q")).alias("q")).transform(at_most, tasks))
        seen = _by_language(rows.withColumn("logq", F.log("q")), "key", "logq", "p", langs)
        backoffs = _by_language(contexts.transform(at_most, tasks).withColumn("logg", F.log("gamma")), "context", "logg", "b", langs)
        tables.append((checkpointed(seen.transform(at_most, tasks)), checkpointed(backoffs.transform(at_most, tasks))))
        lower = rows.withColumnRenamed("key", "lower")
    bank = Bank(langs, symbols, tables)
    if langs:
        sample = checkpointed(labelled.where(drawn).groupBy("h").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.lang", "r.text").transform(at_most, tasks))
        bank.rule.calibrate(*_sample_entropies(sample, bank))
    return bank


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram) of a column text: the different 4-grams of a task, some of them repeatedly if there are many."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for _, texts in text_slices(batch):
            grams, _ = grams_of(texts)
            if len(grams):
                held.append(_counted(grams))
            if len(held) > 15:
                held = [_merged(held)]
                if len(held[0][0]) > _FLUSH:
                    yield record_batch(_GRAMS, {"gram": held.pop()[0].view(np.int64)})
    if held:
        yield record_batch(_GRAMS, {"gram": _merged(held)[0].view(np.int64)})


def _blocks(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(part, block): slices of rows, whole and compressed, dealt into parts by their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for start, texts in text_slices(batch):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                    stream.write_batch(batch.slice(start, len(texts)))
                block = sink.getvalue().to_pybytes()
                yield record_batch(_BLOCK, {"part": [zlib.crc32(block) % parts], "block": [block]})

    return run


def _rows(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, gram) of blocks: the distinct 4-grams of each part's texts, some of them repeatedly if there are many."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for of in list(held):
            keys, _ = _merged(held.pop(of))
            yield record_batch(_REQUESTS, {"part": np.full(len(keys), of), "gram": keys.view(np.int64)})

    for batch in batches:
        for of, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = _rows(block)
            grams, _ = grams_of(rows.column(rows.schema.get_field_index("text")).to_pylist())
            if len(grams):
                held.setdefault(of, []).append(_counted(grams))
                if len(held[of]) > 15:
                    held[of] = [_merged(held[of])]
            if sum(len(keys) for own in held.values() for keys, _ in own) > _FLUSH:
                yield from flush()
    yield from flush()


def _entropies(texts: list[str | None], keys: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) cross-entropies per character, in nats, and the number of characters scored."""
    grams, starts = grams_of(texts)
    sizes = np.diff(np.concatenate([starts, [len(grams)]]))
    out, some = np.full((len(texts), len(logp)), np.inf), sizes > 0
    if some.any():
        at = np.searchsorted(keys, grams)
        if at.max() >= len(keys) or (keys[at] != grams).any():
            raise ValueError("an n-gram of a text has no log-probability")
        for k, own in enumerate(logp):
            out[some, k] = -np.add.reduceat(own[at], starts[some], dtype=np.float64) / sizes[some]
    return out, sizes


def scored(docs: DataFrame, bank: Bank, make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """What make(rows, entropies, sizes) gives for all rows of docs, whose column text is scored.

    The models answer all different 4-grams of the texts by joins. Rows then travel as compressed blocks, in parts of about
    PART_CHARS characters; a part asks once for each 4-gram that it holds, and blocks and answers meet, so no task holds
    more of the models than its part needs.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    langs, tasks = len(bank.langs), tasks_for(docs.sparkSession, chars, CHARS_A_TASK)
    known = checkpointed(bank.logp(checkpointed(docs.select("text").mapInArrow(_distinct_grams, "gram long").distinct().transform(at_most, tasks)), tasks))
    # One exchange of the blocks serves those who ask and those who meet the answers.
    blocks = docs.mapInArrow(_blocks(1 + chars // PART_CHARS), "part long, block binary").repartition("part")
    asked = blocks.transform(at_most, tasks).mapInArrow(_requests, "part long, gram long")
    answers = asked.join(known, "gram").transform(at_most, tasks).select("part", "gram", F.col("logp").cast("array<float>").alias("logp"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        flat = right.column("logp").combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks] or [pa.array([], pa.float32())])
        logp = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(-1, langs)[order].T)
        out = []
        for block in left.column("block").to_pylist():
            rows = _rows(block)
            out.append(make(rows, *_entropies(rows.column(rows.schema.get_field_index("text")).to_pylist(), keys[order], logp)))
        trim()
        return pa.Table.from_batches(out)

    return blocks.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, schema)


def _sample_entropies(sample: DataFrame, bank: Bank) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Entropies, sizes and labels of (lang, text) rows; the texts stay on the executors."""
    schema = pa.schema([("lang", pa.string()), ("size", pa.int64()), ("entropies", pa.list_(pa.float64()))])

    def make(rows: pa.RecordBatch, entropies: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        return record_batch(schema, {"lang": rows.column("lang").to_pylist(), "size": sizes, "entropies": entropies.tolist()})

    rows = scored(sample, bank, make, "lang string, size long, entropies array<double>").toArrow()
    entropies = np.asarray(rows.column("entropies").to_pylist(), dtype=np.float64).reshape(-1, len(bank.langs))
    return entropies, rows.column("size").to_numpy(), rows.column("lang").to_pylist()


def predict(docs: DataFrame, bank: Bank) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) of every row of (doc_id, text)."""
    rule = bank.rule

    def make(rows: pa.RecordBatch, entropies: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        langs, score, entropy, rejected = rule.decide(entropies, sizes)
        return record_batch(_SCORES, {"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "lang_pred": langs, "score": score, "cross_entropy": entropy, "rejected": rejected})

    schema = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    if not bank.langs:
        unknown = (F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(float("nan")).alias("cross_entropy"), F.lit(True).alias("rejected"))
        return docs.select("doc_id", "held_out", *unknown)
    return scored(docs, bank, make, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that aren't held out, then predict every row."""
    return predict(docs, fit(docs.where(~held_out()).select("lang", "text")))


def accepted(docs: DataFrame, bank: Bank) -> DataFrame:
    """The rows of docs, with all columns, whose texts the bank doesn't reject."""
    rule = bank.rule
    if not bank.langs:
        return docs.limit(0)
    return scored(docs, bank, lambda rows, entropies, sizes: rows.filter(pa.array(~rule.decide(entropies, sizes)[3])), docs.schema)
