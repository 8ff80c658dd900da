"""Source divergence audit by a baseline-corrected inverted index.

Terms are counted by (language, source). A group of N kept occurrences gives a term with that count the share
p = 1 + floor(10^9 (count + 1) / (N + V)), and two shares diverge by f = floor((p - q)^2 / q). Every pair of a language's
sources begins at V times the f of two zero counts. Postings then add what differs from that: a source's terms as if the
other had none of them (from its histogram of counts, so equal counts are one row), and for each term that both have, what is
left to the true f. Only these are ever emitted, and each task adds them up by pair before anything is shuffled.

Counting is the only step that reads texts: each task counts its texts' terms and hands on sums. Ranks are windows whose
first ranks are cut in each task before rows are shuffled, so a source of a third of all rows isn't sorted in one place.
Pairs are the result itself; a term's postings number at most the language's sources.

Cases: null text, language or source is ''; a group without terms, or without kept ones, still takes part; a language of one
source has no pair; V = 0 gives pairs of value 0 and no terms; repeated rows are documents of their own; doc_id and columns of
other names are ignored; an empty table gives no row; ties go by item. All arithmetic is in whole numbers; shares are exact up
to N + V = 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, checkpointed, record_batch, trim

LEAST_DOCUMENTS, MOST_TERMS = 3, 200
BILLION = 1_000_000_000
#: Entries that a task counts before it hands them on, and pairs that one vectorised step holds.
HELD_TERMS, STEP_PAIRS = 200_000, 500_000

# ASCII capitals become small letters, other ASCII signs spaces; all bytes of other letters stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _read(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in zip(columns, ("lang", "source", "text"), strict=False)))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, df): occurrences of each term and the documents that have it, as each task has counted them."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def emptied(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (of, by), (counts, documents) in held.items():
            terms = [t.decode() for t in counts]
            yield record_batch(schema, {"lang": [of] * len(terms), "source": [by] * len(terms), "term": terms, "n": list(counts.values()), "df": [documents[t] for t in counts]})
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for of, by, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                counts, documents = held.setdefault((of.as_py(), by.as_py()), (Counter(), Counter()))
                before = len(counts)
                terms = content.as_buffer().to_pybytes().translate(_TERM_BYTES).split()
                counts.update(terms)
                documents.update(set(terms))
                size += len(counts) - before
                if size > HELD_TERMS:
                    yield from emptied(held)
                    size = 0
        yield from emptied(held)
        trim()

    return _read(docs, lang, source, text).mapInArrow(run, "lang string, source string, term string, n long, df long")


def share(count: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 1) / size), exactly: three digits of the quotient at a time."""
    whole = count + 1
    rest, out = whole % size, F.lit(0).cast("long")
    for _ in range(3):
        out, rest = out * 1000 + _div(rest * 1000, size), rest * 1000 % size
    return F.lit(1).cast("long") + _div(whole, size) * BILLION + out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def shares(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """share() of arrays."""
    whole, rest = np.divmod(counts + 1, size)
    out = np.zeros_like(rest)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        out = out * 1000 + digit
    return 1 + whole * BILLION + out


def _both(lang: list[str], sid: np.ndarray, n: np.ndarray, size: np.ndarray, ends: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, s, t, value) of what pairs of one term's postings add beyond each alone, added up; ends: of each term's postings."""
    p, zero = shares(n, size), shares(np.zeros_like(n), size)
    f = lambda a, b: (a - b) * (a - b) // b
    names = sorted(set(lang))
    code = np.searchsorted(names, lang) if names else np.zeros(0, dtype=np.int64)
    term = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    begin, width = np.concatenate([[0], ends[:-1]])[term].astype(np.int64), np.diff(ends, prepend=0)[term].astype(np.int64)
    total, sources = np.cumsum(width), int(sid.max(initial=0)) + 1
    at = 0
    while at < len(width):
        # At least one posting, with all postings of its term.
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_PAIRS, side="right")))
        w = width[at:stop]
        a = np.repeat(np.arange(at, stop), w)
        b = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(begin[at:stop], w)
        a, b = a[a != b], b[a != b]
        value = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
        keys, place = np.unique((code[term[a]] * sources + sid[a]) * sources + sid[b], return_inverse=True)
        sums = np.zeros(len(keys), dtype=np.int64)
        np.add.at(sums, place, value)
        yield [names[k] for k in keys // sources // sources], keys // sources % sources, keys % sources, sums
        at = stop


def shared_corrections(postings: DataFrame) -> DataFrame:
    """(lang, s, t, value) of terms' postings (lang, posts array<struct(sid, n, size)>): what terms that both have add."""
    schema = pa.schema([("lang", pa.string()), ("s", pa.int32()), ("t", pa.int32()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            lists = batch.column(1)
            posts = lists.flatten()
            ends = np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))
            sid, n, size = (np.asarray(posts.field(k)).astype(np.int64) for k in range(3))
            for of, s, t, value in _both(batch.column(0).to_pylist(), sid, n, size, ends):
                for key, v in zip(zip(of, s.tolist(), t.tolist(), strict=True), value.tolist(), strict=True):
                    held[key] = held.get(key, 0) + v
                if len(held) > HELD_TERMS:
                    yield _summed(schema, held)
        yield _summed(schema, held)
        trim()

    return postings.select("lang", "posts").where(F.size("posts") > 1).mapInArrow(run, "lang string, s int, t int, value long")


def _summed(schema: pa.Schema, held: dict[tuple[str, int, int], int]) -> pa.RecordBatch:
    out = record_batch(schema, {"lang": [k[0] for k in held], "s": [k[1] for k in held], "t": [k[2] for k in held], "value": list(held.values())})
    held.clear()
    return out


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's divergence from every other, and the terms that set it apart."""
    bounded_batches(docs.sparkSession)
    # Tasks have added up what they read, so rows are dealt by term at once; all that a term needs is then in one place.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = term_counts(docs, text, lang, source).repartition(n, "lang", "term")
    counted = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("posts"))
    kept = checkpointed(by_term.where(F.col("df") >= least).select("lang", "term", "all_n", "posts"))
    # One row for each group and language.
    lists = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    own = kept.select("lang", F.explode("posts").alias("p")).groupBy("lang", F.col("p.source").alias("source")).agg(F.sum("p.n").alias("group_n"))
    groups = _read(docs, lang, source).distinct().join(own, ["lang", "source"], "left").join(lists, "lang", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sid = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    groups = checkpointed(groups.select("lang", "source", sid.alias("sid"), none("v").alias("v"), (none("group_n") + none("v")).alias("size"), (none("lang_n") + none("v")).alias("lang_size")))

    placed = kept.select("lang", "term", "all_n", F.explode("posts").alias("p")).select("lang", "term", "all_n", "p.source", "p.n").join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("size")), share(F.col("all_n"), F.col("lang_size"))
    above = placed.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    zero = lambda size: share(F.lit(0).cast("long"), size)
    other = groups.select("lang", F.col("sid").alias("t"), F.col("size").alias("t_size"))
    baseline = groups.select("lang", F.col("sid").alias("s"), "size", "v").join(other, "lang").where("s <> t")
    # Without kept terms there is no share to take.
    f0 = F.when(F.col("v") > 0, F.col("v") * divergence(zero(F.greatest("size", F.lit(1).cast("long"))), zero(F.greatest("t_size", F.lit(1).cast("long"))))).otherwise(0)
    baseline = baseline.select("lang", "s", "t", f0.cast("long").alias("value"))
    histogram = placed.groupBy("lang", "sid", "size", "n").agg(F.count("*").alias("k")).select("lang", "sid", "k", share(F.col("n"), F.col("size")).alias("p"), zero(F.col("size")).alias("p0"))
    met = histogram.join(other.select("lang", "t", zero(F.greatest("t_size", F.lit(1).cast("long"))).alias("t0")), "lang").where("sid <> t")
    ours = F.col("k") * (divergence(F.col("p"), F.col("t0")) - divergence(F.col("p0"), F.col("t0")))
    theirs = F.col("k") * (divergence(F.col("t0"), F.col("p")) - divergence(F.col("t0"), F.col("p0")))
    alone = met.groupBy("lang", "sid", "t").agg(F.sum(ours).alias("ours"), F.sum(theirs).alias("theirs"))
    alone = checkpointed(alone)
    postings = placed.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "n", "size")).alias("posts"))
    parts = [baseline, alone.select("lang", F.col("sid").alias("s"), "t", F.col("ours").alias("value")), alone.select("lang", F.col("t").alias("s"), F.col("sid").alias("t"), F.col("theirs").alias("value")), shared_corrections(postings)]
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    named = lambda c, a: groups.select("lang", F.col("sid").alias(c), F.col("source").alias(a))
    pairs = sums.groupBy("lang", "s", "t").agg(F.sum("value").alias("value")).join(named("s", "source"), ["lang", "s"]).join(named("t", "item"), ["lang", "t"])
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order))
    listed = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return listed(pairs, "pair").unionByName(listed(terms, "term"))
