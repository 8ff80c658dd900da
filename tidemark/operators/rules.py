"""Rule audits: health of renderings, ledgers and scans. Findings are rows with a code, a place and the measured value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import interval, sequence
from tidemark.operators.running import KEY, STRETCH, Running, most, running, total
from tidemark.operators.sequence import capped_end
from tidemark.operators.stages import stored

# Fixed limits of the health rules.
RUN, GAP, DISTINCT, COVERAGE, TOP, NEAR, VOCABULARY, ENOUGH_S, ENOUGH_N, SEGMENT = 4, 20.0, 0.5, 0.5, 0.10, 8, 5.0, 300.0, 20, 120.0


def top_share(segments: DataFrame) -> DataFrame:
    """(recording_id, top_text, top_share): the most common normalised text, the first seen among equals."""
    counts = segments.groupBy(KEY, tx.normalise("text").alias("top_text")).agg(F.count("*").alias("n"), F.min(F.struct("start_s", "ord")).alias("first"))
    best = counts.groupBy(KEY).agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("minus"), "first", "top_text")).alias("b"))
    return best.select(KEY, "b.top_text", (-F.col("b.minus") / F.col("all")).alias("top_share"))


def vocabulary(segments: DataFrame) -> DataFrame:
    """(recording_id, vocabulary): distinct content words."""
    return _vocabulary(segments.withColumn("content", F.array_distinct(tx.content_tokens("text"))))


def _vocabulary(worded: DataFrame) -> DataFrame:
    """vocabulary() of segments with content: words are gathered by stretch; those of several become rows, to meet again."""
    at = F.floor(F.col("start_s") / STRETCH).alias("_stretch")
    held = worded.groupBy(KEY, at).agg(F.array_distinct(F.flatten(F.collect_list("content"))).alias("words"))
    alone = F.count("*").over(Window.partitionBy(KEY)) == 1
    counts = F.when(alone, F.array(F.struct(F.lit(None).cast("string").alias("w"), F.size("words").alias("n")))).otherwise(F.transform("words", lambda w: F.struct(w.alias("w"), F.lit(1).alias("n"))))
    words = held.select(KEY, counts.alias("c")).select(KEY, F.explode("c").alias("c")).select(KEY, "c.w", "c.n").distinct()
    return words.groupBy(KEY).agg(F.sum("n").alias("vocabulary")).where("vocabulary > 0")


def _words(text: str | Column) -> Column:
    """(key, content, words) of a text: its tokens joined, those without a digit, and their number."""
    return F.transform(F.array(tx.tokens(text)), lambda t: F.struct(F.array_join(t, " ").alias("key"), F.array_distinct(F.filter(t, lambda w: ~w.rlike("[0-9]"))).alias("content"), F.size(t).cast("long").alias("words")))[0]


def _keyed(segments: DataFrame) -> DataFrame:
    """Segments with key, content and words of their texts."""
    return segments.withColumn("_w", _words("text")).select(KEY, "start_s", "ord", "end_s", "text", "_w.key", "_w.content", "_w.words")


#: Words of the row before. Of a stretch only the last text goes on to the next, and is cut into words there.
_LAST_WORDS = Running(
    lambda o: F.lag(F.struct("key", "content", "words")).over(o),
    lambda at, last: last(F.struct(F.col("text").alias("v")), at),
    lambda o, t: F.lag(t).over(o),
    lambda a, b: F.coalesce(a, F.when(b.isNotNull(), _words(b["v"]))),
)


def health(segments: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """One row of measures per recording, as the health rules read them.

    durations (recording_id, duration_s) are declared spans: recordings without a segment are among the rows then, and
    missing_s is what lacks at the end. Else the span is the last believed end.
    """
    keyed = _keyed(segments)
    read = running(
        keyed, sequence.ORDER,
        {"_reach": most(F.greatest(capped_end(), F.col("start_s"))), "_covered": most(capped_end()), "_last": _LAST_WORDS},
    )
    reach, covered = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) for c in ("_reach", "_covered"))
    earlier = F.coalesce("_last.content", F.array().cast("array<string>"))
    union, both = F.size(F.array_union("content", earlier)), F.size(F.array_intersect("content", earlier))
    scanned = read.select(
        KEY, "start_s", "ord", "end_s", "words", capped_end().alias("end_c"),
        (~F.coalesce((F.col("key") == F.col("_last.key")) & (F.col("key") != ""), F.lit(False))).alias("fresh"),
        (~F.coalesce((union > 0) & (both / union >= 0.8), F.lit(False))).alias("unlike"),
        (F.col("start_s") - reach > GAP).alias("gap"),
        F.greatest(capped_end() - F.greatest(F.col("start_s"), covered), F.lit(0.0)).alias("gain"),
    )
    # What follows reads rows without texts several times, so no text is cut into words for each of them.
    scanned = running(stored(scanned), sequence.ORDER, {"run": total(F.col("fresh").cast("long")), "near": total(F.col("unlike").cast("long"))})
    # The longest run is the largest of the runs' counts.
    longest = [scanned.groupBy(KEY, run).agg(F.count("*").alias("n")).groupBy(KEY).agg(F.max("n").alias(run)) for run in ("run", "near")]
    measured = scanned.groupBy(KEY).agg(
        F.count("*").alias("segments"), F.sum("words").alias("words"), F.count_if("gap").alias("gaps"), F.max("end_c").alias("span"), F.sum("gain").alias("gain"), F.max(F.col("end_s") - F.col("start_s")).alias("longest"),
    )
    measured = measured.join(longest[0], KEY).join(longest[1], KEY)
    texts = keyed.groupBy(KEY, "key").agg(F.count("*").alias("n")).groupBy(KEY).agg(F.count("*").alias("distinct"), F.max("n").alias("top"))
    rows = measured.join(texts, KEY).join(_vocabulary(keyed), KEY, "left").na.fill(0, ["vocabulary"])
    rows = rows.withColumn("missing_s", F.lit(0.0))
    if durations is not None:
        counted = ["segments", "words", "run", "near", "gaps", "distinct", "top", "vocabulary"]
        rows = durations.join(rows, KEY, "left").na.fill(0, counted).withColumn("missing_s", F.col("duration_s") - F.coalesce("span", F.lit(0.0))).withColumn("span", F.col("duration_s")).na.fill(0.0, ["gain", "longest"])
    return rows.select(
        KEY, "segments", "distinct", "words", "run", "near", "gaps", "span", "longest",
        "missing_s", F.when(F.col("segments") > 0, F.col("top") / F.col("segments")).otherwise(0.0).alias("top_share"),
        F.when(F.col("span") > 0, F.least(F.col("gain") / F.col("span"), F.lit(1.0))).otherwise(0.0).alias("coverage"),
        F.when(F.col("span") > 0, F.col("vocabulary") / (F.col("span") / 60)).otherwise(0.0).alias("per_minute"),
    )


def health_rules() -> dict[str, Column]:
    """Rule code -> condition over the measures."""
    enough = (F.col("span") >= ENOUGH_S) & (F.col("segments") >= ENOUGH_N)
    return {
        "E-TS-SEGMENT": F.col("longest") > SEGMENT,
        "E-TS-NEARLOOP": (F.col("near") >= NEAR) & (F.col("run") < RUN),
        "E-TS-DOMINANT": enough & (F.col("top_share") > TOP),
        "E-TS-SPARSE": enough & (F.col("coverage") < COVERAGE),
        "E-TS-VOCABULARY": enough & (F.col("per_minute") < VOCABULARY),
        "E-TS-LOOP": F.col("run") >= RUN,
        "E-TS-REPEAT": (F.col("segments") > 0) & (F.col("distinct") < DISTINCT * F.col("segments")),
        "E-TS-GAP": F.col("gaps") > 0,
        "E-TS-EMPTY": F.col("segments") == 0,
        "E-TS-SHORT": F.col("missing_s") > GAP,
    }


def health_defects(measures: DataFrame) -> DataFrame:
    """(recording_id, code) of every rule that a recording breaks."""
    codes = F.array(*(F.when(condition, F.lit(code)) for code, condition in health_rules().items()))
    return measures.select(KEY, F.explode(F.array_compact(codes)).alias("code"))


def fingerprints(segments: DataFrame) -> DataFrame:
    """(recording_id, fingerprint): digest of the starts and normalised texts, in order."""
    line = F.concat(F.format_string("%.2f", "start_s"), F.lit("\t"), tx.normalise("text"))
    held = segments.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("start_s", "ord", line.alias("line")))).alias("rows"))
    return held.select(KEY, F.sha2(F.array_join(F.col("rows.line"), "\n"), 256).alias("fingerprint"))


def coarse(segments: DataFrame, reach: float = 30.0, median: float = 10.0) -> DataFrame:
    """Shapes of recordings, and whether their segments are too long to cite."""
    return interval.shape(segments).withColumn("is_coarse", (F.col("reach") > reach) & (F.col("median_span") > median))


def excused(defects: DataFrame, ledger: DataFrame, undated: bool = True) -> DataFrame:
    """Defects (key, as_of, ...) with exempt: a ledger row (key, reason) begins with a real date not before the note's.

    undated: whether a row reaches defects without a date.
    """
    until = F.try_to_date(F.substring("reason", 1, 10), "yyyy-MM-dd")
    dated = ledger.select("key", until.alias("until")).where("until is not null").groupBy("key").agg(F.max("until").alias("until"))
    return defects.join(dated, "key", "left").withColumn("exempt", F.when(F.col("until").isNull(), False).when(F.col("as_of").isNull(), undated).otherwise(F.col("as_of") <= F.col("until")))


def stale(ledger: DataFrame, defects: DataFrame) -> DataFrame:
    """Ledger rows that excuse nothing any more."""
    return ledger.join(defects.select("key").distinct(), "key", "left_anti")


def truth_vs_claim(truth: DataFrame, claims: DataFrame) -> DataFrame:
    """(name, verdict): correct, mispaired, unread (only true) or extra (only claimed). truth, claims: name, code."""
    both = truth.select("name", F.col("code").alias("true_code")).join(claims.select("name", F.col("code").alias("claimed_code")), "name", "full_outer")
    verdict = F.when(F.col("claimed_code").isNull(), "unread").when(F.col("true_code").isNull(), "extra").when(F.col("true_code") == F.col("claimed_code"), "correct").otherwise("mispaired")
    return both.select("name", verdict.alias("verdict"))
