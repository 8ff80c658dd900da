"""What becomes of decoder output: granularity and word-coverage decisions, chunks put together, lost spans, languages."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.words import LANGUAGES
from tidemark.operators import interval, sequence
from tidemark.operators.folds import folded
from tidemark.operators.running import KEY, numbered

# Fixed limits of the decisions.
SEAM_S, LOOP_RUN, SILENCE_S = 2.0, 4, 0.5
COARSE_REACH_S, COARSE_MEDIAN_S = 30.0, 10.0
HOLE_RUN_S, HOLE_SHARE, WORD_RATIO = 25.0, 0.015, 0.95
CHUNK = [KEY, "chunk"]


def shift(segments: DataFrame, offset: Column) -> DataFrame:
    """Segments moved by an offset, to two places; those of offset 0 stay as they are."""
    moved = lambda c: F.when(offset == 0, F.col(c)).otherwise(F.round(F.col(c) + offset, 2)).alias(c)
    return segments.select(*[moved(c) if c in ("start_s", "end_s") else F.col(c) for c in segments.columns])


def usable_words(words: DataFrame) -> DataFrame:
    """Word stamps with a text and times that are numbers; start_s and end_s may come as text."""
    cast = words.withColumn("start_s", F.col("start_s").try_cast("double")).withColumn("end_s", F.col("end_s").try_cast("double")).withColumn("text", F.trim("text"))
    return cast.where("text <> '' and start_s is not null and end_s is not null and not isnan(start_s) and not isnan(end_s)")


def words_inside(words: DataFrame, claimed: DataFrame, width: float = 60.0) -> DataFrame:
    """(recording_id, inside): words whose stamp touches a claimed span widened by the silence, ends not included.

    claimed: disjoint spans (recording_id, start_s, end_s).
    """
    numbered = words.select(KEY, F.monotonically_increasing_id().alias("word_id"), F.col("start_s").alias("w_start"), F.col("end_s").alias("w_end"), tx.word_count("text").alias("n"))
    spans = claimed.select(KEY, (F.col("start_s") - SILENCE_S).alias("c_start"), (F.col("end_s") + SILENCE_S).alias("c_end"))
    met = interval.band_join(numbered, spans, F.col("w_start"), F.col("w_end"), F.col("c_start"), F.col("c_end"), width)
    met = met.where("w_start < c_end and w_end > c_start").select(KEY, "word_id", "n").distinct()
    return met.groupBy(KEY).agg(F.sum("n").cast("long").alias("inside"))


def rebuild_decisions(served: DataFrame, words: DataFrame) -> DataFrame:
    """(recording_id, decision, hole_s, hole_at, rest_share, served_words, inside): what a decoder's answer is taken as.

    keep: its segments stand; rebuild: segments are made from its words; refused-run, refused-share, refused-words: the
    words leave out what its segments call speech. served: segments; words: usable word stamps.
    """
    claimed = interval.merge_spans(served)
    rebuilt = sequence.regroup_words(words)
    # Widened before empty spans are dropped: one word is a point, and the silence around it is covered.
    covers = rebuilt.select(KEY, (F.col("start_s") - SILENCE_S).alias("start_s"), (F.col("end_s") + SILENCE_S).alias("end_s"))
    holes = interval.difference(claimed, covers, 0.0)
    worst = holes.groupBy(KEY).agg(F.max(F.struct((F.col("end_s") - F.col("start_s")).alias("run"), (-F.col("start_s")).alias("minus"))).alias("w"), F.sum(F.col("end_s") - F.col("start_s")).alias("all_s"))
    shapes = interval.shape(served)
    own = served.groupBy(KEY).agg(F.sum(tx.word_count("text")).cast("long").alias("served_words"))
    total = claimed.groupBy(KEY).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("claimed_s"))
    spoken = words.groupBy(KEY).agg(F.count("*").alias("stamps"))
    everyone = served.select(KEY).union(words.select(KEY)).distinct()
    rows = everyone.join(shapes, KEY, "left").join(spoken, KEY, "left").join(worst, KEY, "left").join(total, KEY, "left").join(own, KEY, "left").join(words_inside(words, claimed), KEY, "left")
    rows = rows.na.fill(0, ["stamps", "served_words", "inside", "claimed_s", "all_s"])
    rows = rows.withColumn("hole_s", F.coalesce("w.run", F.lit(0.0))).withColumn("hole_at", -F.col("w.minus"))
    rows = rows.withColumn("rest_share", F.when(F.col("claimed_s") > 0, (F.col("all_s") - F.col("hole_s")) / F.col("claimed_s")).otherwise(0.0))
    coarse = F.col("reach").isNull() | ((F.col("reach") > COARSE_REACH_S) & (F.col("median_span") > COARSE_MEDIAN_S))
    decision = F.when((F.col("stamps") == 0) | ~coarse, "keep").when(F.col("hole_s") > HOLE_RUN_S, "refused-run").when(F.col("rest_share") > HOLE_SHARE, "refused-share")
    decision = decision.when((F.col("served_words") > 0) & (F.col("inside") < WORD_RATIO * F.col("served_words")), "refused-words").otherwise("rebuild")
    return rows.select(KEY, decision.alias("decision"), "hole_s", "hole_at", "rest_share", "served_words", "inside")


def from_response(served: DataFrame, words: DataFrame, texts: DataFrame, allow_untimed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments, refusals) of decoders' answers: rebuilt from words, as served, or one untimed segment of (recording_id, text)."""
    served = served.where(F.trim("text") != "")
    usable = usable_words(words)
    decided = rebuild_decisions(served, usable).select(KEY, "decision")
    kept = served.join(decided.where("decision = 'keep'"), KEY, "left_semi").select(KEY, "start_s", "end_s", "text")
    made = sequence.regroup_words(usable.join(decided.where("decision = 'rebuild'"), KEY, "left_semi")).select(KEY, "start_s", "end_s", "text")
    timed = served.select(KEY).union(usable.select(KEY)).distinct()
    bare = texts.where(F.trim("text") != "").join(timed, KEY, "left_anti")
    segments = kept.unionByName(made)
    refusals = decided.where("decision like 'refused%'").withColumnRenamed("decision", "reason")
    if allow_untimed:
        return segments.unionByName(bare.select(KEY, F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s"), F.trim("text").alias("text"))), refusals
    return segments, refusals.unionByName(bare.select(KEY, F.lit("untimed").alias("reason")))


def responsibility(plan: DataFrame) -> DataFrame:
    """(recording_id, chunk, from_s, to_s): the span that each chunk of (.., offset_s, keep_from, keep_to) answers for."""
    following = F.lead("offset_s").over(Window.partitionBy(KEY).orderBy("chunk"))
    return plan.select(*CHUNK, F.coalesce("keep_from", "offset_s").alias("from_s"), F.when(F.col("keep_from").isNotNull(), F.col("keep_to")).otherwise(following).alias("to_s"))


def looped_runs(chunks: DataFrame) -> DataFrame:
    """(recording_id, chunk, attempt, run): the longest run of equal texts of each attempt at a chunk."""
    own = Window.partitionBy(*CHUNK, "attempt").orderBy("start_s", "ord")
    keyed = chunks.withColumn("key", tx.normalise("text"))
    same = F.coalesce((F.col("key") == F.lag("key").over(own)) & (F.col("key") != ""), F.lit(False))
    runs = keyed.withColumn("same", same).withColumn("run", F.sum((~F.col("same")).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*CHUNK, "attempt", "run").agg(F.count("*").alias("n")).groupBy(*CHUNK, "attempt").agg(F.max("n").alias("run"))


def better_attempts(chunks: DataFrame) -> DataFrame:
    """The segments of each chunk's first attempt, or of its second where the first looped and the second does so less."""
    runs = looped_runs(chunks).groupBy(*CHUNK).agg(F.max(F.when(F.col("attempt") == 0, F.col("run"))).alias("first"), F.max(F.when(F.col("attempt") == 1, F.col("run"))).alias("second"))
    chosen = runs.select(*CHUNK, F.when((F.col("first") >= LOOP_RUN) & (F.col("second") < F.col("first")), 1).otherwise(0).alias("attempt"))
    return chunks.join(chosen, [*CHUNK, "attempt"], "left_semi")


def trimmed(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """Chunks' segments in the recording's time, cut to what each chunk keeps: from a seam before it (but for the first) to
    its end (open for the last). Without a keep zone nothing is cut."""
    ends = plan.groupBy(KEY).agg(F.max("chunk").alias("last"))
    rows = shift(chunks.join(plan.select(*CHUNK, "offset_s", "keep_from", "keep_to"), CHUNK).join(ends, KEY), F.col("offset_s"))
    lower = F.when(F.col("chunk") > 0, F.col("keep_from") - SEAM_S).otherwise(F.col("keep_from"))
    inside = (F.col("start_s") >= lower) & ((F.col("chunk") == F.col("last")) | (F.col("start_s") < F.col("keep_to")))
    return rows.where(F.col("keep_from").isNull() | inside)


def without_seam_repeats(rows: DataFrame) -> DataFrame:
    """(recording_id, chunk, ord, start_s, end_s, text) of trimmed() rows without the sentences at a chunk's head that the
    chunks before it kept.

    A segment that starts by SEAM_S after the edge (the last end kept so far) goes if its words are those of one kept that
    ends within four seams of the edge. What was kept decides on what comes: a fold that takes chunk after chunk.
    """

    def advance(state: list | None, rows: Iterable[tuple]) -> tuple[list[tuple], list | None]:
        kept = []
        for _, part in groupby(rows, key=lambda r: r[0]):
            own, state = take(state, list(part))
            kept += own
        return kept, state

    def take(state: list | None, part: list[tuple]) -> tuple[list[tuple], list]:
        edge, tail = state or (None, [])
        if edge is not None and any(keep_from is not None and keep_from == keep_from for *_, keep_from in part):
            known = {key for end, key in tail if end >= edge - 4 * SEAM_S}
            part = [r for r in part if not (r[1] <= edge + SEAM_S and r[5] in known)]
        if part:
            edge = max([r[3] for r in part] + ([] if edge is None else [edge]))
            tail = [[end, key] for end, key in [*tail, *([r[3], r[5]] for r in part)] if end >= edge - 4 * SEAM_S]
        return [r[:5] for r in part], [edge, tail]

    columns = ["chunk", "start_s", "ord", "end_s", "text", "key", "keep_from"]
    keyed = rows.withColumn("key", tx.normalise("text"))
    return folded(keyed, columns, ["chunk", "start_s", "ord"], "chunk long, start_s double, ord long, end_s double, text string", advance, stretch=1.0)


def assembled(chunks: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, lost): all chunks' better attempts as one recording, and the spans that no segment came of.

    chunks: recording_id, chunk, attempt, ord, start_s, end_s, text; plan: recording_id, chunk, offset_s, keep_from, keep_to,
    failed (null, or why the decoder gave nothing).
    """
    best = better_attempts(chunks)
    kept = without_seam_repeats(trimmed(best, plan))
    some, any_left = best.select(*CHUNK).distinct().withColumn("decoded", F.lit(True)), kept.select(*CHUNK).distinct()
    spans = plan.select(*CHUNK, "failed").join(responsibility(plan), CHUNK).join(any_left, CHUNK, "left_anti").join(some, CHUNK, "left")
    reason = F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("decoded"), "failed").otherwise("empty")
    placed = numbered(kept.withColumnRenamed("ord", "_ord"), ["chunk", "start_s", "_ord"], "ord", stretch=1.0)
    return placed.select(KEY, "ord", "start_s", "end_s", "text"), spans.select(KEY, "from_s", "to_s", reason.alias("reason"))


def language_code(value: Column) -> Column:
    """The code of a language given as a code, a name, or a tag with a region; null for anything else."""
    key = F.lower(F.trim(value))
    codes = F.create_map(*(F.lit(x) for code, name in LANGUAGES.items() for x in (code, code)))
    names = F.create_map(*(F.lit(x) for code, name in LANGUAGES.items() for x in (name, code)))
    tag = F.regexp_replace(key, "_", "-")
    primary = F.when(tag.contains("-"), F.substring_index(tag, "-", 1))
    return F.coalesce(F.try_element_at(codes, key), F.try_element_at(names, key), F.try_element_at(codes, primary))


def pinned_language(chunks: DataFrame) -> DataFrame:
    """Chunks (recording_id, chunk, configured, declared, detected) with pin and mismatch.

    The configured language, else the declared one, else the first that was detected; later detections never move it.
    """
    order = Window.partitionBy(KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    auto = F.when(F.lower(F.trim("configured")) != "auto", F.col("configured"))
    rows = chunks.withColumn("found", language_code(F.col("detected")))
    pin = F.coalesce(language_code(auto), language_code(F.col("declared")), F.first("found", True).over(order))
    return rows.withColumn("pin", pin).withColumn("mismatch", F.coalesce(F.col("found") != F.col("pin"), F.lit(False))).drop("found")


def lone_renderings(segments: DataFrame) -> DataFrame:
    """(recording_id) of recordings with fewer than two renderings (rendering_id), which nothing can contradict."""
    return segments.groupBy(KEY).agg(F.count_distinct("rendering_id").alias("renderings")).where("renderings < 2").select(KEY)


def loop_spans(chunks: DataFrame) -> DataFrame:
    """(recording_id, chunk, attempt, run) of attempts that looped."""
    return looped_runs(chunks).where(F.col("run") >= LOOP_RUN)
