"""Evidence joins: words said or shown around a moment, and votes on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.interval import band_join
from tidemark.operators.sequence import KEY

WINDOW_S = 12.0
ITEM_WORDS, HITS, FRACTION = 6, 4, 0.25
SHIFTS = [15.0, 30.0, 60.0, 120.0, 300.0, 600.0]


def content_words(text: Column | str) -> Column:
    """Distinct words of four and more letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]{3,}"), F.lit(0)))


def passes(hits: Column, words: Column) -> Column:
    """Whether so many of an item's words are a witness."""
    return (hits >= HITS) & (hits / words >= FRACTION)


def spoken_hits(items: DataFrame, segments: DataFrame, window: float = WINDOW_S, words: Callable[[str], Column] = content_words) -> DataFrame:
    """(recording_id, item_id, words, hits): how many of an item's words segments within the window say.

    items: recording_id, item_id, at_s, words (an array). Matching is by (recording, bucket, word), so only words that
    both sides hold are compared, and no item's neighbourhood is gathered as a whole.
    """
    wanted = items.select(KEY, "item_id", "at_s", F.explode("words").alias("word"))
    said = segments.select(KEY, "start_s", "end_s", F.explode(words("text")).alias("word"))
    keyed = F.concat_ws("\0", KEY, "word")
    # The band join's key is (recording, bucket); here the recording's place is taken by (recording, word).
    left = wanted.select(keyed.alias(KEY), "item_id", F.col("at_s"))
    right = said.select(keyed.alias(KEY), "start_s", "end_s")
    met = band_join(left, right, F.col("at_s") - window, F.col("at_s") + window, F.col("start_s"), F.col("end_s"), 4 * window)
    hits = met.select(KEY, "item_id", "at_s").distinct().groupBy("item_id", "at_s").agg(F.count("*").alias("hits"))
    out = items.select(KEY, "item_id", "at_s", F.size("words").cast("long").alias("words")).join(hits, ["item_id", "at_s"], "left")
    return out.select(KEY, "item_id", "at_s", "words", F.coalesce("hits", F.lit(0)).alias("hits"))


def shift_control(items: DataFrame, segments: DataFrame, shifts: list[float] = SHIFTS, window: float = WINDOW_S) -> DataFrame:
    """(shift_s, items, passed, rate): the pass rate at the items' own seconds (0) and that far from them, either way."""
    moves = F.array(F.lit(0.0), *(F.lit(s * sign) for s in shifts for sign in (-1, 1)))
    moved = items.where(F.size("words") >= ITEM_WORDS).withColumn("move", F.explode(moves))
    moved = moved.withColumn("at_s", F.col("at_s") + F.col("move")).where("at_s >= 0")
    moved = moved.withColumn("item_id", F.concat_ws("|", "item_id", "move"))
    scored = spoken_hits(moved.select(KEY, "item_id", "at_s", "words"), segments, window)
    shift = F.abs(F.element_at(F.split("item_id", r"\|"), -1).cast("double"))
    return scored.groupBy(shift.alias("shift_s")).agg(F.count("*").alias("items"), F.count_if(passes(F.col("hits"), F.col("words"))).alias("passed")).withColumn("rate", F.col("passed") / F.col("items"))


def captions_around(moments: DataFrame, segments: DataFrame, window: float = 6.0) -> DataFrame:
    """(recording_id, at_s, captions): distinct texts within the window, in order of first appearance."""
    met = band_join(moments.select(KEY, "at_s"), segments, F.col("at_s") - window, F.col("at_s") + window, F.col("start_s"), F.col("end_s"), 8 * window)
    first = met.groupBy(KEY, "at_s", "text").agg(F.min(F.struct("start_s", "ord")).alias("first"))
    held = first.groupBy(KEY, "at_s").agg(F.array_sort(F.collect_list(F.struct("first", "text"))).alias("t"))
    return held.select(KEY, "at_s", F.array_join(F.col("t.text"), " ").alias("captions"))


def phrase_lookup(segments: DataFrame, phrases: list[str]) -> DataFrame:
    """(recording_id, ord, phrase) of segments whose normalised text holds a phrase; a short list of phrases.

    Only phrases that are there make rows.
    """
    plain = segments.select(KEY, "ord", tx.alnum("text").alias("plain"))
    held = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.instr(F.col("plain"), p) > 0)
    return plain.select(KEY, "ord", F.explode(held).alias("phrase"))


def fuzzy_matches(wanted: DataFrame, seen: DataFrame, window: float = 30.0) -> DataFrame:
    """(recording_id, item_id, token, seen, edits): the closest token seen within the window and the tolerance.

    wanted: recording_id, item_id, at_s, token; seen: recording_id, seen_s, ord, seen. Ties go to the first seen.
    Edits are bounded by the tolerance, which the token's length sets; lengths that differ by more are never compared.
    """
    met = band_join(wanted, seen, F.col("at_s") - window, F.col("at_s") + window, F.col("seen_s"), F.col("seen_s"), 4 * window)
    close = met.where(F.abs(F.length("token") - F.length("seen")) <= tx.tolerance(F.col("token")))
    close = close.withColumn("edits", tx.bounded_edits(F.lower("token"), F.lower("seen"), 2)).where(F.col("edits") <= tx.tolerance(F.col("token")))
    best = close.groupBy(KEY, "item_id", "token").agg(F.min_by(F.struct("seen", "edits"), F.struct("edits", "seen_s", "ord", "seen")).alias("b"))
    return best.select(KEY, "item_id", "token", "b.seen", "b.edits")


def dispositions(anchors: DataFrame, frames: DataFrame, cues: DataFrame, width: float) -> DataFrame:
    """(recording_id, anchor_id, class, disposition) of anchors with at_s and class (ON-SCREEN, SPOKEN, INFERRED or NONE).

    On screen: resolved on an exact frame second; spoken or inferred: resolved inside a cue. A class whose namespace the
    recording lacks is unchecked, unbound for inferences. Without a class: cross-referenced if exactly one class labels
    that second elsewhere in the recording, else unattributable.
    """
    second = F.floor("at_s").cast("long")
    anchors = anchors.withColumn("second", second)
    framed = frames.select(KEY, F.floor("frame_s").cast("long").alias("second")).distinct().withColumn("on_frame", F.lit(True))
    inside = band_join(anchors.select(KEY, "anchor_id", "at_s"), cues.select(KEY, "start_s", "end_s"), F.col("at_s"), F.col("at_s"), F.col("start_s"), F.col("end_s"), width)
    inside = inside.select(KEY, "anchor_id").distinct().withColumn("in_cue", F.lit(True))
    has_frames = frames.select(KEY).distinct().withColumn("has_frames", F.lit(True))
    has_cues = cues.select(KEY).distinct().withColumn("has_cues", F.lit(True))
    labels = anchors.where("class <> 'NONE'").groupBy(KEY, "second").agg(F.count_distinct("class").alias("classes"))
    joined = anchors.join(framed, [KEY, "second"], "left").join(inside, [KEY, "anchor_id"], "left").join(has_frames, KEY, "left").join(has_cues, KEY, "left").join(labels, [KEY, "second"], "left")
    found = F.when(F.col("class") == "NONE", F.when(F.col("classes") == 1, "cross-referenced").otherwise("unattributable"))
    found = found.when(F.col("class") == "ON-SCREEN", F.when(F.col("has_frames").isNull(), "unchecked").when(F.col("on_frame"), "resolved").otherwise("unresolved"))
    missing = F.when(F.col("class") == "SPOKEN", "unchecked-spoken").otherwise("unbound-inferred")
    found = found.otherwise(F.when(F.col("has_cues").isNull(), missing).when(F.col("in_cue"), "resolved").otherwise("unresolved"))
    return joined.select(KEY, "anchor_id", "class", found.alias("disposition"))


def partition_census(found: DataFrame) -> DataFrame:
    """(recording_id, disposition, anchors, of_all): counts that add up to the recording's anchors."""
    counts = found.groupBy(KEY, "disposition").agg(F.count("*").alias("anchors"))
    return counts.withColumn("of_all", F.sum("anchors").over(Window.partitionBy(KEY)))
