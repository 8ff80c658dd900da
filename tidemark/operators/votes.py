"""Votes of pixels and captions on what notes claim. They promote and flag; they never change a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import notes, witness
from tidemark.operators.sequence import KEY

# Fixed limits of the pixel vote.
TEXTFUL_WORDS, USABLE_SHARE, WINDOW_S = 5, 0.25, 30.0
AUDIO_CLASSES = ["SPOKEN", "INFERRED"]


def textful(words: Column) -> Column:
    return words >= TEXTFUL_WORDS


def channel(index: DataFrame) -> DataFrame:
    """(recording_id, frames, textful, usable) of an OCR index (recording_id, second, words, tokens)."""
    rows = index.groupBy(KEY).agg(F.count("*").alias("frames"), F.count_if(textful(F.col("words"))).alias("textful"))
    return rows.withColumn("usable", F.col("textful") / F.col("frames") >= USABLE_SHARE)


def pixel_claims(lined: DataFrame) -> DataFrame:
    """(recording_id, block, class, token, seconds) of items with one class, an anchor and a proper noun; quotes don't vote."""
    items = notes.items(lined).where("not verbatim")
    flat = F.regexp_replace("raw", "\n", " ")
    classes = F.array_distinct(F.regexp_extract_all(flat, F.lit(notes.CLASS_MARK), F.lit(0)))
    stamps = F.regexp_extract_all(flat, F.lit(rf"`\[({notes.STAMP})\]`"), F.lit(1))
    rows = items.select(KEY, "block", classes.alias("classes"), F.transform(stamps, _seconds).alias("seconds"), tx.candidates(flat).alias("tokens"))
    rows = rows.where((F.size("classes") == 1) & (F.size("seconds") > 0) & (F.size("tokens") > 0))
    return rows.select(KEY, "block", F.translate(F.get("classes", F.lit(0)), "`", "").alias("class"), F.explode("tokens").alias("token"), "seconds")


def _seconds(stamp: Column) -> Column:
    return F.aggregate(F.split(stamp, ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))


def pixel_vote(lined: DataFrame, index: DataFrame) -> DataFrame:
    """(recording_id, block, class, token, seen, edits, verdict): PROMOTE, FLAG or null for each claimed name.

    A name is witnessed if a textful frame near one of its item's moments shows it within the tolerance. Witnessed names of
    audio classes are promoted, unwitnessed ones of the pixel class flagged; recordings with few textful frames don't vote.
    """
    claims = pixel_claims(lined).join(channel(index).where("usable").select(KEY), KEY, "left_semi")
    wanted = claims.select(KEY, F.concat_ws("-", KEY, "block").alias("item_id"), "token", F.explode(F.array_distinct("seconds")).alias("at_s"))
    seen = index.where(textful(F.col("words"))).select(KEY, F.col("second").cast("double").alias("seen_s"), F.col("second").cast("long").alias("ord"), F.explode("tokens").alias("seen"))
    best = witness.fuzzy_matches(wanted, seen, WINDOW_S).select(KEY, "item_id", "token", "seen", "edits")
    rows = claims.withColumn("item_id", F.concat_ws("-", KEY, "block")).join(best, [KEY, "item_id", "token"], "left")
    witnessed = F.col("seen").isNotNull()
    verdict = F.when(witnessed & F.col("class").isin(AUDIO_CLASSES), "PROMOTE").when(~witnessed & (F.col("class") == "ON-SCREEN"), "FLAG")
    return rows.select(KEY, "block", "class", "token", "seen", "edits", verdict.alias("verdict"))


def spoken_scores(found: DataFrame, lined: DataFrame, segments: DataFrame, durations: DataFrame) -> DataFrame:
    """(recording_id, line_no, anchor, class, words, hits, kind) of every anchor that isn't quoted.

    kind: beyond the recording, unscorable (few words), witnessed or unwitnessed for SPOKEN ones; candidate where an anchor
    without one class passes, else unattributed; other for the rest.
    """
    at = found.where("class <> 'VERBATIM'").withColumn("item_id", F.concat_ws("-", KEY, "block", "k"))
    words = notes.items(lined).select(KEY, "block", tx.item_words("raw").alias("words"))
    at = at.join(words, [KEY, "block"])
    scored = witness.spoken_hits(at.select(KEY, "item_id", "at_s", "words"), segments, words=tx.item_words).select(KEY, "item_id", "hits")
    rows = at.join(scored, [KEY, "item_id"]).join(durations, KEY, "left")
    n, free = F.size("words"), F.col("class").isin("NONE", "MULTI", "CONTESTED")
    passed = F.coalesce(witness.passes(F.col("hits"), n), F.lit(False))
    kind = F.when((F.col("duration_s") > 0) & (F.col("at_s") > F.col("duration_s")), "beyond").when(n < witness.ITEM_WORDS, "unscorable")
    kind = kind.when(F.col("class") == "SPOKEN", F.when(passed, "witnessed").otherwise("unwitnessed")).when(free, F.when(passed, "candidate").otherwise("unattributed")).otherwise("other")
    return rows.select(KEY, "line_no", "anchor", "class", n.cast("long").alias("words"), "hits", kind.alias("kind"))


def spoken_census(scores: DataFrame) -> DataFrame:
    """One row per note: anchors, spoken ones by outcome, and candidates without a class."""
    spoken = F.col("class") == "SPOKEN"
    of = lambda kind, only=F.lit(True): F.count_if((F.col("kind") == kind) & only)
    return scores.groupBy(KEY).agg(
        F.count("*").alias("anchors"), F.count_if(spoken).alias("spoken"), of("witnessed").alias("witnessed"), of("unwitnessed").alias("unwitnessed"),
        of("unscorable", spoken).alias("short"), of("beyond", spoken).alias("beyond"), of("unscorable").alias("unscorable"), of("candidate").alias("candidates"),
        (of("candidate") + of("unattributed")).alias("unattributed"),
    )
