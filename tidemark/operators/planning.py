"""Plans: overlapping windows, chapters, chunks, decode windows, samples and budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.functions import text as tx
from tidemark.operators.interval import band_join
from tidemark.operators.sequence import KEY

MAX_WINDOWS = 10_000


def window_starts(totals: DataFrame, window: float = 600.0, overlap: float = 90.0) -> DataFrame:
    """(recording_id, window_no, lo_s, hi_s) for (recording_id, total_s).

    A last window that adds less than the overlap is absorbed. Raises for a geometry that doesn't advance; a recording
    of more than MAX_WINDOWS windows fails when it is planned.
    """
    stride = window - overlap
    if not (math.isfinite(window) and math.isfinite(overlap)) or window <= 0 or overlap < 0 or stride <= 0:
        raise ValueError(f"windows of {window} s that overlap by {overlap} s don't advance")
    count = F.ceil(F.col("total_s") / stride).cast("int")
    short = (count > 1) & (F.col("total_s") - (count - 1) * stride - overlap < overlap)
    n = F.when(short, count - 1).otherwise(count)
    checked = totals.where("total_s > 0").withColumn("n", F.when(F.col("total_s") / stride > MAX_WINDOWS, F.raise_error(F.lit("more windows than any recording has"))).otherwise(n))
    numbered = checked.select(KEY, "total_s", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    hi = F.when(F.col("k") == F.col("n") - 1, F.col("total_s")).otherwise(F.least(F.col("total_s"), F.col("k") * stride + window))
    return numbered.select(KEY, (F.col("k") + 1).alias("window_no"), (F.col("k") * F.lit(float(stride))).alias("lo_s"), hi.alias("hi_s"))


def totals(segments: DataFrame) -> DataFrame:
    return segments.groupBy(KEY).agg(F.greatest(F.max("end_s"), F.max("start_s")).alias("total_s"))


def members(segments: DataFrame, windows: DataFrame, width: float = 600.0) -> DataFrame:
    """Segments with each window that they touch; a segment that ends before it starts needs both ends to do so."""
    start, end = F.col("start_s"), F.col("end_s")
    # start <= hi and end >= lo, also for reversed segments, whose bucket range is that of [end, start].
    pairs = band_join(segments, windows, F.least(start, end), F.greatest(start, end), F.col("lo_s"), F.col("hi_s"), width)
    return pairs.where((start <= F.col("hi_s")) & (end >= F.col("lo_s")))


def window_rows(members: DataFrame) -> DataFrame:
    """One row per window with members: bounds, segments, words, first and last text."""
    words = F.size(tx.tokens("text"))
    return members.groupBy(KEY, "window_no").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("segments"), F.sum(words.cast("long")).alias("words"), F.min_by("text", F.struct("start_s", "ord")).alias("first_text"), F.max_by("text", F.struct(F.col("start_s"), -F.col("ord"))).alias("last_text"))


def windows(segments: DataFrame, window: float = 600.0, overlap: float = 90.0) -> DataFrame:
    return window_rows(members(segments, window_starts(totals(segments), window, overlap), window))


def orphans(segments: DataFrame, found: DataFrame) -> DataFrame:
    """Segments in no window; found: the members."""
    return segments.join(found.select(KEY, "ord").distinct(), [KEY, "ord"], "left_anti")


def overfull(segments: DataFrame, found: DataFrame, window: float, stacked: float = 3.0, share: float = 0.9) -> DataFrame:
    """(recording_id, biggest_share, stacking, is_overfull): claimed seconds against reach, and the fullest window's share."""
    totals_ = segments.groupBy(KEY).agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0))).alias("claimed"), F.max("end_s").alias("reach"))
    biggest = found.groupBy(KEY, "window_no").agg(F.count("*").alias("held")).groupBy(KEY).agg(F.max("held").alias("held"), F.count("*").alias("windows"))
    out = totals_.join(biggest, KEY)
    full = (F.col("windows") > 1) & ((F.col("biggest_share") > share) | (F.col("stacking") > stacked))
    return out.select(KEY, "windows", (F.col("held") / F.col("n")).alias("biggest_share"), (F.col("claimed") / F.col("reach")).alias("stacking")).select("*", full.alias("is_overfull"))


def chunks(totals: DataFrame, size: Column, limit: float) -> DataFrame:
    """(recording_id, chunk, offset_s, length_s): equal chunks, as few as keep each one's share of size within limit.

    Offsets are whole milliseconds and a chunk lasts until the next one's offset, so no seam is lost or doubled.
    """
    rows = totals.withColumn("n", F.greatest(F.lit(1), F.ceil(size / limit)).cast("int"))
    rows = rows.select(KEY, "total_s", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    offset = lambda k: F.round(F.col("total_s") / F.col("n") * k, 3)
    end = F.when(F.col("chunk") + 1 < F.col("n"), offset(F.col("chunk") + 1)).otherwise(F.col("total_s"))
    return rows.select(KEY, "chunk", offset(F.col("chunk")).alias("offset_s"), F.round(end - offset(F.col("chunk")), 3).alias("length_s"))


def decode_windows(totals: DataFrame, window: float = 240.0, overlap: float = 30.0) -> DataFrame:
    """(recording_id, chunk, offset_s, length_s, keep_from, keep_to): contiguous keep zones with context on both sides."""
    kept = window - 2 * overlap
    if kept <= 0:
        raise ValueError("the context leaves nothing to keep")
    whole = F.col("total_s") <= window
    n = F.when(whole, 1).otherwise(F.ceil(F.col("total_s") / kept)).cast("int")
    rows = totals.where("total_s > 0").withColumn("n", n).select(KEY, "total_s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    low, high = F.col("chunk") * F.lit(float(kept)), F.when(whole, F.col("total_s")).otherwise(F.least(F.col("total_s"), (F.col("chunk") + 1) * F.lit(float(kept))))
    offset = F.greatest(F.lit(0.0), low - overlap)
    return rows.select(KEY, "chunk", offset.alias("offset_s"), (F.least(F.col("total_s"), high + overlap) - offset).alias("length_s"), low.alias("keep_from"), high.alias("keep_to"))


def trim_to_keep(segments: DataFrame, plan: DataFrame, width: float = 240.0) -> DataFrame:
    """Segments with the chunk whose keep zone holds their start; the last zone also holds what starts later."""
    last = Window.partitionBy(KEY)
    zones = plan.select(KEY, "chunk", "keep_from", "keep_to", F.max("chunk").over(last).alias("last_chunk"))
    pairs = band_join(segments, zones, F.col("start_s"), F.col("start_s"), F.col("keep_from"), F.col("keep_to"), width)
    inside = pairs.where((F.col("start_s") < F.col("keep_to")) | (F.col("chunk") == F.col("last_chunk")))
    beyond = segments.join(zones.where("chunk = last_chunk"), KEY).where("start_s > keep_to")
    return inside.unionByName(beyond).drop("keep_from", "keep_to", "last_chunk")


def thin_spans(first: DataFrame, second: DataFrame, spans: DataFrame, ratio: float = 0.75, least: int = 100, width: float = 240.0) -> DataFrame:
    """Spans (recording_id, chunk, lo_s, hi_s) in which the first rendering has far fewer words than the second."""

    def words(segments: DataFrame, name: str) -> DataFrame:
        counted = segments.select(KEY, F.col("start_s").alias("at_s"), tx.word_count("text").cast("long").alias("w"))
        held = band_join(counted, spans, F.col("at_s"), F.col("at_s"), F.col("lo_s"), F.col("hi_s"), width).where("at_s < hi_s")
        return held.groupBy(KEY, "chunk").agg(F.sum("w").alias(name))

    both = words(second, "second_words").join(words(first, "first_words"), [KEY, "chunk"], "left").na.fill(0, ["first_words"])
    return both.where((F.col("second_words") >= least) & (F.col("first_words") < ratio * F.col("second_words")))


def even_sample(frames: DataFrame, n: int) -> DataFrame:
    """n of each recording's frames at even ranks (halves to the even rank), first and last included; all if there are fewer."""
    order = Window.partitionBy(KEY).orderBy("ts", "idx")
    ranked = frames.withColumn("rank", F.row_number().over(order) - 1)
    counts = frames.groupBy(KEY).agg(F.count("*").alias("count"))
    if n <= 1:
        return ranked.where("rank = 0").drop("rank") if n == 1 else ranked.limit(0).drop("rank")
    at = F.bround(F.col("i") * (F.col("count") - 1) / (n - 1), 0).cast("int")
    picks = counts.where(f"count > {n}").select(KEY, "count", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(KEY, at.alias("rank")).distinct()
    picks = picks.union(counts.where(f"count <= {n}").select(KEY, F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1))))
    return ranked.join(picks, [KEY, "rank"], "left_semi").drop("rank")


# Fixed values: (seconds up to, least frames, frames a second) for whole recordings and for a focused stretch; beyond
# the last the cap holds.
BUDGET = [(30, 12, 1), (60, 40, 0), (180, 60, 0), (600, 80, 0)]
FOCUS_BUDGET = [(5, 10, 6), (15, 30, 4), (30, 60, 0), (60, 80, 0)]


def frame_budget(durations: DataFrame, budget: list[tuple[int, int, int]] = BUDGET, cap: int = 100, most_fps: float = 2.0) -> DataFrame:
    """(recording_id, frames, fps) for (recording_id, duration_s)."""
    d = F.col("duration_s")
    wanted = F.lit(cap)
    for upto, least, rate in reversed(budget):
        wanted = F.when(d <= upto, F.greatest(F.lit(least), F.bround(d * rate, 0).cast("int"))).otherwise(wanted)
    fps = F.least(F.lit(most_fps), F.least(wanted, F.lit(cap)) / d)
    return durations.where("duration_s > 0").withColumn("fps", fps).select(KEY, F.least(F.lit(cap), F.greatest(F.lit(1), F.bround(F.col("fps") * d, 0).cast("int"))).alias("frames"), "fps")


def with_fallback(candidates: DataFrame, uniform: DataFrame, least: int = 8) -> DataFrame:
    """Candidate frames of recordings that have enough of them, and uniform frames of the others; engine names which.

    Both have recording_id and the same columns. Scenes need eight, keyframes four.
    """
    counts = candidates.groupBy(KEY).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(KEY)
    own = candidates.join(counts, KEY, "left_semi").withColumn("engine", F.lit("candidates"))
    return own.unionByName(uniform.join(counts, KEY, "left_anti").withColumn("engine", F.lit("uniform")))


def uniform_times(plan: DataFrame) -> DataFrame:
    """(recording_id, idx, ts) of (recording_id, offset_s, fps, frames): offset + i / fps, to two places."""
    rows = plan.where("frames > 0").select(KEY, "offset_s", "fps", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames").cast("long") - 1)).alias("idx"))
    return rows.select(KEY, "idx", F.round(F.col("offset_s") + F.col("idx") / F.col("fps"), 2).alias("ts"))


def requested_times(times: DataFrame, bounds: DataFrame, cap: int) -> DataFrame:
    """(recording_id, idx, ts, dropped): distinct requested seconds (two places) inside (low, high), an even sample of cap."""
    asked = times.select(KEY, F.round("at_s", 2).alias("ts")).distinct().join(bounds, KEY).where("ts >= low and ts <= high").select(KEY, "ts")
    sizes = asked.groupBy(KEY).agg(F.count("*").alias("asked"))
    order = F.row_number().over(Window.partitionBy(KEY).orderBy("ts")) - 1
    rows = asked.join(sizes, KEY).withColumn("at", order)
    step = F.when(F.col("asked") <= cap, F.lit(True)).otherwise(F.exists(F.sequence(F.lit(0), F.lit(max(cap - 1, 0))), lambda i: F.bround(i * (F.col("asked") - 1) / F.lit(max(cap - 1, 1))) == F.col("at")))
    kept = rows.where(step)
    return kept.select(KEY, (F.row_number().over(Window.partitionBy(KEY).orderBy("ts")) - 1).cast("long").alias("idx"), "ts", F.greatest(F.col("asked") - cap, F.lit(0)).alias("dropped"))


def batches(frames: DataFrame, size: int = 20) -> DataFrame:
    """Frames (recording_id, idx, ...) with the batch that they are reviewed in."""
    order = F.row_number().over(Window.partitionBy(KEY).orderBy("idx")) - 1
    return frames.withColumn("batch", F.floor(order / size).cast("long"))


def listed(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key (nth from 1), and one more row that says how many are left (rest); nothing is lost silently."""
    nth = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("nth", F.row_number().over(nth)).withColumn("rest", F.lit(None).cast("long"))
    left = rows.groupBy(*keys).agg((F.count("*") - most).alias("rest")).where("rest > 0").withColumn("nth", F.lit(most + 1))
    return ranked.where(F.col("nth") <= most).unionByName(left, allowMissingColumns=True)


def parse_moments(text: Column) -> Column:
    """Sorted distinct seconds of a comma-separated list; blanks are passed over, unreadable ones are null and come last."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(parts, clock.parse_time)))
