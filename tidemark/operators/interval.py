"""Intervals: coalescing, coverage, differences, and joins by time.

Joins by time are equi-joins on (recording_id, time bucket) with the exact condition as a residual, so they shuffle and
spread like any other equi-join, also within one long recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import KEY, latest, most, previous, running, total
from tidemark.operators.sequence import ORDER, SEGMENT_CAP, capped_end


def coalesce_spans(spans: DataFrame, gap: float = 0.0) -> DataFrame:
    """(recording_id, start_s, end_s, merged): spans joined while the next starts within gap of the end so far."""
    reached = running(spans.select(KEY, "start_s", "end_s", "ord"), ORDER, {"reach": most(F.col("end_s"))})
    fresh = F.coalesce(F.col("start_s") > F.col("reach") + gap, F.lit(True))
    marked = running(reached.withColumn("fresh", fresh.cast("long")), ORDER, {"island": total(F.col("fresh"))})
    return marked.groupBy(KEY, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("merged")).drop("island")


def merge_spans(spans: DataFrame) -> DataFrame:
    """Coalesced spans without those that end no later than they start."""
    return coalesce_spans(spans.where("end_s > start_s"))


def union_length(spans: DataFrame) -> DataFrame:
    """(recording_id, claimed_s): seconds that some span covers."""
    return merge_spans(spans).groupBy(KEY).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("claimed_s"))


def difference(claims: DataFrame, covers: DataFrame, widen: float = 0.5) -> DataFrame:
    """(recording_id, start_s, end_s) of claimed stretches that no cover, widened on both sides, reaches.

    A sweep over begin and end events; claims and covers have recording_id, start_s, end_s, ord.
    """
    claims = claims.where("end_s > start_s")
    covers = covers.where("end_s > start_s").select(KEY, (F.col("start_s") - widen).alias("start_s"), (F.col("end_s") + widen).alias("end_s"))

    def events(spans: DataFrame, claim: int) -> DataFrame:
        sides = F.array(F.struct(F.col("start_s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_s").alias("t"), F.lit(-1).alias("d")))
        out = spans.select(KEY, F.explode(sides).alias("e"))
        return out.select(KEY, "e.t", (F.col("e.d") * claim).alias("claim"), (F.col("e.d") * (1 - claim)).alias("cover"))

    moments = events(claims, 1).union(events(covers, 0)).groupBy(KEY, "t").agg(F.sum("claim").alias("claim"), F.sum("cover").alias("cover"))
    summed = running(moments, ["t"], {"claim": total(F.col("claim")), "cover": total(F.col("cover"))})
    ended = running(summed, ["t"], {"end_s": previous(F.col("t"))}, backwards=True)
    open_ = ended.select(KEY, F.col("t").alias("start_s"), "end_s", "claim", "cover", F.lit(0).alias("ord"))
    return coalesce_spans(open_.where("claim > 0 and cover = 0 and end_s > start_s")).drop("merged")


def coverage(segments: DataFrame, spans: DataFrame | None = None, cap: float = SEGMENT_CAP) -> DataFrame:
    """(recording_id, covered): share of a recording's span under some segment; the span is the last capped end.

    spans (recording_id, span_s) gives declared spans instead.
    """
    segments = running(segments, ORDER, {"reach": most(capped_end(cap))})
    reach = F.greatest(F.coalesce("reach", F.lit(0.0)), F.lit(0.0))
    own = segments.select(KEY, capped_end(cap).alias("end_c"), F.greatest(capped_end(cap) - F.greatest("start_s", reach), F.lit(0.0)).alias("gain"))
    total = own.groupBy(KEY).agg(F.sum("gain").alias("gain"), F.max("end_c").alias("span_s"))
    if spans is not None:
        total = total.drop("span_s").join(spans, KEY)
    return total.select(KEY, F.when(F.col("span_s") > 0, F.least(F.col("gain") / F.col("span_s"), F.lit(1.0))).otherwise(0.0).alias("covered"))


def band_join(left: DataFrame, right: DataFrame, low: Column, high: Column, right_low: Column, right_high: Column, width: float) -> DataFrame:
    """Pairs of a recording whose intervals [low, high] and [right_low, right_high] meet, ends included.

    Each side is listed in the width-second buckets that it touches; a pair is kept in the first bucket that both touch.
    Columns of both sides other than recording_id must have different names. A null bound meets nothing.
    """

    def listed(df: DataFrame, lo: Column, hi: Column, name: str) -> DataFrame:
        first, last = F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long")
        return df.where(lo <= hi).withColumn(f"{name}_first", first).withColumn("bucket", F.explode(F.sequence(first, last)))

    pairs = listed(left, low, high, "l").join(listed(right, right_low, right_high, "r"), [KEY, "bucket"])
    pairs = pairs.where((F.col("bucket") == F.greatest("l_first", "r_first")) & (right_low <= high) & (right_high >= low))
    return pairs.drop("bucket", "l_first", "r_first")


def points_in(points: DataFrame, spans: DataFrame, width: float) -> DataFrame:
    """Points (recording_id, at_s, ...) with the spans that hold them (in_start, in_end), ends included."""
    named = spans.select(KEY, F.col("start_s").alias("in_start"), F.col("end_s").alias("in_end"))
    return band_join(points, named, F.col("at_s"), F.col("at_s"), F.col("in_start"), F.col("in_end"), width)


def nearest(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Points (recording_id, point_id, at_s) with the nearest frame (frame_s); of two as near, the earlier.

    One ordered pass over both tables: the last frame before and the first one after each point.
    """
    both = points.select(KEY, "point_id", "at_s", F.lit(None).cast("double").alias("frame")).unionByName(frames.select(KEY, F.lit(None).cast("long").alias("point_id"), F.col("frame_s").alias("at_s"), F.col("frame_s").alias("frame")))
    # Frames come before points of the same second, however the order is read.
    both = both.withColumn("_late", F.col("frame").isNull().cast("int"))
    low = running(both, ["at_s", "_late"], {"lo": latest(F.col("frame"))})
    found = running(low, ["at_s", "_late"], {"hi": latest(F.col("frame"))}, backwards=True).where("point_id is not null")
    # A frame at the point's own second stands before it, so the backward reading misses it; the forward one has it.
    pick = F.when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo")).when(F.col("at_s") - F.col("lo") <= F.col("hi") - F.col("at_s"), F.col("lo")).otherwise(F.col("hi"))
    return found.select(KEY, "point_id", "at_s", pick.alias("frame_s"))


def widest_gap(frames: DataFrame, durations: DataFrame) -> DataFrame:
    """(recording_id, gap_start, gap_s): the first widest gap among 0, the frames and the duration."""
    edges = frames.select(KEY, F.col("frame_s").alias("t")).union(durations.select(KEY, F.lit(0.0))).union(durations.select(KEY, "duration_s"))
    steps = running(edges, ["t"], {"next": previous(F.col("t"))}, backwards=True)
    steps = steps.select(KEY, F.col("t").alias("gap_start"), (F.col("next") - F.col("t")).alias("gap_s")).where("gap_s is not null")
    best = steps.groupBy(KEY).agg(F.max(F.struct("gap_s", (-F.col("gap_start")).alias("s"))).alias("b"))
    return best.select(KEY, (-F.col("b.s")).alias("gap_start"), "b.gap_s")


def coverage_ledger(frames: DataFrame, cited: DataFrame, durations: DataFrame) -> DataFrame:
    """(recording_id, frames, uncited, longest_span): frames no one cites, and the longest stretch between cited ones around one."""
    marked = frames.join(cited.select(KEY, "frame_s").distinct().withColumn("cited", F.col("frame_s")), [KEY, "frame_s"], "left")
    low = running(marked, ["frame_s"], {"_lo": latest(F.col("cited"), inclusive=False)})
    high = running(low, ["frame_s"], {"hi": latest(F.col("cited"), inclusive=False)}, backwards=True)
    spans = high.select(KEY, "cited", F.coalesce("_lo", F.lit(0.0)).alias("lo"), "hi").join(durations, KEY)
    free = F.col("cited").isNull()
    return spans.groupBy(KEY).agg(F.count("*").alias("frames"), F.count_if(free).alias("uncited"), F.max(F.when(free, F.coalesce("hi", "duration_s") - F.col("lo"))).alias("longest_span"))


def shape(segments: DataFrame) -> DataFrame:
    """(recording_id, median_span, longest_span, reach)."""
    span = F.col("end_s") - F.col("start_s")
    return segments.groupBy(KEY).agg(F.percentile(span, 0.5).alias("median_span"), F.max(span).alias("longest_span"), F.max("end_s").alias("reach"))
