"""Queries over intervals and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import interval, planning, rules, sequence, witness
from tidemark.plans import views
from tidemark.plans.registry import Registry, r6
from tidemark.plans.views import with_views

_reg = Registry()
QUERIES, ORACLES = _reg.queries, _reg.oracles
query = _reg.query

_BEFORE = "(PARTITION BY recording_id ORDER BY start_s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SO_FAR = "(PARTITION BY recording_id ORDER BY start_s, ord ROWS UNBOUNDED PRECEDING)"
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9'']+')"


def _merged(source: str, gap: float = 0.0) -> str:
    return f"""(SELECT recording_id, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS merged FROM (SELECT *, sum(fresh) OVER {_SO_FAR} AS island FROM (SELECT *, CASE WHEN start_s > max(end_s) OVER {_BEFORE} + {gap} OR max(end_s) OVER {_BEFORE} IS NULL THEN 1 ELSE 0 END AS fresh FROM {source})) GROUP BY recording_id, island)"""


_WIDE = "(SELECT recording_id, ord, start_s, start_s + value * 60 AS end_s FROM seg_evt)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that last their value in minutes, so that some overlap."""
    return views.seg_evt(spark, sf_dir).select("recording_id", "ord", "start_s", (F.col("start_s") + F.col("value") * 60).alias("end_s"))


@query(with_views("SELECT recording_id, ord, start_s, round(end_s, 6) AS end_s FROM seg_conv WHERE end_s >= 15 AND start_s <= 30", "seg_conv"))
def segments_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that touch a closed range."""
    return views.seg_conv(spark, sf_dir).where("end_s >= 15 and start_s <= 30").select("recording_id", "ord", "start_s", r6("end_s"))


@query(with_views(f"""
WITH a AS (SELECT recording_id, least(end_s, start_s + 120) AS e, greatest(least(end_s, start_s + 120) - greatest(start_s, coalesce(max(least(end_s, start_s + 120)) OVER {_BEFORE}, 0)), 0) AS gain FROM seg_conv)
SELECT recording_id, round(CASE WHEN max(e) > 0 THEN least(sum(gain) / max(e), 1) ELSE 0 END, 6) AS covered FROM a GROUP BY 1""", "seg_conv"))
def coverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval.coverage(views.seg_conv(spark, sf_dir)).select("recording_id", r6("covered"))


@query(with_views(f"SELECT recording_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, merged FROM {_merged(_WIDE, 1.0)}", "seg_evt"))
def coalesce_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval.coalesce_spans(_wide(spark, sf_dir), 1.0).select("recording_id", r6("start_s"), r6("end_s"), "merged")


@query(with_views(f"SELECT recording_id, round(sum(end_s - start_s), 6) AS claimed_s FROM {_merged(f'(SELECT * FROM {_WIDE} WHERE end_s > start_s)')} GROUP BY 1", "seg_evt"))
def union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval.union_length(_wide(spark, sf_dir)).select("recording_id", r6("claimed_s"))


@query(with_views(f"""
WITH claim AS (SELECT * FROM {_merged("(SELECT recording_id, ord, start_s, start_s + value * 600 AS end_s FROM seg_evt WHERE text = 'view' AND value > 0)")}),
cover AS (SELECT * FROM {_merged("(SELECT recording_id, ord, start_s - 0.5 AS start_s, start_s + value * 60 + 0.5 AS end_s FROM seg_evt WHERE text = 'error' AND value > 0)")}),
edge AS (SELECT recording_id, start_s AS t FROM claim UNION SELECT recording_id, end_s FROM claim UNION SELECT recording_id, start_s FROM cover UNION SELECT recording_id, end_s FROM cover),
piece AS (SELECT recording_id, t AS start_s, lead(t) OVER (PARTITION BY recording_id ORDER BY t) AS end_s FROM edge),
hole AS (SELECT *, start_s AS ord FROM piece p WHERE end_s > start_s AND EXISTS (FROM claim c WHERE c.recording_id = p.recording_id AND c.start_s <= p.start_s AND c.end_s >= p.end_s) AND NOT EXISTS (FROM cover c WHERE c.recording_id = p.recording_id AND c.start_s <= p.start_s AND c.end_s >= p.end_s))
SELECT recording_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM {_merged("hole")}""", "seg_evt"))
def span_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed stretches that no cue covers."""
    claims = views.seg_evt(spark, sf_dir).where("text = 'view'").select("recording_id", "ord", "start_s", (F.col("start_s") + F.col("value") * 600).alias("end_s"))
    return interval.difference(claims, views.cue_evt(spark, sf_dir), 0.5).select("recording_id", r6("start_s"), r6("end_s"))


@query(with_views("SELECT recording_id, round(quantile_cont(end_s - start_s, 0.5), 6) AS median_span, round(max(end_s - start_s), 6) AS longest_span, round(max(end_s), 6) AS reach FROM seg_conv GROUP BY 1", "seg_conv"))
def segment_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval.shape(views.seg_conv(spark, sf_dir)).select("recording_id", r6("median_span"), r6("longest_span"), r6("reach"))


@query(with_views("SELECT recording_id, max(end_s) > 30 AND quantile_cont(end_s - start_s, 0.5) > 10 AS is_coarse FROM seg_conv GROUP BY 1", "seg_conv"))
def coarse_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.coarse(views.seg_conv(spark, sf_dir)).select("recording_id", "is_coarse")


_PLAN = """
total AS (SELECT recording_id, greatest(max(end_s), max(start_s)) AS total_s FROM seg_conv GROUP BY 1),
n AS (SELECT *, ceil(total_s / 24)::INT AS c FROM total WHERE total_s > 0), m AS (SELECT *, CASE WHEN c > 1 AND total_s - (c - 1) * 24 - 6 < 6 THEN c - 1 ELSE c END AS n FROM n),
win AS (SELECT recording_id, k + 1 AS window_no, k * 24.0::DOUBLE AS lo_s, CASE WHEN k = n - 1 THEN total_s ELSE least(total_s, k * 24.0::DOUBLE + 30) END AS hi_s FROM (SELECT *, unnest(range(n)) AS k FROM m)),
mem AS (SELECT s.*, window_no, lo_s, hi_s FROM seg_conv s JOIN win USING (recording_id) WHERE start_s <= hi_s AND end_s >= lo_s)"""


def _windowed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    segments = views.seg_conv(spark, sf_dir)
    return segments, planning.members(segments, planning.window_starts(planning.totals(segments), 30.0, 6.0), 30.0)


@query(with_views(f"WITH {_PLAN} SELECT recording_id, window_no, min(start_s) AS start_s, round(max(end_s), 6) AS end_s, count(*) AS segments, sum(len({_TOKENS}))::BIGINT AS words, arg_min(text, ord) AS first_text, arg_max(text, ord) AS last_text FROM mem GROUP BY 1, 2", "seg_conv"))
def overlapping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.window_rows(_windowed(spark, sf_dir)[1]).select("recording_id", "window_no", "start_s", r6("end_s"), "segments", "words", "first_text", "last_text")


@query(with_views(f"WITH {_PLAN} SELECT s.recording_id, s.ord FROM seg_conv s ANTI JOIN mem USING (recording_id, ord) UNION ALL SELECT recording_id, count(*) FROM mem GROUP BY 1", "seg_conv"))
def window_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in no window (there should be none), and each recording's number of memberships."""
    segments, found = _windowed(spark, sf_dir)
    return planning.orphans(segments, found).select("recording_id", "ord").union(found.groupBy("recording_id").agg(F.count("*").alias("ord")))


@query(with_views(f"""WITH {_PLAN}, t AS (SELECT recording_id, count(*) AS n, sum(greatest(end_s - start_s, 0)) AS claimed, max(end_s) AS reach FROM seg_conv GROUP BY 1),
b AS (SELECT recording_id, max(held) AS held, count(*) AS windows FROM (SELECT recording_id, window_no, count(*) AS held FROM mem GROUP BY 1, 2) GROUP BY 1)
SELECT recording_id, windows, round(held / n::DOUBLE, 6) AS biggest_share, round(claimed / reach, 6) AS stacking, windows > 1 AND (held / n::DOUBLE > 0.9 OR claimed / reach > 3) AS is_overfull FROM t JOIN b USING (recording_id)""", "seg_conv"))
def window_overfull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.overfull(*_windowed(spark, sf_dir), 30.0).select("recording_id", "windows", r6("biggest_share"), r6("stacking"), "is_overfull")


@query(with_views(f"""
WITH ch AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY ord) AS window_no, start_s AS lo_s, coalesce(lead(start_s) OVER (PARTITION BY recording_id ORDER BY ord), start_s + 60) AS hi_s FROM seg_conv WHERE role = 'user')
SELECT recording_id, window_no, min(start_s) AS start_s, round(max(end_s), 6) AS end_s, count(*) AS segments, sum(len({_TOKENS}))::BIGINT AS words FROM seg_conv s JOIN ch USING (recording_id) WHERE start_s <= hi_s AND end_s >= lo_s GROUP BY 1, 2""", "seg_conv"))
def chapter_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows from chapter marks: a chapter begins at each user turn."""
    segments = views.seg_conv(spark, sf_dir)
    order = Window.partitionBy("recording_id").orderBy("ord")
    marks = segments.where("role = 'user'").select("recording_id", F.row_number().over(order).alias("window_no"), F.col("start_s").alias("lo_s"), F.coalesce(F.lead("start_s").over(order), F.col("start_s") + 60).alias("hi_s"))
    return planning.window_rows(planning.members(segments, marks, 60.0)).select("recording_id", "window_no", "start_s", r6("end_s"), "segments", "words")


_TOTAL = "total AS (SELECT recording_id, greatest(max(end_s), max(start_s)) AS total_s FROM seg_conv GROUP BY 1)"


def _chunks_sql(size: str, limit: str) -> str:
    return f"""WITH {_TOTAL}, n AS (SELECT *, greatest(1, ceil({size} / {limit}))::INT AS n FROM total), k AS (SELECT *, unnest(range(n)) AS chunk FROM n)
SELECT recording_id, chunk, round(total_s / n * chunk, 3) AS offset_s, round(CASE WHEN chunk + 1 < n THEN round(total_s / n * (chunk + 1), 3) ELSE total_s END - round(total_s / n * chunk, 3), 3) AS length_s FROM k"""


@query(with_views(_chunks_sql("(total_s * 16000)", "400000::DOUBLE"), "seg_conv"))
def byte_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = planning.totals(views.seg_conv(spark, sf_dir))
    return planning.chunks(totals, F.col("total_s") * 16_000, 400_000.0)


@query(with_views(_chunks_sql("total_s", "20::DOUBLE"), "seg_conv"))
def second_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = planning.totals(views.seg_conv(spark, sf_dir))
    return planning.chunks(totals, F.col("total_s"), 20.0)


_DECODE = f"""{_TOTAL}, n AS (SELECT *, CASE WHEN total_s <= 24 THEN 1 ELSE ceil(total_s / 18) END::INT AS n FROM total WHERE total_s > 0),
z AS (SELECT recording_id, total_s, chunk, n, chunk * 18.0::DOUBLE AS keep_from, CASE WHEN total_s <= 24 THEN total_s ELSE least(total_s, (chunk + 1) * 18.0::DOUBLE) END AS keep_to FROM (SELECT *, unnest(range(n)) AS chunk FROM n)),
plan AS (SELECT *, greatest(0, keep_from - 3) AS offset_s, least(total_s, keep_to + 3) - greatest(0, keep_from - 3) AS length_s FROM z)"""


@query(with_views(f"WITH {_DECODE} SELECT recording_id, chunk, offset_s, round(length_s, 6) AS length_s, keep_from, round(keep_to, 6) AS keep_to FROM plan", "seg_conv"))
def decode_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = planning.decode_windows(planning.totals(views.seg_conv(spark, sf_dir)), 24.0, 3.0)
    return plan.select("recording_id", "chunk", "offset_s", r6("length_s"), "keep_from", r6("keep_to"))


@query(with_views(f"WITH {_DECODE} SELECT s.recording_id, s.ord, chunk FROM seg_conv s JOIN plan USING (recording_id) WHERE s.start_s >= keep_from AND (s.start_s < keep_to OR chunk = n - 1)", "seg_conv"))
def trim_to_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = views.seg_conv(spark, sf_dir)
    plan = planning.decode_windows(planning.totals(segments), 24.0, 3.0)
    return planning.trim_to_keep(segments, plan, 24.0).select("recording_id", "ord", "chunk")


_WORDS = "len(list_filter(regexp_split_to_array(trim(text, ' '), '[\\t\\n\\v\\f\\r ]+'), lambda w: w <> ''))"


@query(with_views(f"""WITH sp AS (SELECT recording_id, k AS chunk, k * 24.0::DOUBLE AS lo_s, k * 24.0::DOUBLE + 24 AS hi_s FROM (SELECT recording_id, unnest(range((floor(greatest(max(end_s), max(start_s)) / 24))::BIGINT + 1)) AS k FROM seg_conv GROUP BY 1)),
w AS (SELECT recording_id, chunk, sum(CASE WHEN role = 'assistant' THEN {_WORDS} ELSE 0 END)::BIGINT AS second_words, sum(CASE WHEN role = 'user' THEN {_WORDS} ELSE 0 END)::BIGINT AS first_words FROM seg_conv JOIN sp USING (recording_id) WHERE start_s >= lo_s AND start_s < hi_s GROUP BY 1, 2)
SELECT * FROM w WHERE second_words >= 100 AND first_words < 0.75 * second_words""", "seg_conv"))
def thin_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in which the user's turns hold far fewer words than the assistant's."""
    segments = views.seg_conv(spark, sf_dir)
    # A turn that starts at the very end of its recording lies in the span that starts there.
    last = F.floor(F.col("total_s") / 24.0).cast("int")
    spans = planning.totals(segments).select("recording_id", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    spans = spans.select("recording_id", "chunk", (F.col("chunk") * 24.0).alias("lo_s"), (F.col("chunk") * 24.0 + 24.0).alias("hi_s"))
    return planning.thin_spans(segments.where("role = 'user'"), segments.where("role = 'assistant'"), spans, width=24.0)


@query(with_views("""
WITH c AS (SELECT recording_id, count(*) AS n FROM frame_emb GROUP BY 1),
p AS (SELECT DISTINCT recording_id, round_even(i * (n - 1) / 14.0::DOUBLE, 0)::BIGINT AS idx FROM (SELECT *, unnest(range(15)) AS i FROM c WHERE n > 15) UNION SELECT recording_id, unnest(range(n)) FROM c WHERE n <= 15)
SELECT recording_id, idx, ts FROM frame_emb SEMI JOIN p USING (recording_id, idx)""", "frame_emb"))
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.even_sample(views.frame_emb(spark, sf_dir), 15).select("recording_id", "idx", "ts")


@query(with_views("""
WITH d AS (SELECT recording_id, greatest(max(end_s), max(start_s)) AS d FROM seg_conv GROUP BY 1), w AS (SELECT *, CASE WHEN d <= 30 THEN greatest(12, round_even(d, 0)) WHEN d <= 60 THEN 40 WHEN d <= 180 THEN 60 WHEN d <= 600 THEN 80 ELSE 100 END AS wanted FROM d WHERE d > 0),
f AS (SELECT *, least(2.0, least(wanted, 100) / d) AS fps FROM w)
SELECT recording_id, least(100, greatest(1, round_even(fps * d, 0)))::INT AS frames, round(fps, 6) AS fps FROM f""", "seg_conv"))
def frame_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = planning.totals(views.seg_conv(spark, sf_dir)).withColumnRenamed("total_s", "duration_s")
    return planning.frame_budget(totals).select("recording_id", "frames", r6("fps"))


@query(with_views("SELECT DISTINCT a.recording_id, anchor_id FROM anchor_evt a JOIN frame_evt f ON a.recording_id = f.recording_id AND floor(at_s / 600) = floor(frame_s / 600)", "anchor_evt", "frame_evt"))
def anchor_exact_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that share a ten-minute slot with a frame."""
    slot = lambda c: F.floor(F.col(c) / 600).alias("slot")
    frames = views.frame_evt(spark, sf_dir).select("recording_id", slot("frame_s"))
    return views.anchor_evt(spark, sf_dir).select("recording_id", "anchor_id", slot("at_s")).join(frames, ["recording_id", "slot"], "left_semi").select("recording_id", "anchor_id")


@query(with_views(f"SELECT a.recording_id, anchor_id, round(c.start_s, 6) AS in_start, round(c.end_s, 6) AS in_end FROM anchor_evt a JOIN {_merged('cue_evt', 1.0)} c ON a.recording_id = c.recording_id AND at_s BETWEEN c.start_s AND c.end_s", "anchor_evt", "cue_evt"))
def anchor_in_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = interval.coalesce_spans(views.cue_evt(spark, sf_dir), 1.0)
    found = interval.points_in(views.anchor_evt(spark, sf_dir), cues, 3600.0)
    return found.select("recording_id", "anchor_id", r6("in_start"), r6("in_end"))


@query(with_views("""
SELECT recording_id, anchor_id AS point_id, round(frame_s, 6) AS frame_s FROM (SELECT a.recording_id, anchor_id, frame_s, row_number() OVER (PARTITION BY anchor_id ORDER BY abs(frame_s - at_s), frame_s) AS k FROM anchor_evt a LEFT JOIN frame_evt f ON a.recording_id = f.recording_id) WHERE k = 1""", "anchor_evt", "frame_evt"))
def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.anchor_evt(spark, sf_dir).withColumnRenamed("anchor_id", "point_id")
    return interval.nearest(points, views.frame_evt(spark, sf_dir)).select("recording_id", "point_id", r6("frame_s"))


_CITED = "cited AS (SELECT DISTINCT f.recording_id, frame_s FROM frame_evt f JOIN anchor_evt a ON a.recording_id = f.recording_id AND floor(at_s / 3600) = floor(frame_s / 3600))"


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frames = views.frame_evt(spark, sf_dir).withColumn("slot", F.floor(F.col("frame_s") / 3600))
    anchors = views.anchor_evt(spark, sf_dir).select("recording_id", F.floor(F.col("at_s") / 3600).alias("slot"))
    return frames.drop("slot"), frames.join(anchors, ["recording_id", "slot"], "left_semi").select("recording_id", "frame_s").distinct()


@query(with_views(f"WITH {_CITED} SELECT recording_id, round(frame_s, 6) AS frame_s FROM frame_evt f ANTI JOIN cited USING (recording_id, frame_s)", "anchor_evt", "frame_evt"))
def uncited_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, cited = _cited(spark, sf_dir)
    return frames.join(cited, ["recording_id", "frame_s"], "left_anti").select("recording_id", r6("frame_s"))


@query(with_views(f"""
WITH {_CITED}, m AS (SELECT f.recording_id, f.frame_s, c.frame_s AS cited FROM frame_evt f LEFT JOIN cited c USING (recording_id, frame_s)),
s AS (SELECT *, coalesce(last_value(cited IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, first_value(cited IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame_s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM m)
SELECT recording_id, count(*) AS frames, count(*) FILTER (WHERE cited IS NULL) AS uncited, round(max(CASE WHEN cited IS NULL THEN coalesce(hi, duration_s) - lo END), 6) AS longest_span FROM s JOIN durations USING (recording_id) GROUP BY 1""", "anchor_evt", "frame_evt", "durations"))
def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interval.coverage_ledger(*_cited(spark, sf_dir), views.durations(spark, sf_dir))
    return found.select("recording_id", "frames", "uncited", r6("longest_span"))


@query(with_views("""
WITH e AS (SELECT recording_id, frame_s AS t FROM frame_evt UNION ALL SELECT recording_id, 0 FROM durations UNION ALL SELECT recording_id, duration_s FROM durations),
g AS (SELECT recording_id, t AS gap_start, lead(t) OVER (PARTITION BY recording_id ORDER BY t) - t AS gap_s FROM e)
SELECT recording_id, round(gap_start, 6) AS gap_start, round(gap_s, 6) AS gap_s FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY gap_s DESC, gap_start) AS k FROM g WHERE gap_s IS NOT NULL) WHERE k = 1""", "frame_evt", "durations"))
def widest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval.widest_gap(views.frame_evt(spark, sf_dir), views.durations(spark, sf_dir)).select("recording_id", r6("gap_start"), r6("gap_s"))


_BUCKETS = """b AS (SELECT recording_id, duration_s, unnest(range(floor(duration_s / 21600)::INT + 1)) AS b FROM durations),
dead AS (SELECT recording_id, b FROM b WHERE NOT EXISTS (FROM anchor_evt a WHERE a.recording_id = b.recording_id AND at_s BETWEEN 0 AND duration_s AND floor(at_s / 21600) = b.b))"""


@query(with_views(f"""
WITH {_BUCKETS}, r AS (SELECT recording_id, count(*) AS n, min(b) AS f FROM (SELECT *, b - row_number() OVER (PARTITION BY recording_id ORDER BY b) AS run FROM dead) GROUP BY recording_id, run),
best AS (SELECT recording_id, sum(n)::BIGINT AS dead, arg_max(n, n * 1000000 - f) AS longest, arg_max(f, n * 1000000 - f) AS f FROM r GROUP BY 1)
SELECT recording_id, coalesce(dead, 0) AS dead, (floor(duration_s / 21600) + 1)::INT AS total, coalesce(longest, 0) AS longest, coalesce(f, 0) * 21600.0::DOUBLE AS longest_start FROM durations LEFT JOIN best USING (recording_id)""", "anchor_evt", "durations"))
def dead_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour slots without an anchor."""
    spans = views.durations(spark, sf_dir).select("recording_id", F.lit(0.0).alias("lo_s"), F.col("duration_s").alias("hi_s"))
    return sequence.dead_runs(views.anchor_evt(spark, sf_dir), spans, 21_600.0)


@query(with_views("""
WITH f AS (SELECT DISTINCT recording_id, floor(frame_s / 600) AS slot, true AS on_frame FROM frame_evt), hf AS (SELECT DISTINCT recording_id, true AS has_frames FROM frame_evt), hc AS (SELECT DISTINCT recording_id, true AS has_cues FROM cue_evt),
a AS (SELECT *, floor(at_s / 600) AS slot FROM anchor_evt), l AS (SELECT recording_id, slot, count(DISTINCT class) AS classes FROM a WHERE class <> 'NONE' GROUP BY 1, 2),
i AS (SELECT DISTINCT anchor_id, true AS in_cue FROM a JOIN cue_evt c ON a.recording_id = c.recording_id AND at_s BETWEEN c.start_s AND c.end_s),
d AS (SELECT a.recording_id, CASE WHEN class = 'NONE' THEN CASE WHEN classes = 1 THEN 'cross-referenced' ELSE 'unattributable' END WHEN class = 'ON-SCREEN' THEN CASE WHEN has_frames IS NULL THEN 'unchecked' WHEN on_frame THEN 'resolved' ELSE 'unresolved' END WHEN has_cues IS NULL THEN CASE class WHEN 'SPOKEN' THEN 'unchecked-spoken' ELSE 'unbound-inferred' END WHEN in_cue THEN 'resolved' ELSE 'unresolved' END AS disposition
FROM a LEFT JOIN f USING (recording_id, slot) LEFT JOIN hf USING (recording_id) LEFT JOIN hc USING (recording_id) LEFT JOIN l USING (recording_id, slot) LEFT JOIN i USING (anchor_id))
SELECT recording_id, disposition, count(*) AS anchors, (sum(count(*)) OVER (PARTITION BY recording_id))::BIGINT AS of_all FROM d GROUP BY 1, 2""", "anchor_evt", "frame_evt", "cue_evt"))
def disposition_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors by disposition, with ten-minute slots for seconds."""
    slots = lambda df, c: df.withColumn(c, F.col(c) / 600)
    cues = views.cue_evt(spark, sf_dir).select("recording_id", (F.col("start_s") / 600).alias("start_s"), (F.col("end_s") / 600).alias("end_s"))
    found = witness.dispositions(slots(views.anchor_evt(spark, sf_dir), "at_s"), slots(views.frame_evt(spark, sf_dir), "frame_s"), cues, 6.0)
    return witness.partition_census(found)
