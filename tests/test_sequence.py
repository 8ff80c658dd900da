"""Known answers of the ordered scans."""

import pytest

from tidemark.operators import alignment, coverage, interval, planning, rules, sequence

SEG = "recording_id long, ord long, start_s double, end_s double, text string"


def segs(spark, rows):
    return spark.createDataFrame([(r[0] if len(r) == 4 else 1, k, float(r[-3]), float(r[-2]), r[-1]) for k, r in enumerate(rows)], SEG)


def test_gap_and_late_start(spark):
    found = sequence.gaps(segs(spark, [(0, 2, "a"), (90, 92, "b")]), 20).collect()
    assert [(r.gap_start, r.gap_end) for r in found] == [(2, 90)]
    late = sequence.gaps(segs(spark, [(60, 61, "a")]), 20).collect()
    assert [(r.gap_start, r.gap_end) for r in late] == [(0, 60)]


def test_absurd_segment_does_not_hide_gaps(spark):
    found = sequence.gaps(segs(spark, [(0, 7200, "a"), (400, 401, "b")]), 20).collect()
    assert [(r.gap_start, r.gap_end) for r in found] == [(120, 400)]


def test_loop_is_anchored_at_its_start(spark):
    rows = [(0, 1, "first")] + [(3 * k, 3 * k + 1, "Again!") for k in range(1, 10)]
    found = sequence.longest_identical_run(segs(spark, rows)).first()
    assert (found.run_len, found.run_start, found.run_text) == (9, 3.0, "Again!")


def test_empty_texts_never_continue_a_run(spark):
    assert sequence.longest_identical_run(segs(spark, [(k, k + 1, "...") for k in range(5)])).first().run_len == 1


def test_counted_loop_is_a_near_run(spark):
    rows = [(k, k + 1, f"the same words again and again {k}") for k in range(60)]
    s = segs(spark, rows)
    assert sequence.longest_near_run(s).first().near_len == 60
    assert sequence.longest_identical_run(s).first().run_len == 1


def frames(spark, thumbs):
    return spark.createDataFrame([(1, k, float(k), [float(x) for x in t]) for k, t in enumerate(thumbs)], "recording_id long, idx long, ts double, thumb array<double>")


def test_last_kept_dedup(spark):
    a, b = [0, 0, 0, 0], [255, 255, 255, 255]
    assert [r.idx for r in sequence.last_kept(frames(spark, [a, a, b, b, a])).orderBy("idx").collect()] == [0, 2, 4]
    assert [r.idx for r in sequence.last_kept(frames(spark, [a] * 5)).collect()] == [0]


def test_dedup_threshold_is_inclusive(spark):
    assert sequence.last_kept(frames(spark, [[0, 0, 0, 0], [8, 0, 0, 0]]), 2.0).count() == 1
    assert sequence.last_kept(frames(spark, [[0, 0, 0, 0], [8.1, 0, 0, 0]]), 2.0).count() == 2


def test_spaced_picks(spark):
    times = spark.createDataFrame([(1, 30.0), (1, 33.0), (1, 95.0)], "recording_id long, at_s double")
    assert [r.at_s for r in sequence.spaced_picks(times).orderBy("pick_no").collect()] == [30.0, 95.0]
    many = spark.createDataFrame([(1, 60.0 * k) for k in range(40)], "recording_id long, at_s double")
    assert sequence.spaced_picks(many, 20.0, 8).count() == 8


def test_collapse_growing(spark):
    rows = [(0, 1, "we"), (1, 2, "we go"), (2, 3, "we go"), (3, 4, "stop")]
    found = sequence.collapse_growing(segs(spark, rows)).orderBy("ord").collect()
    assert [(r.start_s, r.end_s, r.text) for r in found] == [(0, 3, "we go"), (3, 4, "stop")]


def test_rollover_strip(spark):
    cues = spark.createDataFrame([(1, 0, 0.0, 1.0, ["a"]), (1, 1, 1.0, 2.0, ["a", "b"]), (1, 2, 2.0, 3.0, ["b"]), (1, 3, 3.0, 4.0, ["b", "c"])], "recording_id long, cue_no long, start_s double, end_s double, lines array<string>")
    found = sequence.strip_rollover(cues).orderBy("cue_no").collect()
    assert [(r.cue_no, r.end_s, r.text) for r in found] == [(0, 1.0, "a"), (1, 3.0, "b"), (3, 4.0, "c")]


def test_regroup_words(spark):
    words = [(0.0, 0.4, "One"), (0.5, 0.9, "two"), (1.0, 1.4, "three."), (1.5, 1.9, "Four"), (3.0, 3.2, "five")]
    found = sequence.regroup_words(segs(spark, words)).orderBy("ord").collect()
    assert [r.text for r in found] == ["One two three.", "Four", "five"]


def test_dead_buckets(spark):
    anchors = spark.createDataFrame([(1, 0.0), (1, 300.0)], "recording_id long, at_s double")
    spans = spark.createDataFrame([(1, 0.0, 300.0)], "recording_id long, lo_s double, hi_s double")
    found = sequence.dead_runs(anchors, spans).first()
    assert (found.dead, found.total, found.longest, found.longest_start) == (4, 6, 4, 60.0)


@pytest.mark.parametrize(("total", "windows"), [(1040, 2), (1110, 2), (1290, 3), (3600, 7)])
def test_window_plan(spark, total, windows):
    totals = spark.createDataFrame([(1, float(total))], "recording_id long, total_s double")
    found = planning.window_starts(totals).orderBy("window_no").collect()
    assert len(found) == windows and found[0].lo_s == 0 and found[-1].hi_s == total


def test_reversed_segment_is_placed(spark):
    s = segs(spark, [(0, 10, "a"), (500, 400, "b"), (900, 1000, "c")])
    found = planning.members(s, planning.window_starts(planning.totals(s)))
    assert planning.orphans(s, found).count() == 0


def test_windows_that_do_not_advance_are_refused(spark):
    totals = spark.createDataFrame([(1, 10.0)], "recording_id long, total_s double")
    for window, overlap in ((90.0, 90.0), (0.0, 0.0), (float("nan"), 1.0)):
        with pytest.raises(ValueError):
            planning.window_starts(totals, window, overlap)


def test_timeless_segments_overfill_windows(spark):
    s = segs(spark, [(0, 3600, f"word{k}") for k in range(50)])
    found = planning.members(s, planning.window_starts(planning.totals(s)))
    assert planning.overfull(s, found, 600.0).first().is_overfull


def test_coverage_of_a_sawtooth(spark):
    s = segs(spark, [(20 * k, 20 * k + 1, f"w{k}") for k in range(60)])
    spans = spark.createDataFrame([(1, 1200.0)], "recording_id long, span_s double")
    assert interval.coverage(s, spans).first().covered == pytest.approx(0.05)


def test_difference_and_nearest(spark):
    spans = "recording_id long, ord long, start_s double, end_s double"
    claims, covers = spark.createDataFrame([(1, 0, 0.0, 10.0)], spans), spark.createDataFrame([(1, 0, 3.0, 4.0)], spans)
    found = interval.difference(claims, covers, 0.5).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s) for r in found] == [(0.0, 2.5), (4.5, 10.0)]
    points = spark.createDataFrame([(1, 7, 5.0), (1, 8, 100.0)], "recording_id long, point_id long, at_s double")
    frames_ = spark.createDataFrame([(1, 4.0), (1, 6.0)], "recording_id long, frame_s double")
    assert [(r.point_id, r.frame_s) for r in interval.nearest(points, frames_).orderBy("point_id").collect()] == [(7, 4.0), (8, 6.0)]


def test_health_of_a_healthy_and_a_looping_recording(spark):
    healthy = [(1, 3 * k, 3 * k + 2.5, " ".join(f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}" for a in ("alpha", "beta", "gamma"))) for k in range(400)]
    looping = [(2, 3 * k, 3 * k + 2.5, "over and over") for k in range(400)]
    defects = {(r.recording_id, r.code) for r in rules.health_defects(rules.health(segs(spark, healthy + looping))).collect()}
    assert not [d for d in defects if d[0] == 1]
    assert {code for _, code in defects} >= {"E-TS-LOOP", "E-TS-REPEAT", "E-TS-DOMINANT", "E-TS-VOCABULARY"}


def test_health_across_stretches_cuts_texts_into_words_few_times(spark):
    texts = ["same words here"] * 5 + ["one 2 three"] * 3 + ["", "one three four 2"] + ["same words here"] * 2
    rows = [(1, 900.0 * k, 900.0 * k + 4, t) for k, t in enumerate(texts)] + [(2, 0, 4, "12 34")]
    found = rules.health(segs(spark, rows))
    # Each count of words in the plan is a pass of patterns over all texts.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 4
    one, other = found.orderBy("recording_id").collect()
    assert (one.segments, one.distinct, one.words, one.run, one.near) == (12, 4, 34, 5, 5)
    assert one.per_minute == pytest.approx(6 / (one.span / 60)) and one.top_share == pytest.approx(7 / 12)
    assert (other.distinct, other.words, other.per_minute) == (1, 2, 0.0)
    assert {r.recording_id: r.vocabulary for r in rules.vocabulary(segs(spark, rows)).collect()} == {1: 6}


def test_near_rows_and_alignment(spark):
    rows = spark.createDataFrame([(1, 0, "the quick brown fox jumps"), (1, 1, "something else"), (1, 2, "the quick brown fox jumped")], "recording_id long, ord long, text string")
    assert [(r.ord, r.like_ord) for r in coverage.near_rows(rows).collect()] == [(2, 0)]
    a = segs(spark, [(0, 1, "one two three fourth five")])
    b = segs(spark, [(0, 1, "one two three"), (1, 2, "fourth five")])
    same = alignment.align(a, b).first()
    assert (same.ratio, same.regions) == (1.0, 0)
    changed = alignment.align(a, segs(spark, [(0, 1, "one two three fifth five")])).first()
    assert changed.regions == 1 and changed.salient == 0
