"""Running values and folds over stretches against the same over whole recordings."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import decoding, folds, interval, notes, running, sequence

SEG = "recording_id long, ord long, start_s double, end_s double, text string"


def segments(spark, seed, n=400):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for k in range(n):
        at = at if rng.random() < 0.1 else round(at + rng.choice([0.0, 0.3, 1.0, 7.0, 25.0]), 2)
        rows.append((k % 2 if k < n // 2 else 2, k, at if rng.random() > 0.02 else None, at + rng.choice([0.2, 1.0, 9.0, 200.0]), rng.choice(["we", "we go", "we go on", "stop.", "", None, "Again!"])))
    return spark.createDataFrame(rows, SEG).repartition(3)


@pytest.mark.parametrize("backwards", [False, True])
def test_running_values_by_windows(spark, backwards):
    rows = segments(spark, 1).withColumn("v", F.when(F.col("ord") % 3 > 0, F.col("ord") * 7 % 50))
    values = {"a": running.most(F.col("v")), "b": running.total(F.col("v")), "c": running.latest(F.col("v")), "d": running.previous(F.col("v")), "e": running.most(F.col("v"), True), "f": running.total(F.col("v"), False), "g": running.latest(F.col("v"), False)}
    found = running.running(rows, ["start_s", "ord"], values, stretch=11.0, backwards=backwards)
    way = (lambda c: F.col(c).desc()) if backwards else F.col
    w = Window.partitionBy("recording_id").orderBy(way("start_s"), way("ord"))
    now, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.select(*rows.columns, F.max("v").over(past).alias("a"), F.sum("v").over(now).alias("b"), F.last("v", True).over(now).alias("c"), F.lag("v").over(w).alias("d"), F.max("v").over(now).alias("e"), F.sum("v").over(past).alias("f"), F.last("v", True).over(past).alias("g"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_a_long_recording_is_scanned_by_several_tasks(spark):
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").alias("ord"), (F.col("id") * 3.0).alias("start_s"), (F.col("id") * 3.0 + 2).alias("end_s"))
    found = running.running(rows, ["start_s", "ord"], {"n": running.total(F.lit(1).cast("long"))})
    # Spark would put so little into one partition.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("rows"), F.max("n").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) >= 4 and max(r.rows for r in spread) < 100_000 and max(r.n for r in spread) == 200_000
    assert interval.coalesce_spans(rows, 0.5).count() == 200_000 and interval.coalesce_spans(rows, 1.0).count() == 1


def same(df, monkeypatch, widths):
    """What df() gives with each width of stretches."""
    found = []
    for width in widths:
        for module, name in ((folds, "STRETCH"), (running, "STRETCH"), (sequence, "CUES"), (notes, "LINES")):
            monkeypatch.setattr(module, name, width)
        found.append(sorted(map(repr, df().collect())))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_over_stretches(spark, monkeypatch, seed):
    timed = segments(spark, seed).where("start_s is not null and text is not null")
    thumbs = timed.select("recording_id", F.col("ord").alias("idx"), F.col("start_s").alias("ts"), F.array(F.pmod(F.col("ord") * 37, F.lit(5)).cast("double"), F.lit(1.0)).alias("thumb"))
    cues = timed.select("recording_id", F.col("ord").alias("cue_no"), "start_s", "end_s", F.split("text", " ").alias("lines"))
    marked = timed.select("recording_id", F.col("ord").alias("line_no"), F.element_at(F.array(*map(F.lit, ["```", "~~~", "````", "```py", "x", "```"])), (F.pmod(F.xxhash64("ord"), F.lit(6)) + 1).cast("int")).alias("text"))
    runs = {
        "last": lambda: sequence.last_kept(thumbs, 1.0), "picks": lambda: sequence.spaced_picks(timed.select("recording_id", F.col("start_s").alias("at_s")), 20.0, 9), "grow": lambda: sequence.collapse_growing(timed),
        "rollover": lambda: sequence.strip_rollover(cues), "words": lambda: sequence.regroup_words(timed), "fences": lambda: notes.fences(marked), "spans": lambda: interval.coalesce_spans(timed, 0.2),
        "difference": lambda: interval.difference(timed.where("ord % 3 = 0"), timed.where("ord % 3 = 1")), "near": lambda: sequence.near_runs(timed), "gaps": lambda: sequence.gaps(timed, 5.0),
    }
    for name, run in runs.items():
        many, one = same(run, monkeypatch, [9.0, 1e9])
        assert many == one and one, name


def test_a_fold_that_never_forgets_is_still_right(spark):
    rows = spark.range(60).select((F.col("id") % 2).alias("recording_id"), F.col("id").alias("ord"), (F.col("id") % 7).alias("v"))

    def advance(state, part):
        out, state = [], state or 0
        for _, v in part:
            state += v
            out.append((state,))
        return out, state

    found = folds.folded(rows, ["ord", "v"], ["ord"], "sum long", advance, lambda s: [(-s,)], stretch=5.0, number="k")
    by = {}
    for r in found.orderBy("recording_id", "k").collect():
        by.setdefault(r.recording_id, []).append((r.k, r["sum"]))
    for key, got in by.items():
        sums, total = [], 0
        for k in range(key, 60, 2):
            total += k % 7
            sums.append(total)
        assert got == list(enumerate([*sums, -total]))


def test_seams_over_chunks(spark):
    rng = random.Random(4)
    rows = [(1, c, k, 50.0 * c + 4.0 * k, 50.0 * c + 4.0 * k + 3.5, rng.choice("abcdef"), 50.0 * c + 5 if c else None) for c in range(8) for k in range(14)]
    trimmed = spark.createDataFrame(rows, "recording_id long, chunk long, ord long, start_s double, end_s double, text string, keep_from double")
    kept, edge, tail = [], None, []
    for c in range(8):
        part = [r for r in rows if r[1] == c]
        if edge is not None:
            known = {t for e, t in tail if e >= edge - 8.0}
            part = [r for r in part if not (r[3] <= edge + 2.0 and r[5] in known)]
        kept += [(r[1], r[2]) for r in part]
        if part:
            edge = max([r[4] for r in part] + ([edge] if edge is not None else []))
            tail = [(e, t) for e, t in tail + [(r[4], r[5]) for r in part] if e >= edge - 8.0]
    assert [(r.chunk, r.ord) for r in decoding.without_seam_repeats(trimmed).orderBy("chunk", "ord").collect()] == kept and len(kept) < len(rows)


def test_nothing_gives_nothing(spark):
    empty = segments(spark, 1).limit(0)
    assert sequence.collapse_growing(empty).count() == sequence.regroup_words(empty).count() == interval.coalesce_spans(empty).count() == sequence.gaps(empty).count() == 0


@pytest.mark.parametrize("rows", [7, 100_000])
def test_long_recordings_are_cut_by_rows(spark, monkeypatch, rows):
    """F7, F12-F14, F20: short recordings are folded in one go, long ones at several places, both with the same result."""
    monkeypatch.setattr(folds, "ROWS", rows)
    timed = segments(spark, 3).where("start_s is not null and text is not null")
    runs = [lambda: sequence.collapse_growing(timed), lambda: sequence.regroup_words(timed), lambda: sequence.spaced_picks(timed.select("recording_id", F.col("start_s").alias("at_s")), 20.0, 9)]
    for run in runs:
        many, one = same(run, monkeypatch, [9.0, 1e9])
        assert many == one and one


def test_a_short_recording_takes_one_turn(spark, monkeypatch):
    """a day's gap over hours' stretches took a turn of its own for each stretch."""
    turns = []
    monkeypatch.setattr(folds, "stored", lambda df, kept=folds.stored: turns.append(1) or kept(df))
    times = spark.createDataFrame([(u, 5000.0 * k) for u in range(3) for k in range(60)], "recording_id long, at_s double")
    assert sequence.spaced_picks(times, 86_400.0, 12).count() == 3 * 4
    assert len(turns) == 1


def test_lines_are_regrouped_as_their_words(spark):
    """lines dealt whole give what a row for each word gives."""
    texts = ["one two  three. four", "", " a\tb\u00a0c d", "x " * 40, "stop. go! on? yes", None]
    lines = spark.createDataFrame([(1 + k % 2, k, 4.0 * k, t) for k, t in enumerate(texts * 3)], "recording_id long, ord long, start_s double, text string")
    words = lines.select("recording_id", "start_s", F.col("ord").alias("line"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("k", "text"))
    start = F.col("start_s") + F.col("k") * F.lit(0.33)
    words = words.select("recording_id", start.alias("start_s"), (start + 0.3).alias("end_s"), (F.col("line") * 1000 + F.col("k")).alias("ord"), "text")
    found, expected = (sorted(map(tuple, df.collect())) for df in (sequence.regroup_lines(lines, 0.33, 0.3), sequence.regroup_words(words)))
    assert found == expected and len(found) > 10
