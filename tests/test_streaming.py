"""The streaming faces give what the batch operators give."""

from tidemark.operators import sequence
from tidemark.streaming import live


def test_spaced(spark, tmp_path):
    rows = [(1, float(t)) for t in (0, 5, 25, 30, 50)] + [(2, 3.0), (2, 30.0)]
    df = spark.createDataFrame(rows, "recording_id long, at_s double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.spaced(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("spaced").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    found = {(r.recording_id, r.at_s) for r in spark.table("spaced").collect()}
    assert found == {(r.recording_id, r.at_s) for r in sequence.spaced_picks(df, 20.0, 99).collect()}


def test_spaced_forgets_by_event_time(spark, tmp_path):
    rows = [(1, float(t), f"2024-01-01 00:00:{t:02d}") for t in (0, 5, 25, 30, 50)]
    df = spark.createDataFrame(rows, "recording_id long, at_s double, t string").selectExpr("recording_id", "at_s", "cast(t as timestamp) ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.spaced(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(120)
    assert sorted(r.at_s for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0.0, 25.0, 50.0]


def test_activity_by_event_time(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [(1, "2024-01-01 00:01:00", "two words"), (1, "2024-01-01 00:06:00", "one"), (2, "2024-01-01 00:01:00", "x")]
    frame = spark.createDataFrame(rows, "recording_id long, at string, text string").selectExpr("recording_id", "cast(at as timestamp) ts", "text")
    frame.write.parquet(str(source / "a"))
    # A moment far ahead moves the watermark past all windows before it.
    frame.limit(1).selectExpr("9L as recording_id", "timestamp'2024-01-02 00:00:00' as ts", "'late' as text").write.parquet(str(source / "b"))
    frame.limit(1).selectExpr("9L as recording_id", "timestamp'2024-01-02 00:00:01' as ts", "'late' as text").write.parquet(str(source / "c"))
    stream = spark.readStream.schema("recording_id long, ts timestamp, text string").option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    found = live.activity(stream).selectExpr("recording_id", "window.start", "segments", "words")
    query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(out))
    assert query.awaitTermination(120)
    closed = {(r.recording_id, str(r.start)[11:16]): (r.segments, r.words) for r in spark.read.parquet(str(out)).collect() if r.recording_id != 9}
    assert closed == {(1, "23:55"): (1, 2), (1, "00:00"): (2, 3), (1, "00:05"): (1, 1), (2, "23:55"): (1, 1), (2, "00:00"): (1, 1)}
