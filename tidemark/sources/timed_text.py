"""Readers. Each takes a session and a path (file, folder or pattern) and returns rows that name their file.

Files are read by Spark's own readers, so any store that Spark reaches will do, and parsing is by expressions. A caption
or JSON file is one value, as recordings are; tables are read line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import sequence

# Times of a cue as the two readers know them: with hours at the line's start, or without them anywhere on it.
_TIMING = {
    "capture": r"^(\d{2}:\d{2}:\d{2}[.,]\d{3})\s+-->\s+(\d{2}:\d{2}:\d{2}[.,]\d{3})",
    "grading": r"((?:\d+:)?\d{1,2}:\d{2}\.\d{3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}\.\d{3})",
}


def _seconds(clock):
    parts = F.transform(F.split(F.translate(clock, ",", "."), ":"), lambda p: p.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, line_no, line) of whole files."""
    files = spark.read.text(path, wholetext=True).withColumn("recording_id", F.input_file_name())
    whole = F.regexp_replace("value", "\r\n?", "\n")
    return files.select("recording_id", F.posexplode(F.split(whole, "\n")).alias("line_no", "line"))


def vtt_cues(spark: SparkSession, path: str, form: str = "capture") -> DataFrame:
    """(recording_id, cue_no, start_s, end_s, lines) of caption files.

    In the form "grading" a cue's lines end at a blank line or the next times; in "capture" at a blank line only, and times
    among them are text. datasources reads the same from files too large for one value.
    """
    times = _TIMING[form]
    order = Window.partitionBy("recording_id").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    blank = F.trim(F.regexp_replace("line", r"\s", "")) == ""
    marked = _lines(spark, path).withColumn("timing", F.col("line").rlike(times)).withColumn("blank", blank)
    marked = marked.withColumn("block", F.sum(F.col("blank").cast("long")).over(so_far)).where("not blank")
    if form == "capture":
        first = F.min(F.when(F.col("timing"), F.col("line_no"))).over(Window.partitionBy("recording_id", "block"))
        marked = marked.withColumn("timing", F.col("timing") & (F.col("line_no") == first))
    marked = marked.withColumn("cue_no", F.sum(F.col("timing").cast("long")).over(so_far) - 1)
    # Lines before a block's first times belong to no cue.
    headed = F.max(F.col("timing").cast("int")).over(Window.partitionBy("recording_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("headed", headed).where("headed = 1")
    held = marked.groupBy("recording_id", "cue_no").agg(F.first(F.when(F.col("timing"), F.col("line")), True).alias("head"), F.array_sort(F.collect_list(F.when(~F.col("timing"), F.struct("line_no", "line")))).alias("body"))
    return held.select("recording_id", "cue_no", _seconds(F.regexp_extract("head", times, 1)).alias("start_s"), _seconds(F.regexp_extract("head", times, 2)).alias("end_s"), F.col("body.line").alias("lines"))


def vtt_segments(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, ord, start_s, end_s, text): cues cleaned, without rollover, neighbours of growing text merged."""
    lines = vtt_cues(spark, path).select("recording_id", "cue_no", "start_s", "end_s", F.posexplode_outer("lines").alias("k", "line"))
    clean = lines.withColumn("line", tx.cue_text("line"))
    held = clean.groupBy("recording_id", "cue_no", "start_s", "end_s").agg(F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("k", "line")))).alias("l"))
    cues = held.select("recording_id", "cue_no", "start_s", "end_s", F.col("l.line").alias("lines")).where(F.size("lines") > 0)
    stripped = sequence.strip_rollover(cues).withColumnRenamed("cue_no", "ord")
    return sequence.collapse_growing(stripped)


def _timed(rows: DataFrame) -> DataFrame:
    """Segments in order; a recording with a start or end that isn't finite fails."""
    bad = F.isnan("start_s") | F.isnan("end_s") | (F.abs("start_s") == float("inf")) | (F.abs("end_s") == float("inf"))
    checked = rows.withColumn("start_s", F.when(bad, F.raise_error(F.concat(F.lit("a time that isn't finite in "), "recording_id"))).otherwise(F.col("start_s")))
    kept = checked.where(F.trim("text") != "")
    return kept.select("recording_id", (F.row_number().over(Window.partitionBy("recording_id").orderBy("start_s", "ord")) - 1).cast("long").alias("ord"), "start_s", "end_s", "text")


def tsv_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of start, end and text columns; comments, headers and rows without times are passed over."""
    parts = F.split("line", "\t", 3)
    rows = _lines(spark, path).where(~F.col("line").startswith("#")).select("recording_id", F.col("line_no").alias("ord"), F.get(parts, F.lit(0)).try_cast("double").alias("start_s"), F.get(parts, F.lit(1)).try_cast("double").alias("end_s"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("text"))
    return _timed(rows.where("start_s is not null and end_s is not null"))


def json_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a JSON transcript: a list, an object with `segments`, or one with `transcription` in milliseconds."""
    item = "struct<start:double,end:double,text:string>"
    offsets = "struct<text:string,offsets:struct<from:double,to:double>>"
    files = spark.read.text(path, wholetext=True).withColumn("recording_id", F.input_file_name())
    bare = F.from_json("value", f"array<{item}>")
    whole = F.from_json("value", f"struct<segments:array<{item}>,transcription:array<{offsets}>>")
    is_list = F.ltrim("value").startswith("[")
    shifted = F.transform(whole["transcription"], lambda t: F.struct((t["offsets"]["from"] / 1000).alias("start"), (t["offsets"]["to"] / 1000).alias("end"), t["text"].alias("text")))
    found = F.when(is_list, bare).otherwise(F.coalesce(whole["segments"], shifted))
    checked = F.when(found.isNull(), F.raise_error(F.concat(F.lit("not a transcript: "), "recording_id"))).otherwise(found)
    rows = files.select("recording_id", F.posexplode(checked).alias("ord", "s"))
    return _timed(rows.select("recording_id", "ord", F.coalesce("s.start", F.lit(0.0)).alias("start_s"), F.coalesce("s.end", F.lit(0.0)).alias("end_s"), F.coalesce("s.text", F.lit("")).alias("text")))


def table_headers(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, key, value) of the `# key<TAB>value` lines before the first other line."""
    order = Window.partitionBy("recording_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = _lines(spark, path).withColumn("past", F.max((~F.col("line").startswith("#")).cast("int")).over(order)).where("past = 0")
    parts = F.split(F.regexp_replace("line", r"^#\s*", ""), "\t", 2)
    return lines.select("recording_id", F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("value"))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows (recording_id, kind, start_s, end_s, id, sha256) and defects (recording_id, line_no, code) of manifests.

    Of several frames in one second the first counts, and the others are defects, as are rows of another shape.
    """
    parts = F.split("line", "\t")
    lines = _lines(spark, path).where(~F.col("line").startswith("#") & (F.trim("line") != "") & ~F.col("line").startswith("kind\t"))
    rows = lines.select("recording_id", "line_no", F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).try_cast("double").alias("start_s"), F.get(parts, F.lit(2)).try_cast("double").alias("end_s"), F.get(parts, F.lit(3)).alias("id"), F.get(parts, F.lit(4)).alias("sha256"), F.size(parts).alias("columns"))
    code = F.when((F.col("columns") != 5) | ~F.col("kind").isin("frame", "cue"), "E-MANIFEST-ROW").when(F.col("start_s").isNull() | F.col("end_s").isNull(), "E-MANIFEST-SPAN")
    rows = rows.withColumn("code", code)
    nth = F.row_number().over(Window.partitionBy("recording_id", "kind", F.floor("start_s")).orderBy("line_no"))
    good = rows.where("code is null").withColumn("again", (F.col("kind") == "frame") & (nth > 1))
    defects = rows.where("code is not null").select("recording_id", "line_no", "code").union(good.where("again").select("recording_id", "line_no", F.lit("E-MANIFEST-DUPLICATE")))
    return good.where("not again").select("recording_id", "kind", "start_s", "end_s", "id", "sha256"), defects


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(note, frontmatter, body): the frontmatter stands between a first line of three dashes and the next such line."""
    files = spark.read.text(path, wholetext=True).withColumn("note", F.input_file_name())
    pattern = r"(?s)\A---[ \t]*\n(.*?\n)?---[ \t]*(?:\n(.*))?\z"
    has = F.col("value").rlike(pattern)
    return files.select("note", F.when(has, F.regexp_extract("value", pattern, 1)).alias("frontmatter"), F.when(has, F.regexp_extract("value", pattern, 2)).otherwise(F.col("value")).alias("body"))


def write_index(segments: DataFrame, path: str) -> None:
    """Write start, end (three places) and text, tab-separated, one folder per recording."""
    line = F.concat_ws("\t", F.format_string("%.3f", "start_s"), F.format_string("%.3f", "end_s"), F.translate("text", "\t\n", "  "))
    ordered = segments.select("recording_id", "start_s", "ord", line.alias("value")).repartition("recording_id").sortWithinPartitions("recording_id", "start_s", "ord")
    ordered.select("recording_id", "value").write.mode("overwrite").partitionBy("recording_id").text(path)


def run_record(recordings: DataFrame) -> DataFrame:
    """(recording_id, record): each row's columns as one JSON document."""
    return recordings.select("recording_id", F.to_json(F.struct(*recordings.columns)).alias("record"))
