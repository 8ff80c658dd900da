"""Readers of runs, notes and published trees, and writers of manifests and reports.

Files are read by Spark's readers, but for trees, whose folders are walked by tasks.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import clock
from tidemark.operators import interval
from tidemark.operators.scan import suffix
from tidemark.operators.sequence import KEY
from tidemark.operators.stages import stored
from tidemark.sources import timed_text

# Folders that hold no publishable text, suffixes that do, frame names, and the manifest's columns.
SKIPPED = ["__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".venv", "venv", "node_modules", "build", "dist", ".git", ".hg", ".svn"]
PUBLISHABLE = [".py", ".md", ".toml", ".txt", ".tsv", ".csv", ".json", ".cfg", ".ini", ".yaml", ".yml", ".sh", ".vtt", ".srt"]
FRAME = r"(?i)_t?(?:(\d+)h)?(\d{1,2})m(\d{1,2})s\.(?:jpg|jpeg|png)$"
MANIFEST = ["kind", "start", "end", "id", "sha256"]
FRONTMATTER_LINES = 80
_DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def decode(raw: bytes | None) -> tuple[str | None, str | None]:
    """(text, error) of bytes in whatever encoding they are.

    A byte order mark decides (32 bits before 16); else UTF-8, else UTF-16 or 32 without a mark where every other byte or
    more is zero; bytes that still hold zeros aren't text; the rest is Latin-1.
    """
    marks = [(b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")]
    if raw is None:
        return None, "unreadable"
    for mark, name in marks:
        if raw.startswith(mark):
            try:
                return raw[len(mark) :].decode(name), None
            except UnicodeDecodeError:
                return None, f"not {name}"
    for name in ("utf-8", "utf-32-le", "utf-32-be", "utf-16-le", "utf-16-be"):
        if name != "utf-8" and b"\0" not in raw:
            continue
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        if "\0" not in text:
            return text, None
    return (None, "binary") if b"\0" in raw else (raw.decode("latin-1"), None)


@F.pandas_udf(_DECODED)
def decoded(content: pd.Series) -> pd.DataFrame:
    """Text of bytes in whatever encoding they are, or why there is none."""
    return pd.DataFrame([decode(r) for r in content], columns=["text", "error"])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, resolved, kind, size, error) of what folders (path) hold, read as names and sizes only."""
    columns = ["path", "resolved", "kind", "size", "error"]
    for batch in batches:
        for folder in batch["path"]:
            made: list[tuple] = []
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        try:
                            kind = "folder" if e.is_dir() else "file"
                            made.append((e.path, os.path.realpath(e.path), kind, e.stat().st_size if kind == "file" else None, None))
                        except OSError as error:
                            made.append((e.path, None, "file", None, f"unreadable: {error.strerror}"))
                        if len(made) >= 10_000:
                            yield pd.DataFrame(made, columns=columns).astype({"size": "Int64"})
                            made = []
            except OSError as error:
                made.append((folder, None, "folder", None, f"unlistable: {error.strerror}"))
            yield pd.DataFrame(made, columns=columns).astype({"size": "Int64"})


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, resolved, size, error) of all files below a folder that driver and executors share, names and sizes only.

    Folders are listed level by level, each once, whatever links lead to it, and under the first of its names; a link to the
    folder itself or above it isn't followed. SKIPPED folders, by the name they really have, are left out. A folder that
    can't be listed and a file that can't be opened (as a link to nothing) are rows with an error.
    """
    root = os.path.normpath(root.removeprefix("file://"))
    top = os.path.realpath(root)
    frontier, found = spark.createDataFrame([(root, top)], "path string, resolved string"), None
    seen = frontier.select("resolved")
    above = [top[: k + 1].rstrip("/") or "/" for k, c in enumerate(top + "/") if c == "/"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        rows = stored(frontier.select("path").repartition(n, "path").mapInPandas(_entries, "path string, resolved string, kind string, size long, error string"))
        own = rows.where("kind = 'file' or error is not null").select("path", "resolved", "size", "error")
        found = own if found is None else found.unionByName(own)
        real = F.when(F.startswith("resolved", F.lit(top + "/")), F.substr("resolved", F.lit(len(top) + 2))).otherwise(F.col("path"))
        inside = ~F.arrays_overlap(F.split(real, "/"), F.array(*map(F.lit, SKIPPED)))
        folders = rows.where("kind = 'folder' and error is null").where(inside & ~F.col("resolved").isin(above))
        frontier = stored(folders.groupBy("resolved").agg(F.min("path").alias("path")).join(seen, "resolved", "left_anti").select("path", "resolved"))
        if not frontier.limit(1).count():
            return found
        seen = seen.unionByName(frontier.select("resolved"))


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, text, error, sha256) of files (path), one at a time."""
    for batch in batches:
        for path in batch["path"]:
            try:
                with open(path, "rb") as f:
                    raw = f.read()
                text, error = decode(raw)
                row = (path, text, error, hashlib.sha256(raw).hexdigest())
            except OSError as e:
                row = (path, None, f"unreadable: {e.strerror}", None)
            yield pd.DataFrame([row], columns=["path", "text", "error", "sha256"])


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, suffix, read, text, error, sha256) of all files below a folder, those of generated folders left out.

    Only files of publishable suffixes, and of none, are opened; the others, however large, are listed with read = false, no
    text and the error "suffix".
    """
    listed = walk(spark, root).withColumn("suffix", suffix(F.col("path")))
    wanted = F.col("suffix").isin("", *PUBLISHABLE) & F.col("error").isNull()
    none = [F.lit(None).cast("string").alias(c) for c in ("text", "sha256")]
    closed = listed.where(~wanted).select("path", "suffix", F.lit(False).alias("read"), none[0], F.coalesce("error", F.lit("suffix")).alias("error"), none[1])
    read = listed.where(wanted).select("path").mapInPandas(_contents, "path string, text string, error string, sha256 string")
    return closed.unionByName(read.select("path", suffix(F.col("path")).alias("suffix"), F.col("error").isNull().alias("read"), "text", "error", "sha256"))


def is_note(path: Column) -> Column:
    """Whether a path is a dated note outside the review folder and not the template."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.rlike(r"^\d{4}-\d{2}-\d{2}--.*\.md$") & ~F.array_contains(F.split(path, "/"), "reviews") & ~name.contains("TEMPLATE")


def note_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, skipped): dated notes of (path, ...) with note_date, and the other markdown files by name."""
    name = F.element_at(F.split("path", "/"), -1)
    marked = files.where(F.col("path").endswith(".md")).withColumn("is_note", is_note(F.col("path")))
    return marked.where("is_note").drop("is_note").withColumn("note_date", F.try_to_date(F.substring(name, 1, 10))), marked.where("not is_note").select("path")


def refuse_empty(notes: DataFrame) -> DataFrame:
    """The notes; reading them fails if there is none, as a corpus without notes wasn't graded."""
    n = notes.agg(F.count("*")).scalar()
    return notes.where(F.when(n == 0, F.raise_error(F.lit("no notes to grade"))).otherwise(F.lit(True)))


def without_frontmatter(lines: DataFrame) -> DataFrame:
    """Lines (recording_id, line_no, text) behind a header that really is one.

    It opens on the first line, closes within FRONTMATTER_LINES, and half of its lines with content are keys or comments;
    else the first line is a rule and nothing is cut.
    """
    rule = F.trim("text") == "---"
    opens = lines.where(rule & (F.col("line_no") == 0)).select(KEY)
    close = lines.where(rule & (F.col("line_no") > 0) & (F.col("line_no") < FRONTMATTER_LINES)).join(opens, KEY, "left_semi").groupBy(KEY).agg(F.min("line_no").alias("close_at"))
    block = lines.join(close, KEY).where("line_no > 0 and line_no < close_at").where(F.trim("text") != "")
    keyed = F.col("text").rlike(r"^[A-Za-z_][\w-]*\s*:") | F.ltrim("text").startswith("#")
    real = block.groupBy(KEY, "close_at").agg(F.count("*").alias("n"), F.count_if(keyed).alias("k")).where("k * 2 >= n").select(KEY, "close_at")
    return lines.join(real, KEY, "left").where("close_at is null or line_no > close_at").drop("close_at")


def raw_cues(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, ord, start_s, end_s, text) of caption files as they are: tags removed, empty ones dropped, repeats kept."""
    cues = timed_text.vtt_cues(spark, path, "grading")
    text = F.trim(F.regexp_replace(F.regexp_replace(F.array_join("lines", " "), "<[^>]*>", ""), r"\s+", " "))
    return cues.select(KEY, F.col("cue_no").alias("ord"), "start_s", "end_s", text.alias("text")).where("text <> ''")


def cue_spans(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, ord, start_s, end_s) of caption files, those that end before they start left out."""
    return timed_text.vtt_cues(spark, path, "grading").where("end_s >= start_s").select(KEY, F.col("cue_no").alias("ord"), "start_s", "end_s")


def merged_cue_spans(spans: DataFrame, gap: float = 1.0) -> DataFrame:
    """Spans of all tracks of a recording (recording_id, track, ord, start_s, end_s) as one set, coalesced."""
    order = F.row_number().over(Window.partitionBy(KEY).orderBy("start_s", "end_s")).cast("long")
    return interval.coalesce_spans(spans.withColumn("ord", order), gap)


def transcripts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Segments of transcripts of any shape, by suffix; an unknown suffix is refused."""
    readers = {".vtt": raw_cues, ".tsv": timed_text.tsv_segments, ".json": timed_text.json_segments}
    out = None
    for path in paths:
        read = readers.get(os.path.splitext(path)[1].lower())
        if read is None:
            raise ValueError(f"not a transcript: {path}")
        rows = read(spark, path)
        out = rows if out is None else out.unionByName(rows)
    return out


def caption_index(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, ord, start_s, end_s, text, declared) of caption indexes; declared is the id in the leading comments."""
    heads = timed_text.table_headers(spark, path).where(F.trim("key") == "video_id").groupBy(KEY).agg(F.first("value").alias("declared"))
    return timed_text.tsv_segments(spark, path).join(heads, KEY, "left")


def ocr_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, defects) of OCR indexes: frame, second, sha256, width, height, words and text, with the text's tokens."""
    lines = timed_text._lines(spark, path).where(~F.col("line").startswith("#") & ~F.col("line").startswith("frame\t") & (F.trim("line") != ""))
    part = lambda k: F.get(F.split("line", "\t", 7), F.lit(k))
    rows = lines.select(KEY, "line_no", part(0).alias("frame"), part(1).try_cast("int").alias("second"), part(2).alias("sha256"), part(3).try_cast("int").alias("width"), part(4).try_cast("int").alias("height"), part(5).try_cast("int").alias("words"), F.coalesce(part(6), F.lit("")).alias("text"))
    bad = F.col("second").isNull() | F.col("words").isNull()
    tokens = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z-]{2,}"), F.lit(0))))
    return rows.where(~bad).withColumn("tokens", tokens).drop("line_no"), rows.where(bad).select(KEY, "line_no", F.lit("E-OCR-ROW").alias("code"))


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, chapter, start_s, end_s, title) of metadata files; entries that aren't objects are dropped."""
    files = spark.read.text(path, wholetext=True).withColumn(KEY, F.input_file_name())
    entries = F.from_json(F.get_json_object("value", "$.chapters"), "array<string>")
    rows = files.select(KEY, F.posexplode(entries).alias("chapter", "entry")).where(F.ltrim("entry").startswith("{"))
    return rows.select(KEY, F.col("chapter").cast("long").alias("chapter"), F.get_json_object("entry", "$.start_time").try_cast("double").alias("start_s"), F.get_json_object("entry", "$.end_time").try_cast("double").alias("end_s"), F.get_json_object("entry", "$.title").alias("title"))


def run_info(infos: DataFrame) -> DataFrame:
    """(recording_id, duration_s, id) by the first readable of each run's (recording_id, path, value) metadata files."""
    duration = F.get_json_object("value", "$.duration").try_cast("double")
    rows = infos.where(F.try_parse_json("value").isNotNull()).select(KEY, "path", F.when(duration > 0, duration).alias("duration_s"), F.get_json_object("value", "$.id").alias("id"))
    return rows.groupBy(KEY).agg(F.min_by(F.struct("duration_s", "id"), "path").alias("r")).select(KEY, "r.*")


def frame_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, unstamped, collisions) of (recording_id, path): the second in a frame's name; the first path of one counts."""
    hours = F.coalesce(F.regexp_extract("path", FRAME, 1).try_cast("long"), F.lit(0))
    second = hours * 3600 + F.regexp_extract("path", FRAME, 2).try_cast("long") * 60 + F.regexp_extract("path", FRAME, 3).try_cast("long")
    rows = files.withColumn("second", F.when(F.col("path").rlike(FRAME), second))
    nth = F.row_number().over(Window.partitionBy(KEY, "second").orderBy("path"))
    stamped = rows.where("second is not null").withColumn("nth", nth)
    return stamped.where("nth = 1").drop("nth"), rows.where("second is null").select(KEY, "path"), stamped.where("nth > 1").select(KEY, "second", "path")


def preferred_track(tracks: DataFrame) -> DataFrame:
    """(recording_id, path): the original English track if there is one, else the shortest name."""
    name = F.element_at(F.split("path", "/"), -1)
    best = F.struct((~name.contains(".en-orig.")).alias("other"), F.length(name).alias("n"), F.col("path").alias("path"))
    return tracks.groupBy(KEY).agg(F.min(best).alias("b")).select(KEY, "b.path")


def policy(start: str, today: datetime.date | None = None, name: str = "tidemark.toml", given: str = "TIDEMARK_POLICY") -> dict[str, dict[str, str]]:
    """Ledgers of the nearest file of that name from a folder upwards (or the file that the given variable names).

    Every entry must begin with a real date that isn't in the future. Without a file all ledgers are empty. This is a
    driver-side option file; ledger() makes a table of it.
    """
    path = os.environ.get(given, "")
    here = os.path.abspath(start)
    while not path and here:
        found = os.path.join(here, name)
        path = found if os.path.isfile(found) else ""
        here = os.path.dirname(here) if os.path.dirname(here) != here else ""
    if not path:
        return {}
    with open(path, "rb") as f:
        tables = {k: v for k, v in tomllib.load(f).items() if isinstance(v, dict)}
    for name, entries in tables.items():
        for key, reason in entries.items():
            try:
                dated = datetime.date.fromisoformat(str(reason)[:10])
            except ValueError:
                raise ValueError(f"{name}.{key} begins with no date") from None
            if dated > (today or datetime.date.today()):
                raise ValueError(f"{name}.{key} is dated in the future")
    return tables


def ledger(spark: SparkSession, tables: dict[str, dict[str, str]]) -> DataFrame:
    """(ledger, key, as_of, reason) of policy()."""
    rows = [(name, key, reason) for name, entries in tables.items() for key, reason in entries.items()]
    found = spark.createDataFrame(rows, "ledger string, key string, reason string")
    return found.select("ledger", "key", F.to_date(F.substring("reason", 1, 10)).alias("as_of"), "reason")


def manifest_rows(frames: DataFrame, cues: DataFrame, runs: DataFrame) -> DataFrame:
    """(recording_id, part, line): a manifest's headers, column names, frames and cues as lines, in the order of part.

    frames: recording_id, second, id, sha256; cues: recording_id, start_s, end_s; runs: recording_id, id, duration_s. A run
    whose id differs is refused; without a duration the last frame or cue stands for it, and without these it is undated.
    """
    ends = frames.select(KEY, F.col("second").cast("double").alias("t")).union(cues.select(KEY, "end_s")).groupBy(KEY).agg(F.max("t").alias("last"))
    heads = runs.join(ends, KEY, "left").withColumn("duration", F.coalesce("duration_s", "last"))
    checked = heads.withColumn("duration", F.when(F.col("id") != F.col(KEY), F.raise_error(F.concat(F.lit("another recording's run: "), F.col("id")))).when(F.col("duration").isNull(), F.raise_error(F.lit("a run without a duration"))).otherwise(F.col("duration")))
    heads = [F.concat(F.lit("# video_id\t"), KEY), F.concat(F.lit("# duration\t"), F.format_string("%.3f", "duration")), F.lit("\t".join(MANIFEST))]
    header = checked.select(KEY, F.posexplode(F.array(*heads)).alias("k", "line")).select(KEY, (F.col("k") / 10).alias("part"), "line")
    number = lambda c: F.format_string("%.3f", F.col(c).cast("double"))
    framed = frames.select(KEY, (1 + F.col("second") / 1e9).alias("part"), F.concat_ws("\t", F.lit("frame"), number("second"), number("second"), "id", "sha256").alias("line"))
    cued = cues.select(KEY, (2 + F.col("start_s") / 1e9).alias("part"), F.concat_ws("\t", F.lit("cue"), number("start_s"), number("end_s"), F.lit("-"), F.lit("-")).alias("line"))
    return header.unionByName(framed).unionByName(cued)


def rendering_json(segments: DataFrame) -> DataFrame:
    """(recording_id, rendering): the segments of each recording as one JSON document."""
    held = segments.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("start_s").alias("start"), F.col("ord"), F.col("end_s").alias("end"), "text"))).alias("s"))
    return held.select(KEY, F.to_json(F.struct(F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))).alias("segments"))).alias("rendering"))


def write_report(rows: DataFrame, path: str) -> None:
    """Write a result as tab-separated lines under its column names; nulls are empty."""
    cells = [F.coalesce(F.translate(F.col(c).cast("string"), "\t\n", "  "), F.lit("")).alias(c) for c in rows.columns]
    rows.select(*cells).write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", "").csv(path)


def safe_text(content: Column) -> tuple[Column, Column]:
    """(text, error) of bytes that should be UTF-8."""
    text = F.try_validate_utf8(content.cast("string"))
    return text, F.when(text.isNull(), F.lit("not UTF-8"))


def stamped_name(stem: Column, second: Column) -> Column:
    """A frame's file name with its second in it."""
    return F.concat(stem, F.lit("_t"), F.regexp_replace(F.regexp_replace(clock.stamp(second), r"^(\d+):(\d+):(\d+)$", "$1h$2m$3s"), r"^(\d+):(\d+)$", "$1m$2s"), F.lit(".jpg"))
