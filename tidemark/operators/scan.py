"""Corpus scans: whole files that may quote private notes, by refused words in any spelling or by the moments they name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import needles
from tidemark.functions import text as tx

def stamp_lines(lines: DataFrame, least: int = 2) -> DataFrame:
    """(source_id, line_no, seconds) of lines of (source_id, line_no, text) that name at least so many moments."""
    found = lines.select("source_id", "line_no", tx.moments(tx.plainly(F.col("text"))).alias("seconds"))
    return found.where(F.size("seconds") >= least)


def stamp_sets(lines: DataFrame) -> DataFrame:
    """(set_id, seconds): the different sets of two or more moments that stand on one line."""
    sets = stamp_lines(lines).select("seconds").distinct()
    return sets.select(F.xxhash64("seconds").alias("set_id"), "seconds")


def contained_lines(lines: DataFrame, sets: DataFrame) -> DataFrame:
    """(source_id, line_no) of lines all of whose moments stand together in one known set; two whole minutes are excused.

    A line meets sets by the one of its moments that the fewest sets have, so common moments never bring lines together.
    """
    asked = stamp_lines(lines).where(~tx.is_round_pair(F.col("seconds")))
    known = sets.select("set_id", F.col("seconds").alias("known"), F.explode("seconds").alias("at"))
    often = known.groupBy("at").agg(F.count("*").alias("sets"))
    asked = asked.withColumn("line_id", F.struct("source_id", "line_no"))
    spread = asked.select("line_id", "seconds", F.explode("seconds").alias("at")).join(often, "at")
    rarest = spread.groupBy("line_id").agg(F.min(F.struct("sets", "at")).alias("r"), F.first("seconds").alias("seconds"), F.count("*").alias("met")).where(F.col("met") == F.size("seconds"))
    met = rarest.select("line_id", "seconds", F.col("r.at").alias("at")).join(known, "at").where(F.size(F.array_except("seconds", "known")) == 0)
    return met.select("line_id.source_id", "line_id.line_no").distinct()


#: Bytes of names that one automaton holds; it takes some forty times that. More names are looked for in turns.
AUTOMATON_BYTES = 1 << 20


def _turns(names: list[str]) -> list[list[tuple[int, str]]]:
    """The names with their numbers, in groups that fit one automaton."""
    turns: list[list[tuple[int, str]]] = []
    room = 0
    for k, name in enumerate(names):
        size = 4 * len(name.encode())
        if not turns or size > room:
            turns.append([])
            room = AUTOMATON_BYTES
        turns[-1].append((k, name))
        room -= size
    return turns


#: Whole texts of one Arrow batch, which both sides of a Python worker hold.
BATCH_ROWS = 500


def _bounded_batches(files: DataFrame) -> None:
    """Keep Arrow batches small enough for whole texts, unless the session keeps them smaller still."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", files.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def literals(files: DataFrame, names: list[str], entities: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(source_id, line_no, column, name, way) of whole texts (source_id, text): one for each line and name.

    name is a number, from 1, as findings may not repeat names; way is how it is written (needles.WAYS); line_no and column
    count from 1. One automaton of all names is broadcast, within AUTOMATON_BYTES; names without letters and digits are never
    found; null texts have nothing. entities: those to decode (see needles.find), all without.
    """
    _bounded_batches(files)
    of = files.schema["source_id"].dataType.simpleString()
    schema = f"source_id {of}, line_no long, column long, name int, way string"
    files = files.select("source_id", "text").where("text is not null")
    out = None
    for turn in _turns(names) or [[]]:
        numbers, spelt = [k for k, _ in turn], files.sparkSession.sparkContext.broadcast(tuple(n for _, n in turn))

        def run(batches: Iterator[pa.RecordBatch], numbers=numbers, spelt=spelt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, rows = [], []
                for k, text in enumerate(batch.column(1)):
                    found = needles.find(text.as_py(), spelt.value, entities)
                    at += [k] * len(found)
                    rows += found
                line, column, name, way = ([r[k] for r in rows] for k in range(4))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(line, pa.int64()), pa.array(column, pa.int64()), pa.array([numbers[k] + 1 for k in name], pa.int32()), pa.array(way, pa.string())],
                    names=["source_id", "line_no", "column", "name", "way"],
                )
                pa.default_memory_pool().release_unused()

        found = files.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


# A dated exemption, in either order; the codes of findings.
DATED_EXEMPTION = r"(?i)\d{4}-\d{2}-\d{2}.{0,80}?\b(exempt|exemption|reaped|waiv)|\b(exempt|exemption|reaped|waiv)\w*.{0,80}?\d{4}-\d{2}-\d{2}"
ID, DATED, STAMPS, LITERAL = "E-CORPUS-VIDEO-ID", "E-CORPUS-DATED-EXEMPTION", "E-CORPUS-ANCHOR-SET", "E-CORPUS-REFUSED-WORD"
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def text_lines(files: DataFrame) -> DataFrame:
    """(source_id, line_no, text) of whole texts, lines from 1, ended as text files end them."""
    return files.select("source_id", F.posexplode(F.split("text", _LINE_END)).alias("at", "text")).select("source_id", (F.col("at") + 1).cast("long").alias("line_no"), "text")


def id_lines(lines: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(source_id, line_no, token) of id-shaped tokens that no allow-list names, each as often as it stands there."""
    tokens = lines.select("source_id", "line_no", F.explode(tx.id_shaped("text")).alias("token"))
    return tokens.where(~F.col("token").isin(allowed)) if allowed else tokens


def findings(files: DataFrame, names: list[str], sets: DataFrame, allowed: list[str] | None = None, entities: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(source_id, line_no, code, column, name, way) of all scans of whole texts (source_id, text), a row for each finding.

    column, name and way belong to refused words (see literals); a finding never repeats what was found.
    """
    lines = text_lines(files)
    none = (F.lit(None).cast("long").alias("column"), F.lit(None).cast("int").alias("name"), F.lit(None).cast("string").alias("way"))
    coded = lambda rows, code: rows.select("source_id", "line_no", F.lit(code).alias("code"), *none)
    words = literals(files, names, entities).select("source_id", "line_no", F.lit(LITERAL).alias("code"), "column", "name", "way")
    by_line = [coded(id_lines(lines, allowed), ID), coded(lines.where(F.col("text").rlike(DATED_EXEMPTION)), DATED), coded(contained_lines(lines, sets), STAMPS)]
    for part in by_line:
        words = words.unionByName(part)
    return words


def suffix(path: Column) -> Column:
    """The lower-cased suffix of a path's last part, empty without one."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]*)$", 1))


def suffix_census(files: DataFrame) -> DataFrame:
    """(suffix, files) of (path) rows."""
    return files.groupBy(suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("files"))


def scope(files: DataFrame, names: list[str], sets: DataFrame) -> DataFrame:
    """One row: what the scan could not have found. files: path, read (whether its text was read).

    blind is true where a required scan would have to count as not run.
    """
    names = [n for n in names if needles.squashed(n)]
    short = sum(map(needles.under_floor, names))
    rows = files.agg(F.count("*").alias("files"), F.count_if(~F.col("read")).alias("unread"))
    rows = rows.withColumn("literals", F.lit(len(names))).withColumn("stamp_sets", sets.agg(F.count("*")).scalar()).withColumn("under_floor", F.lit(short))
    return rows.withColumn("blind", (F.col("literals") == 0) | (F.col("files") == F.col("unread")) | (F.col("stamp_sets") == 0))
