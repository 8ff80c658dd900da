"""Caption files and text tables as Spark data sources, large files in parts.

register(spark) makes two formats known:

* tidemark-vtt: a row for each cue (path, at, start_s, end_s, lines). Option form: "capture" (times with hours, at the line's
  start; a cue's lines end at a blank line) or "grading" (hours may be missing, times anywhere on the line with a full stop;
  a cue's lines end at a blank line or the next times). lines are as they stand in the file.
* tidemark-lines: a row for each line (path, at, line), without its end.

at is the line's byte place in its file, which orders rows. Option split_bytes says how much of a file one task reads
(64 MB): a part begins after a line end, of captions after a blank line, and reads on to where the next one begins, so every
cue and line is read once and whole. Conditions on path that name files (= and IN) leave out the other files.

path is a file, a folder (all files in it) or a pattern, local or of any store that pyarrow reaches by an address; several are
separated by commas. Bytes that aren't UTF-8 are left out of captions and replaced in lines. A file that can't be opened fails
the job, and so does a path that names nothing.
"""

from __future__ import annotations

import fnmatch
import glob
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SPLIT_BYTES = 64 << 20
_PLACE = r"(\d{2}):(\d{2}):(\d{2})"
#: Times of a cue by form: pattern, and whether it may stand anywhere on the line.
FORMS = {
    "capture": re.compile(rf"{_PLACE}[.,](\d{{3}})\s+-->\s+{_PLACE}[.,](\d{{3}})"),
    "grading": re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{2})\.(\d{3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})\.(\d{3})"),
}


@dataclass
class Part(InputPartition):
    """The lines of a file that begin in [begin, end); captions: the blocks whose blank line does."""

    path: str
    begin: int
    end: int

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*://", path) else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of all files that a path names, in order."""
    from pyarrow import fs

    found: dict[str, int] = {}
    for one in filter(None, map(str.strip, path.split(","))):
        store, inner = _store(one)
        head = one[: len(one) - len(inner)]
        if re.search(r"[*?\[]", inner):
            if isinstance(store, fs.LocalFileSystem):
                names = [p for p in glob.glob(inner, recursive=True) if os.path.isfile(p)]
            else:
                top = re.match(r"[^*?\[]*/", inner)
                names = [f.path for f in store.get_file_info(fs.FileSelector(top[0].rstrip("/") if top else "", recursive=True)) if f.is_file and fnmatch.fnmatchcase(f.path, inner)]
            infos = store.get_file_info(names)
        else:
            (info,) = store.get_file_info([inner])
            infos = [f for f in store.get_file_info(fs.FileSelector(inner)) if f.is_file] if info.type == fs.FileType.Directory else [info] if info.is_file else []
        if not infos:
            raise FileNotFoundError(f"no file: {one}")
        found |= {head + f.path: f.size for f in infos}
    return sorted(found.items())


def lines_of(path: str, begin: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) of the lines that begin at begin or later, and before end."""
    store, inner = _store(path)
    with store.open_input_file(inner) as raw:
        at = max(0, begin - 1)
        raw.seek(at)
        # A line that begins before this part belongs to the part before.
        skip, rest = begin > 0, b""
        while True:
            block = raw.read(1 << 20)
            pieces = (rest + block).split(b"\n")
            rest = pieces.pop() if block else b""
            for line in pieces:
                if end is not None and at >= end and not skip:
                    return
                if not skip and (block or line):
                    yield at, line[:-1] if line.endswith(b"\r") else line
                skip, at = False, at + len(line) + 1
            if not block:
                return


def _seconds(hours: str | None, minutes: str, seconds: str, thousandths: str) -> float:
    return int(hours or 0) * 3600 + int(minutes) * 60 + int(seconds) + int(thousandths) / 1000.0


def cues(lines: Iterable[tuple[int, str]], form: str) -> Iterator[tuple[int, float, float, list[str]]]:
    """(place, start, end, lines) of the cues in (place, line), which begin after a blank line or at a file's start."""
    pattern, capture = FORMS[form], form == "capture"
    cue: tuple | None = None
    for at, line in lines:
        if not line.strip():
            if cue:
                yield cue
            cue = None
            continue
        # In the one form a cue's lines end at a blank line only, and times among them are text.
        times = None if capture and cue else pattern.match(line) if capture else pattern.search(line)
        if times:
            if cue:
                yield cue
            cue = (at, _seconds(*times.groups()[:4]), _seconds(*times.groups()[4:]), [])
        elif cue:
            cue[3].append(line)
    if cue:
        yield cue


class _FileReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a path is needed: load(path) or option path")
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        if self.split < 1:
            raise ValueError("split_bytes must be positive")
        self.named: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and tuple(f.attribute) == ("path",):
                self.named = set(values) if self.named is None else self.named & set(values)
            # Rows are filtered by Spark, too: names are compared there as they are shown.
            yield f

    def partitions(self) -> list[InputPartition]:
        files = [(p, n) for p, n in listed(self.path) if self.named is None or p in self.named]
        return [Part(p, at, min(at + self.split, size)) for p, size in files for at in range(0, size, self.split)]


class LinesReader(_FileReader):
    def read(self, part: Part | None) -> Iterator[tuple]:
        # Without any byte to read Spark asks for no part.
        for at, line in lines_of(part.path, part.begin, part.end) if part else ():
            yield part.path, at, line.decode("utf-8", "replace")


class CueReader(_FileReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.form = options.get("form", "capture")
        if self.form not in FORMS:
            raise ValueError(f"form must be one of {', '.join(FORMS)}")

    def read(self, part: Part | None) -> Iterator[tuple]:
        if part is None:
            return

        def own() -> Iterator[tuple[int, str]]:
            inside = part.begin == 0
            for at, raw in lines_of(part.path, part.begin):
                line = raw.decode("utf-8", "ignore")
                if at == 0:
                    line = line.removeprefix("﻿")
                blank = not line.strip()
                if blank and at >= part.end:
                    return
                inside = inside or blank
                if inside:
                    # Signs that end lines, too, end them here.
                    yield from ((at + k, one) for k, one in enumerate(line.splitlines() or [""]))

        for at, start, end, lines in cues(own(), self.form):
            yield part.path, at, start, end, lines


class Cues(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark-vtt"

    def schema(self) -> str:
        return "path string, at long, start_s double, end_s double, lines array<string>"

    def reader(self, schema) -> CueReader:
        return CueReader(self.options)


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark-lines"

    def schema(self) -> str:
        return "path string, at long, line string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it hand conditions on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Cues, Lines):
        spark.dataSource.register(source)
