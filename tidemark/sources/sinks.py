"""Writing files of rows, all or none.

The format tidemark-files takes rows (path, content, refused) and makes the file path, under the folder that is written to, of
each. Tasks write into a folder of their own run; only when all have done so, and no row was refused, are the files moved to
where they belong. A refused row (refused says why), a path that leaves the folder, two rows of one path, or a target that is
there already fail the write by name, and the folder is left as it was: what was staged goes, and what had been moved when a
later move failed goes back. Option replace lets targets be there; each is then replaced in one step, and put back on failure.

Targets are made by linking, which fails where a file is there, so two writers can't both make it. The folder is one that the
driver and all executors share. A folder of staged files that a killed driver left behind is named .tidemark- and may go.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row


@dataclass
class Staged(WriterCommitMessage):
    """Where a task has listed what it staged; the list itself stays in the folder."""

    listing: str

    def __init__(self, listing: str):
        self.listing = listing


def _inside(root: str, path: str) -> str:
    target = os.path.normpath(os.path.join(root, path))
    if os.path.isabs(path) or not path or target == root or not target.startswith(root + os.sep):
        raise ValueError(f"not a path within the folder: {path!r}")
    return target


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        if not options.get("path"):
            raise ValueError("a folder is needed: save(path)")
        if missing := {"path", "content"} - set(columns):
            raise ValueError(f"rows lack {', '.join(sorted(missing))}")
        self.root = os.path.normpath(options["path"].removeprefix("file://"))
        self.replace = str(options.get("replace", "false")).lower() == "true"
        self.staging = os.path.join(self.root, f".tidemark-{uuid.uuid4().hex}")
        # Only the driver makes this folder, so tasks that outlive a failed write can't bring it back.
        os.makedirs(self.staging)

    def write(self, rows: Iterator[Row]) -> Staged:
        own = os.path.join(self.staging, uuid.uuid4().hex)
        os.mkdir(own)
        listing = own + ".list"
        with open(listing, "w", encoding="utf-8") as names:
            for k, row in enumerate(rows):
                told = row.asDict()
                if told.get("refused") is not None:
                    raise ValueError(f"refused: {told['path']}: {told['refused']}")
                _inside(self.root, told["path"] or "")
                staged = os.path.join(own, str(k))
                with open(staged, "w", encoding="utf-8", newline="") as f:
                    f.write(told["content"] or "")
                    f.flush()
                    os.fsync(f.fileno())
                names.write(json.dumps([told["path"], staged]) + "\n")
        return Staged(listing)

    def _listed(self, messages: list[Staged | None]) -> Iterator[tuple[str, str]]:
        for m in messages:
            if m is not None:
                with open(m.listing, encoding="utf-8") as names:
                    for line in names:
                        path, staged = json.loads(line)
                        yield _inside(self.root, path), staged

    def commit(self, messages: list[Staged | None]) -> None:
        made, kept = [], os.path.join(self.staging, "kept")
        os.makedirs(kept, exist_ok=True)
        try:
            seen = set()
            for target, _ in self._listed(messages):
                if target in seen:
                    raise FileExistsError(f"two rows of one path: {os.path.relpath(target, self.root)}")
                if os.path.lexists(target) and not self.replace:
                    raise FileExistsError(f"there already: {os.path.relpath(target, self.root)}")
                seen.add(target)
            for k, (target, staged) in enumerate(self._listed(messages)):
                os.makedirs(os.path.dirname(target), exist_ok=True)
                before = None
                if self.replace and os.path.lexists(target):
                    before = os.path.join(kept, str(k))
                    os.link(target, before)
                    shutil.copymode(target, staged)
                    made.append((target, before))
                    os.replace(staged, target)
                else:
                    os.link(staged, target)
                    made.append((target, before))
        except BaseException:
            for target, before in reversed(made):
                if before:
                    os.replace(before, target)
                else:
                    os.unlink(target)
            raise
        finally:
            self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        # Tasks that still run may put files into a folder that is being removed.
        for _ in range(50):
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.exists(self.staging):
                return
            time.sleep(0.1)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark-files"

    def schema(self) -> str:
        return "path string, content string, refused string"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("a folder is never overwritten as a whole: use append, and option replace")
        return FilesWriter(self.options, schema.names)


def write_files(rows: DataFrame, folder: str, replace: bool = False) -> None:
    """Write (path, content[, refused]) rows as files of a folder, all or none."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(Files)
    refused = F.col("refused") if "refused" in rows.columns else F.lit(None)
    out = rows.select(F.col("path").cast("string"), F.col("content").cast("string"), refused.cast("string").alias("refused"))
    out.write.format("tidemark-files").option("replace", replace).mode("append").save(folder)


def with_refusals(rows: DataFrame, refusals: DataFrame, key: str = "note") -> DataFrame:
    """rows with refused: the codes of (key, code) that speak against a row, null for none."""
    codes = refusals.where("code is not null").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("refused"))
    return rows.join(codes, key, "left")


def file_notes(notes_: DataFrame, refusals: DataFrame, folder: str) -> None:
    """Write notes (note, content) under their names, unless (note, code) speaks against any of them."""
    write_files(with_refusals(notes_, refusals).select(F.col("note").alias("path"), "content", "refused"), folder)


def replace_notes(rendered: DataFrame, folder: str) -> None:
    """Write bodies (note, content) in place of the notes, each in one step, all or none."""
    write_files(rendered.select(F.col("note").alias("path"), "content"), folder, replace=True)
