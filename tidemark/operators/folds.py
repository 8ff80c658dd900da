"""Folds: scans whose state depends on what was kept, which no window expresses, spread over tasks within one recording.

Tasks stream rows in order, recording by recording, and hold one state at a time. A recording of up to ROWS rows is folded in
one go. A longer one is cut into stretches of about that many. Every stretch is first run from nothing, all at once, and says
in which state it ends. A stretch whose predecessor ends in another state than it was run from is run again from that one,
until none is left; then each was run from its true state. Folds forget quickly (a pause, a scene, a line that isn't
continued), so one or two turns do; a fold that never forgets takes as many turns as its longest recording has stretches, and
is right all the same.

States are compared as JSON text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.operators.running import KEY, STRETCH, numbered
from tidemark.operators.stages import stored

Advance = Callable[[object, Iterable[tuple]], tuple[list[tuple], object]]
_OWN = [KEY, "_stretch"]
_LAST = 1 << 62
#: Rows of a stretch; a recording of fewer is never cut.
ROWS = 100_000
#: Outputs after which a task hands on what it has.
_BATCH = 5000


def _values(column: pa.Array) -> list:
    """Python values; a null number is not a number, so that it compares with others."""
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(column.type) else column.to_pylist()


def _cuts(rows: DataFrame) -> DataFrame:
    """(recording_id, _from) of recordings longer than ROWS: the places at which their stretches after the first begin.

    There is at most one place for each ROWS rows of the input, so this is broadcast.
    """
    sizes = rows.groupBy(KEY, "_at").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(KEY).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    cut = sizes.select(KEY, "_at", F.floor(before / ROWS).alias("_part")).where("_part > 0")
    return stored(cut.groupBy(KEY, "_part").agg(F.min("_at").alias("_at")).groupBy(KEY).agg(F.array_sort(F.collect_list("_at")).alias("_from")))


def folded(rows: DataFrame, columns: list[str], order: list[str], schema: str, advance: Advance, finish: Callable[[object], list[tuple]] | None = None, stretch: float | None = None, number: str | None = None) -> DataFrame:
    """(recording_id, ...schema) of what a fold gives for each recording's rows (columns), in that order.

    advance(state, rows) gives outputs and the state after the rows; the first state is None and all are fit for JSON.
    finish(state) gives what is left at a recording's end. order[0] is a number; long recordings are cut at multiples of
    stretch. number names a column for the outputs' places in their recording.
    """
    stretch = STRETCH if stretch is None else stretch
    rows = rows.select(KEY, *columns, F.coalesce(F.floor(F.col(order[0]) / stretch).cast("long"), F.lit(-(2**63)).cast("long")).alias("_at"))
    cuts = _cuts(rows)
    long = cuts.limit(1).count() > 0
    if long:
        part = F.when(F.col("_from").isNotNull(), F.size(F.filter("_from", lambda a: a <= F.col("_at")))).cast("long")
        rows = rows.join(F.broadcast(cuts), rows[KEY].eqNullSafe(cuts[KEY]), "left").select(rows[KEY], *columns, part.alias("_stretch"))
    else:
        rows = rows.select(KEY, *columns, F.lit(None).cast("long").alias("_stretch"))
    full = f"{KEY} {rows.schema[KEY].dataType.simpleString()}, _stretch long, _seq long, _before string, _after string, {schema}"
    names = [KEY, "_stretch", "_seq", "_before", "_after", *(f.split()[0] for f in schema.split(","))]
    width = len(names) - 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = to_arrow_schema(out_schema)
        blank = (None,) * width

        def listed() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*map(_values, batch.columns), strict=True)

        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type, from_pandas=True) for k, f in enumerate(own)], schema=own)

        found: list[tuple] = []
        for (key, at, before), group in groupby(listed(), key=lambda r: r[:3]):
            out, state = advance(json.loads(before), (r[3:] for r in group))
            found += [(key, at, k, None, None, *o) for k, o in enumerate(out)]
            if at is not None:
                found.append((key, at, -1, before, json.dumps(state), *blank))
            elif finish:
                found += [(key, at, len(out) + k, None, None, *o) for k, o in enumerate(finish(state))]
            if len(found) >= _BATCH:
                yield made(found)
                found = []
        if found:
            yield made(found)

    def all_run(df: DataFrame) -> DataFrame:
        dealt = df.select(KEY, "_stretch", "_before", *columns).repartition(KEY, "_stretch")
        later = [F.col(c).asc_nulls_last() for c in order[1:]]
        return dealt.sortWithinPartitions(KEY, "_stretch", order[0], *later).mapInArrow(run, full)

    out_schema = StructType.fromDDL(full)
    begun = rows.withColumn("_before", F.lit("null"))
    if not long:
        out = all_run(begun)
        return out.select(KEY, *([F.col("_seq").alias(number)] if number else []), *names[5:])
    found, held = stored(all_run(begun)), None
    earlier = F.coalesce(F.lag("_after").over(Window.partitionBy(KEY).orderBy("_stretch")), F.lit("null"))
    while True:
        states = found.where("_seq = -1")
        wrong = stored(states.select(*_OWN, "_before", earlier.alias("_wanted")).where("_wanted <> _before").select(*_OWN, F.col("_wanted").alias("_before")))
        if not wrong.limit(1).count():
            break
        held = held or stored(rows.where("_stretch is not null"))
        again = all_run(held.join(F.broadcast(wrong), _OWN))
        found = stored(found.join(F.broadcast(wrong.select(*_OWN)), _OWN, "left_anti").unionByName(again))
    out = found.where("_seq >= 0").drop("_before", "_after")
    if finish:
        kept_schema = out.schema

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = to_arrow_schema(kept_schema)
            for batch in batches:
                made = [(key, at, _LAST + k, *o) for key, at, state in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, o in enumerate(finish(json.loads(state)))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], f.type, from_pandas=True) for k, f in enumerate(own)], schema=own)

        last = states.groupBy(KEY).agg(F.max("_stretch").alias("_stretch"), F.max_by("_after", "_stretch").alias("_after"))
        out = out.unionByName(last.mapInArrow(ends, kept_schema))
    if number:
        cut = numbered(out.where("_stretch is not null"), ["_stretch", "_seq"], number, stretch=1.0)
        whole = out.where("_stretch is null").withColumn(number, F.col("_seq"))
        return cut.select(KEY, number, *names[5:]).unionByName(whole.select(KEY, number, *names[5:]))
    return out.select(KEY, *names[5:])
