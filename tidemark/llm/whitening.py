"""Embedding whitening from an exact integer scatter.

Entries become integers, x = floor(SCALE * c) + OFFSET. From these a shift is subtracted, and each task adds up sums and
cross-products exactly: in floating point while every partial sum is below 2^53 (where it is exact too), else in Python's
integers of any size. Tasks hand their sums on as limbs of LIMB bits, which Spark adds as longs. The driver forms
n * XtX - S St in whole numbers and only then divides by n^2, so the covariance is rounded once, and decomposes it by eigh.
What the driver and each task hold is bounded by the square of the dimension, not by the number of vectors.

Components are numbered by falling eigenvalue; each has its largest entry (the first, in ties) positive. A component whose
eigenvalue is no more than rounding (SINGULAR times the largest) can't be scaled to unit variance and is left out.

Cases: a vector that is null or empty, or holds a null, NaN or infinite entry, is dropped; vectors of several lengths are an
error; null ids stay; repeated rows count and return as often as they occur; equal vectors get equal values; extra columns are
ignored; no vectors, one vector, or equal vectors only: no component, so no row. Entries of any finite size are exact; a
deviation of over 38 digits is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

SCALE, OFFSET = 64, 1_000_000
LIMB = 28
MOST_COMPONENTS = 32
SINGULAR = 1e-12
#: Vectors that one vectorised step holds.
SLICE_ROWS = 4096


@dataclass
class Model:
    """n vectors with sums (of the shifted integers), the components as columns, eigenvalues and their shares of the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def vectors(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, entries as doubles) of the batch's usable vectors, in slices of one length each."""
    at = batch.schema.get_field_index(column)
    for start in range(0, batch.num_rows, SLICE_ROWS):
        lists = batch.column(at).slice(start, SLICE_ROWS)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        values = np.asarray(pc.fill_null(flat.cast(pa.float64()), math.nan))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        good = (np.bincount(owner, weights=~np.isfinite(values), minlength=len(lengths)) == 0) & (lengths > 0)
        for length in np.unique(lengths[good]).tolist():
            rows = np.flatnonzero(good & (lengths == length))
            kept = values[np.repeat(good & (lengths == length), lengths)]
            yield start + rows, kept.reshape(-1, length)


def integers(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) of each entry, as longs or, where one doesn't fit, as Python's integers. OFFSET is the shift left out."""
    scaled = np.floor(entries * SCALE) if SCALE * np.abs(entries).max(initial=0) < 2.0**62 else None
    if scaled is not None:
        return scaled.astype(np.int64)
    return np.asarray([[math.floor(SCALE * c) if abs(c) < 2.0**900 else math.floor(c) * SCALE for c in row] for row in entries.tolist()], dtype=object)


def products(y: np.ndarray) -> np.ndarray:
    """YtY exactly, as Python's integers."""
    most = int(np.abs(y).max(initial=0))
    step = (1 << 53) // max(1, most * most)
    if y.dtype == object or not step:
        y = y.astype(object)
        return y.T.dot(y)
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for k in range(0, len(y), step):
        part = y[k : k + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def limbs(values: list[int]) -> Iterator[tuple[int, int, int]]:
    """(place, limb, long) of each number that isn't zero; the last limb carries the sign."""
    for place, v in enumerate(values):
        k = 0
        while not -(1 << LIMB) < v < (1 << LIMB):
            yield place, k, v & ((1 << LIMB) - 1)
            v, k = v >> LIMB, k + 1
        if v:
            yield place, k, v


def scatter(table: DataFrame, column: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, cross-products) of the table's shifted integers, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, entries in vectors(batch, column):
                y = integers(entries)
                own = held.setdefault(y.shape[1], [0, 0, 0])
                own[0] += len(y)
                own[1] = own[1] + y.astype(object).sum(axis=0)
                own[2] = own[2] + products(y)
        for length, (n, sums, cross) in held.items():
            upper = np.triu_indices(length)
            place, limb, value = zip(*limbs([n, *sums.tolist(), *cross[upper].tolist()]), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([length] * len(place), pa.int32()), pa.array(place, pa.int64()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], names=["length", "place", "limb", "value"])

    parts = table.select(column).mapInArrow(run, "length int, place long, limb int, value long")
    rows = parts.groupBy("length", "place", "limb").agg(F.sum("value").alias("value")).toArrow().to_pydict()
    lengths = sorted(set(rows["length"]))
    if len(lengths) > 1:
        raise ValueError(f"vectors have several lengths: {lengths[:5]}")
    d = lengths[0] if lengths else 0
    flat = [0] * (1 + d + d * (d + 1) // 2)
    for place, limb, value in zip(rows["place"], rows["limb"], rows["value"], strict=True):
        flat[place] += value << (LIMB * limb)
    cross = np.zeros((d, d), dtype=object)
    cross[np.triu_indices(d)] = flat[1 + d :]
    cross.T[np.triu_indices(d)] = flat[1 + d :]
    return flat[0], np.asarray(flat[1 : 1 + d], dtype=object), cross


def fit(table: DataFrame, column: str = "embedding", most: int = MOST_COMPONENTS) -> Model:
    """The whitening of all usable vectors of the table."""
    n, sums, cross = scatter(table, column)
    exact = n * cross - np.multiply.outer(sums, sums)
    covariance = np.asarray([[v / (n * n) for v in row] for row in exact.tolist()], dtype=np.float64).reshape(len(sums), len(sums))
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > SINGULAR * max(values.max(initial=0.0), 0.0)]
    columns = columns[:, order]
    largest = np.argmax(np.abs(columns).round(12), axis=0) if columns.size else np.zeros(0, dtype=int)
    columns = columns * np.sign(columns[largest, np.arange(columns.shape[1])])
    trace = sum(exact.diagonal().tolist()) / (n * n) if n else 0.0
    return Model(n, sums, columns, values[order], values[order] / trace if len(order) else values[order])


def centred(entries: np.ndarray, model: Model) -> np.ndarray:
    """n * x - S of each entry, exactly; the shift cancels."""
    y, most = integers(entries), max([0, *map(abs, model.sums.tolist())])
    if y.dtype != object and model.n * int(np.abs(y).max(initial=0)) + most < 1 << 63:
        return model.n * y - model.sums.astype(np.int64)
    return model.n * y.astype(object) - model.sums


def squares(centre: np.ndarray) -> list[int]:
    """The sum of squares of each row, exactly."""
    most = int(np.abs(centre).max(initial=0))
    if centre.dtype != object and most * most * centre.shape[1] < 1 << 63:
        return np.einsum("ij,ij->i", centre, centre).tolist()
    whole = centre.astype(object)
    return (whole * whole).sum(axis=1).tolist()


def projected(centre: np.ndarray, model: Model) -> np.ndarray:
    """Whitened coordinates, (rows, components)."""
    return (centre.astype(np.float64) / model.n) @ model.components / np.sqrt(model.values)


def identity_error(table: DataFrame, model: Model, column: str = "embedding") -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity, measured from the rows.

    Rows are centred before they are multiplied: n * x - S sums to exactly zero in every dimension.
    """
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for _, entries in vectors(batch, column):
                white = projected(centred(entries, model), model)
                total += white.T @ white
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int64()), pa.array(total.ravel())], names=["place", "value"])

    if not k:
        return 0.0
    rows = table.select(column).mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    found = np.zeros(k * k)
    found[rows.column("place").to_numpy()] = rows.column("value").to_numpy()
    return float(np.abs(found.reshape(k, k) / model.n - np.eye(k)).max())


def whiten(table: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    deviation, decimal(38,0): the sum over dimensions of (n * x - S)^2, exactly, or null beyond 38 digits.
    """
    bounded_batches(table.sparkSession)
    model = fit(table, column, most)
    error, k = identity_error(table, model, column), len(model.values)
    of = table.schema[id_column].dataType.simpleString()
    schema = f"vec_id {of}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, entries in vectors(batch, column):
                if not k:
                    continue
                centre = centred(entries, model)
                white, own = projected(centre, model), [Decimal(v) if v < 10**38 else None for v in squares(centre)]
                number = np.repeat(np.arange(len(rows)), k)
                columns = [
                    batch.column(0).take(pa.array(rows[number])), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(len(number), model.n), pa.int64()),
                    pa.array(own, pa.decimal128(38, 0)).take(pa.array(number)), pa.array(white.ravel()), pa.array(np.tile(model.explained, len(rows))), pa.array(np.full(len(number), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.select(id_column, column).mapInArrow(run, schema)
