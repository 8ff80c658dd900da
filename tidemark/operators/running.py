"""Running values within a recording, in two levels, so that one long recording spreads over tasks.

Rows are dealt by (recording, stretch of time). A window runs within each stretch; each stretch's own total is a row of a small
table, over which the totals before each stretch are carried; and a row's value is the carry and what its stretch has so far.
No window holds a recording's rows. Rows of one second or line stay in one stretch, so order is as if there were no stretches.

Rows whose recording is null belong to no order and are left out; a null time comes first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"
#: Seconds (or lines, or whatever the rows are in order of) of a stretch.
STRETCH = 3600.0


@dataclass(frozen=True)
class Running:
    """One running value: how a window reads it, how a stretch totals it, and how the two are put together."""

    within: Callable[[Window], Column]
    total: Callable[[Column, Callable], Column]
    carried: Callable[[Window, Column], Column]
    joined: Callable[[Column, Column], Column]


def _frame(order: Window, inclusive: bool) -> Window:
    return order.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def most(value: Column, inclusive: bool = False) -> Running:
    """The largest value of the rows before (and with) this one; null without any."""
    return Running(lambda o: F.max(value).over(_frame(o, inclusive)), lambda at, last: F.max(value), lambda o, t: F.max(t).over(_frame(o, False)), lambda a, b: F.greatest(a, b))


def total(value: Column, inclusive: bool = True) -> Running:
    """The sum of the rows before (and with) this one; null without any."""
    return Running(lambda o: F.sum(value).over(_frame(o, inclusive)), lambda at, last: F.sum(value), lambda o, t: F.sum(t).over(_frame(o, False)), lambda a, b: F.coalesce(a + b, a, b))


def latest(value: Column, inclusive: bool = True) -> Running:
    """The last value that isn't null of the rows before (and with) this one."""
    held = F.when(value.isNotNull(), F.struct(value.alias("v")))
    return Running(lambda o: F.last(held, True).over(_frame(o, inclusive)), lambda at, last: last(held, F.when(value.isNotNull(), at)), lambda o, t: F.last(t, True).over(_frame(o, False)), lambda a, b: F.coalesce(a, b)["v"])


def previous(value: Column) -> Running:
    """The value of the row before, be it null; null for a recording's first row."""
    held = F.struct(value.alias("v"))
    return Running(lambda o: F.lag(held).over(o), lambda at, last: last(held, at), lambda o, t: F.lag(t).over(o), lambda a, b: F.coalesce(a, b)["v"])


def running(rows: DataFrame, order: list[str], values: dict[str, Running], keys: tuple[str, ...] = (KEY,), stretch: float | None = None, backwards: bool = False) -> DataFrame:
    """rows with a column for each running value, in the order of those columns (the first of which is a number)."""
    stretch = STRETCH if stretch is None else stretch
    way = (lambda c: F.col(c).desc()) if backwards else F.col
    rows = rows.withColumn("_stretch", F.coalesce(F.floor(F.col(order[0]) / stretch).cast("long"), F.lit(-(2**63)).cast("long")))
    own = Window.partitionBy(*keys, "_stretch").orderBy(*map(way, order))
    over = Window.partitionBy(*keys).orderBy(way("_stretch"))
    at, last = F.struct(*order), F.min_by if backwards else F.max_by
    totals = rows.groupBy(*keys, "_stretch").agg(*(r.total(at, last).alias(f"_t_{name}") for name, r in values.items()))
    carries = totals.select(*keys, "_stretch", *(r.carried(over, F.col(f"_t_{name}")).alias(f"_c_{name}") for name, r in values.items()))
    inside = rows.select("*", *(r.within(own).alias(f"_w_{name}") for name, r in values.items()))
    met = inside.join(carries, [*keys, "_stretch"])
    return met.select(*(c for c in rows.columns if c != "_stretch" and c not in values), *(r.joined(F.col(f"_w_{name}"), F.col(f"_c_{name}")).alias(name) for name, r in values.items()))


def numbered(rows: DataFrame, order: list[str], name: str, keys: tuple[str, ...] = (KEY,), stretch: float | None = None) -> DataFrame:
    """rows with their place (from 0) in a recording."""
    found = running(rows, order, {name: total(F.lit(1).cast("long"))}, keys, stretch)
    return found.withColumn(name, F.col(name) - 1)
