"""Clock strings and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """Seconds of SS, MM:SS or HH:MM:SS(.fraction); null if blank or unreadable."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when((F.size(parts) <= 3) & ~F.exists(parts, lambda x: x.isNull()), total)


def parse_clock(text: Column) -> Column:
    """As parse_time, but fields after the first must be below 60."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    late = F.slice(parts, 2, 3)
    return F.when(~F.exists(late, lambda x: x >= 60), parse_time(text))


def _shown(total: Column) -> Column:
    total = total.cast("long")
    hours, minutes, seconds = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    return F.when(total >= 3600, F.format_string("%d:%02d:%02d", hours, minutes, seconds)).otherwise(F.format_string("%02d:%02d", minutes, seconds))


def stamp(seconds: Column) -> Column:
    """MM:SS or H:MM:SS, truncated to whole seconds."""
    return _shown(F.floor(seconds))


def rounded_stamp(seconds: Column) -> Column:
    """MM:SS or H:MM:SS, rounded half-even to whole seconds."""
    return _shown(F.bround(seconds, 0))
