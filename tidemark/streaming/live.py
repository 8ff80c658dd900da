"""Live scans over a stream of segments: coverage by event-time windows, and last-kept frame selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def activity(segments: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """(recording_id, window, segments, words) of a stream with a timestamp column ts and text."""
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']+"), F.lit(0)))
    grouped = segments.withWatermark("ts", late).groupBy("recording_id", F.window("ts", window, slide))
    return grouped.agg(F.count("*").alias("segments"), F.sum(words).alias("words"))


def spaced(times: DataFrame, min_gap: float = 20.0, late: str = "1 hour", forget: int = 86_400_000) -> DataFrame:
    """(recording_id, at_s) of a stream's moments at least min_gap after the last one let through.

    The state of a recording is one number. With a timestamp column ts it is forgotten that many milliseconds after the
    recording's latest moment, by a watermark that waits so long for late ones; without, it stays. Moments of one micro-batch
    are taken in order; one that arrives later than a moment before which it lies is passed over, as what was let through
    can't be taken back.
    """
    timed = "ts" in times.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches))
        picked = []
        for at in sorted(rows["at_s"].dropna()):
            if last is None or at - last >= min_gap:
                last = at
                picked.append(at)
        if last is not None:
            state.update((last,))
            if timed:
                state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + forget)
        yield pd.DataFrame({"recording_id": [key[0]] * len(picked), "at_s": picked})

    grouped = (times.withWatermark("ts", late) if timed else times).groupBy("recording_id")
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return grouped.applyInPandasWithState(step, "recording_id long, at_s double", "last double", "append", timeout)
