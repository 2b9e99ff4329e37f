"""Keyed state over streams: clamped running values, promotion by frequency, silent keys.

Each function takes a stream with an event-time column ``ts`` and returns a stream; a key's rows are folded in order of time and id within a
micro-batch, in frames of bounded size, and what is kept of a key is a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ordered(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch in order; the trigger's file or offset limit bounds them."""
    held = list(frames)
    return pd.concat(held, ignore_index=True).sort_values(order, kind="stable") if held else pd.DataFrame()


def clamped_values(steps: DataFrame, key: str, start: float, low: float, high: float) -> DataFrame:
    """key, value, seen after each micro-batch of (key, ts, id, step): a sum clamped after every step, and the number of its steps."""

    def fold(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, seen = state.get if state.exists else (start, 0)
        for step in _ordered(frames, ["ts", "id"])["step"]:
            value, seen = min(max(value + float(step), low), high), seen + 1
        state.update((value, seen))
        yield pd.DataFrame({key: [who[0]], "value": [value], "seen": [seen]})

    kind = steps.schema[key].dataType.simpleString()
    return steps.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, value double, seen long", "value double, seen long", "update", GroupStateTimeout.NoTimeout)


def promoted_by_frequency(queries: DataFrame, key: str, least: int = 10, hours: float = 24.0, share: float = 0.5) -> DataFrame:
    """key, ts, queries, hits: each time that a key has ``least`` queries (key, ts, id, hit) within the hours after its first and enough of them hit.

    A query later than that starts the count again, as its first and with no hits; a promotion clears it.
    """

    def fold(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, hits, misses, first = state.get if state.exists else (0, 0, 0, 0.0)
        found = []
        rows = _ordered(frames, ["ts", "id"])
        for ts, hit in zip(rows["ts"], rows["hit"], strict=True):
            now = ts.timestamp()
            count, hits, misses = count + 1, hits + bool(hit), misses + (not hit)
            first = first if count > 1 else now
            if now - first > hours * 3600:
                count, hits, misses, first = 1, 0, 0, now
            elif count >= least and hits >= share * (hits + misses):
                found.append((who[0], ts, count, hits))
                count, hits, misses, first = 0, 0, 0, 0.0
        state.update((count, hits, misses, first))
        yield pd.DataFrame(found, columns=[key, "ts", "queries", "hits"])

    kind = queries.schema[key].dataType.simpleString()
    return queries.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, ts timestamp, queries long, hits long", "count long, hits long, misses long, first double", "append", GroupStateTimeout.NoTimeout)


def silent(beats: DataFrame, key: str, seconds: float, late: str = "0 seconds") -> DataFrame:
    """key, last, state: "degraded" once the watermark is more than the seconds past a key's last beat (key, ts); a later beat starts anew."""

    def fold(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [who[0]], "last": [pd.Timestamp(last, unit="us")], "state": ["degraded"]})
            return
        last = max([state.get[0] if state.exists else 0, *(int(f["ts"].max().value // 1000) for f in frames)])
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last // 1000 + seconds * 1000), state.getCurrentWatermarkMs() + 1))

    kind = beats.schema[key].dataType.simpleString()
    return beats.withWatermark("ts", late).groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, last timestamp, state string", "last long", "append", GroupStateTimeout.EventTimeTimeout)
