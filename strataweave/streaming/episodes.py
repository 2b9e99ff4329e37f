"""Conversations as episodes: a body a turn, and sessions that an end event or a silence closes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "times array<long>, ids array<long>, kinds array<string>, ends array<boolean>"


def turn_episodes(messages: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """session, turn (from 1), body: each user message with the assistant's next one, if it comes before another user message. Null contents are empty."""
    line = Window.partitionBy(session).orderBy(order)
    follows = F.lead("role").over(line) == "assistant"
    said = F.coalesce("content", F.lit(""))
    rows = messages.select(session, order, "role", said.alias("_said"), F.when(follows, F.lead(said).over(line)).otherwise("").alias("_answer")).filter("role = 'user'")
    return rows.select(session, F.row_number().over(line).alias("turn"), F.concat(F.lit("user: "), "_said", F.lit("\nassistant: "), "_answer").alias("body"))


def _sessions(rows: list[tuple], gap: int) -> list[tuple[list[tuple], int]]:
    """Rows (ts, id, kind, end) in order as sessions with the time at which each is closed."""
    found: list[tuple[list[tuple], int]] = []
    for row in rows:
        if not found or found[-1][0][-1][3] or row[0] - found[-1][0][-1][0] >= gap:
            found.append(([], 0))
        held = found[-1][0]
        held.append(row)
        found[-1] = (held, row[0] if row[3] else row[0] + gap)
    return found


def session_episodes(turns: DataFrame, key: str, gap: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """key, started, ended, turns, topics, closed_by of a stream of (key, ts, id, kind, is_end): a row a session once it can change no more.

    A session is closed by a turn with ``is_end`` or by a silence of ``gap`` after its last turn, and is given when the watermark (``late`` behind the newest turn) has reached that time; turns may come in
    any order before. State of a key holds the turns of its open sessions only. Ties are ordered by id; topics are the kinds of its turns, sorted; rows without a time are left out, and a null ``is_end`` is no end.
    """
    step = int(pd.Timedelta(gap).total_seconds() * 1_000_000)

    def fold(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*map(list, state.get))) if state.exists else []
        for frame in [] if state.hasTimedOut else frames:
            held += zip(frame["_us"].astype("int64").tolist(), frame["id"].astype("int64").tolist(), [None if pd.isna(k) else k for k in frame["kind"]], frame["is_end"].astype(bool).tolist())
        held.sort(key=lambda r: r[:2])
        mark, out = state.getCurrentWatermarkMs(), []
        sessions = _sessions(held, step)
        while sessions and -(-sessions[0][1] // 1000) <= mark:
            rows, _ = sessions.pop(0)
            out.append((who[0], pd.Timestamp(rows[0][0], unit="us"), pd.Timestamp(rows[-1][0], unit="us"), len(rows), sorted({r[2] for r in rows if r[2] is not None}), "end" if rows[-1][3] else "silence"))
        if sessions:
            state.update(tuple(list(c) for c in zip(*(r for rows, _ in sessions for r in rows))))
            state.setTimeoutTimestamp(max(-(-sessions[0][1] // 1000) - 1, mark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "started", "ended", "turns", "topics", "closed_by"])

    kind = turns.schema[key].dataType.simpleString()
    rows = turns.filter("ts is not null").withWatermark("ts", late)
    rows = rows.select(key, "ts", F.unix_micros("ts").alias("_us"), F.col("id").cast("long").alias("id"), "kind", F.coalesce("is_end", F.lit(False)).alias("is_end"))
    made = f"{key} {kind}, started timestamp, ended timestamp, turns long, topics array<string>, closed_by string"
    return rows.groupBy(key).applyInPandasWithState(fold, made, STATE, "append", GroupStateTimeout.EventTimeTimeout)
