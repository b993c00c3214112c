"""Stateful operators on streams: coalescing of text deltas and detection of double copies."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# When a coalesced text is passed on, and which gaps make a double copy.
FLUSH_CHARS, FLUSH_MS = 256, 180
GAP_MS, COOLDOWN_MS = (20, 2500), 1200


def coalesce(rows: list[tuple[int, str]], state: tuple[str, int | None]) -> tuple[list[tuple[int, str]], tuple[str, int | None]]:
    """Texts to pass on for (milliseconds, delta) rows: the first at once, then at 256 characters or 180 ms."""
    held, flushed = state
    out = []
    for ms, delta in rows:
        held += delta
        if held and (flushed is None or len(held) >= FLUSH_CHARS or ms - flushed >= FLUSH_MS):
            out.append((ms, held))
            held, flushed = "", ms
    return out, (held, flushed)


#: Nothing copied yet.
COPY_START = ("", -(10**9), "", -(10**9))


def double_copies(rows: list[tuple[int, str]], state: tuple[str, int, str, int]) -> tuple[list[int], tuple[str, int, str, int]]:
    """Times at which the same payload came twice within the gap, each payload at most once a cooldown."""
    last, at, fired, fired_at = state
    out = []
    for ms, payload in rows:
        cooled = fired != payload or ms - fired_at >= COOLDOWN_MS
        if payload == last and GAP_MS[0] <= ms - at <= GAP_MS[1] and cooled:
            out.append(ms)
            fired, fired_at = payload, ms
            last, at = "", ms
        else:
            last, at = payload, ms
    return out, (last, at, fired, fired_at)


def double_copy_rows(events: DataFrame, user: str, order: str, ms: str, payload: str) -> DataFrame:
    """user, order, ms of each double copy in a table: rows of a user stream by in order, and only the state of one user is held; rows without user or time are left out."""
    kinds = dict(events.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = None, COPY_START
        for df in frames:
            out = []
            for u, o, m, p in df.itertuples(index=False):
                state = state if u == here else COPY_START
                here = u
                hit, state = double_copies([(int(m), p)], state)
                if hit:
                    out.append((u, o, m))
            yield pd.DataFrame(out, columns=[user, order, ms])

    rows = events.select(user, order, F.col(ms).cast("long").alias(ms), F.coalesce(F.col(payload), F.lit("")).alias(payload)).where(F.col(ms).isNotNull() & F.col(user).isNotNull())
    return rows.repartition(user).sortWithinPartitions(user, ms, order).mapInPandas(run, f"{user} {kinds[user]}, {order} {kinds[order]}, {ms} long")


def _ordered(frames: Iterator[pd.DataFrame]) -> list[tuple[int, str]]:
    df = pd.concat(list(frames))
    df = df.sort_values(["ms", "seq"], kind="stable")
    return [(int(m), str(t)) for m, t in zip(df["ms"], df["text"], strict=True)]


def coalesced(stream: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """stream_id, ms, text from a stream of stream_id, seq, ts, text; what is left comes when time runs out."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else ("", -1)
        if state.hasTimedOut:
            state.remove()
            out = [(old[1], old[0])] if old[0] else []
        else:
            out, new = coalesce(_ordered(frames), (old[0], None if old[1] < 0 else old[1]))
            state.update((new[0], -1 if new[1] is None else new[1]))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 60_000)
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "ms": [m for m, _ in out], "text": [t for _, t in out]})

    rows = stream.withWatermark("ts", lateness).select("stream_id", "seq", "ts", F.unix_millis("ts").alias("ms"), "text")
    return rows.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, ms long, text string", "held string, flushed long", "append", GroupStateTimeout.EventTimeTimeout)


def double_copy_events(stream: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """user_id, ms of double copies in a stream of user_id, seq, ts, text."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else COPY_START
        out, new = double_copies(_ordered(frames), tuple(old))
        state.update(new)
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 60_000)
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "ms": out}).astype({"ms": "int64"})

    rows = stream.withWatermark("ts", lateness).select("user_id", "seq", "ts", F.unix_millis("ts").alias("ms"), "text")
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, ms long", "last string, at long, fired string, fired_at long", "append", GroupStateTimeout.EventTimeTimeout)
