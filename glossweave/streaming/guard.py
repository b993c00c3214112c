"""Previews of a streaming reply: pieces gather, small changes wait, and a reply in the wrong language ends its stream.

A piece that starts with all so far replaces it (some backends send the whole text each time), any other is added.
The first ``GUARDED`` characters are held against the expected language until there are as many; a mismatch closes the stream, and later
pieces count for nothing.  A change of less than ``LEAST_CHANGE`` characters within ``THROTTLE_MS`` of the last preview waits for more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glossweave.functions.guards import is_not_english
from glossweave.streaming.framing import GUARDED, LEAST_CHANGE, THROTTLE_MS

#: text, shown, time of the last preview, whether the guard still asks, whether the stream is closed
State = tuple[str, str, int, bool, bool]
START: State = ("", "", -(10**15), True, False)
Check = Callable[[str], bool]


def step(state: State, ms: int, piece: str | None, mismatched: Check | None) -> tuple[State, str | None]:
    """The state after a piece, and the preview to show or None."""
    text, shown, last, asks, closed = state
    if closed or not piece:
        return state, None
    text = piece if text and piece.startswith(text) else text + piece
    if text == shown:
        return (text, shown, last, asks, closed), None
    if asks and mismatched is not None:
        prefix = text.lstrip()[:GUARDED]
        if prefix and mismatched(prefix):
            return (text, shown, last, asks, True), None
        asks = len(prefix) < GUARDED
    if ms - last < THROTTLE_MS and abs(len(text) - len(shown)) < LEAST_CHANGE:
        return (text, shown, last, asks, closed), None
    return (text, text, ms, asks, closed), text


def rest(state: State) -> str | None:
    """What is left to show when a stream ends."""
    text, shown, _, _, closed = state
    return text if text and text != shown and not closed else None


def previews(pieces: DataFrame, stream: str = "stream_id", order: str = "seq", ms: str = "ms", piece: str = "text", expected: str = "en") -> DataFrame:
    """stream, order, ms, preview, kind (shown, last or closed) from a table of pieces; rows of a stream go by in order."""
    kinds = dict(pieces.dtypes)
    check = is_not_english if expected == "en" else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here: Any = None
        state, at = START, (None, 0)
        for df in frames:
            out: list[tuple] = []
            for s, o, m, p in df.itertuples(index=False):
                if s != here:
                    if here is not None and (left := rest(state)):
                        out.append((here, *at, left, "last"))
                    here, state = s, START
                was_closed = state[4]
                state, shown = step(state, int(m), p, check)
                at = (o, int(m))
                if shown is not None:
                    out.append((s, o, int(m), shown, "shown"))
                elif state[4] and not was_closed:
                    out.append((s, o, int(m), "", "closed"))
            yield pd.DataFrame(out, columns=[stream, order, ms, "preview", "kind"])
        if here is not None and (left := rest(state)):
            yield pd.DataFrame([(here, *at, left, "last")], columns=[stream, order, ms, "preview", "kind"])

    rows = pieces.select(stream, order, F.col(ms).cast("long").alias(ms), F.col(piece).alias(piece)).where(F.col(stream).isNotNull() & F.col(ms).isNotNull())
    return rows.repartition(stream).sortWithinPartitions(stream, ms, order).mapInPandas(run, f"{stream} {kinds[stream]}, {order} {kinds[order]}, {ms} long, preview string, kind string")


class Previewing(StatefulProcessor):
    """The same rule on a stream: a timer shows what is left when no piece has come for a while, and a later one ends the state's life."""

    SCHEMA = "stream_id long, ms long, preview string, kind string"
    IDLE_MS, LIFETIME_MS = 30_000, 3_600_000

    def __init__(self, expected: str = "en") -> None:
        self.check = is_not_english if expected == "en" else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("preview", "text string, shown string, last long, asks boolean, closed boolean, timer long, idle boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        state, timer = (tuple(held[:5]), held[5]) if held else (START, None)
        out: list[tuple] = []
        df = pd.concat(list(rows)).sort_values(["ms", "seq"], kind="stable")
        for ms, piece in zip(df["ms"], df["text"], strict=True):
            was_closed = state[4]
            state, shown = step(state, int(ms), piece, self.check)
            if shown is not None:
                out.append((key[0], int(ms), shown, "shown"))
            elif state[4] and not was_closed:
                out.append((key[0], int(ms), "", "closed"))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max(timerValues.getCurrentWatermarkInMs(), int(df["ms"].max())) + self.IDLE_MS
        self.handle.registerTimer(timer)
        self.state.update((*state, timer, False))
        yield pd.DataFrame(out, columns=["stream_id", "ms", "preview", "kind"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        if held is None:
            return
        if held[6]:
            self.state.clear()
            return
        # The stream stays known for its lifetime, so that a piece that comes even later goes on from here.
        left = rest(tuple(held[:5]))
        timer = expiredTimerInfo.getExpiryTimeInMs() + self.LIFETIME_MS
        self.handle.registerTimer(timer)
        self.state.update((held[0], held[0] if left else held[1], *held[2:5], timer, True))
        if left:
            yield pd.DataFrame([(key[0], expiredTimerInfo.getExpiryTimeInMs(), left, "last")], columns=["stream_id", "ms", "preview", "kind"])

    def close(self) -> None:
        pass


def preview_stream(stream: DataFrame, expected: str = "en", lateness: str = "10 seconds") -> DataFrame:
    """stream_id, ms, preview, kind from a stream of stream_id, seq, ts, text; needs the RocksDB state store."""
    rows = stream.withWatermark("ts", lateness).select("stream_id", "seq", "ts", F.unix_millis("ts").alias("ms"), "text")
    return rows.groupBy("stream_id").transformWithStateInPandas(Previewing(expected), Previewing.SCHEMA, "Append", "EventTime")
