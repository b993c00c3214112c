"""Framing of streams: event streams from pieces of any cut, and chunked bodies."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How soon and how small a change of a preview may be, and how much of it is held against the language.
THROTTLE_MS, LEAST_CHANGE, GUARDED = 80, 3, 256


def payloads(pieces: Iterable[str]) -> Iterator[str]:
    """The data of each event up to the end mark; other lines are skipped."""
    held = ""
    for piece in pieces:
        held += piece
        *lines, held = held.split("\n")
        for line in lines:
            line = line.strip("\r")
            if line.startswith("data:"):
                data = line[5:].strip()
                if data == "[DONE]":
                    return
                yield data


def delta(data: str) -> str:
    """The text of a payload; empty where it can't be read."""
    try:
        return json.loads(data)["choices"][0]["delta"]["content"] or ""
    except (ValueError, LookupError, TypeError):
        return ""


def sse(pieces: DataFrame, stream: str, order: str, chunk: str) -> DataFrame:
    """stream, text, events (those with text) of each stream; pieces go by in order and only an open line is held."""
    schema = f"{stream} {pieces.schema[stream].dataType.simpleString()}, text string, events long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, got = None, []

        def said() -> pd.DataFrame:
            texts = [t for t in map(delta, payloads(got)) if t]
            return pd.DataFrame({stream: [here], "text": ["".join(texts)], "events": [len(texts)]})

        for df in frames:
            for key, piece in zip(df[stream], df[chunk], strict=True):
                if key != here:
                    if here is not None:
                        yield said()
                    here, got = key, []
                got.append(piece)
        if here is not None:
            yield said()

    return pieces.select(stream, order, chunk).repartition(stream).sortWithinPartitions(stream, order).mapInPandas(run, schema)


def dechunk(raw: bytes) -> bytes:
    """The body inside chunk frames; what is cut off ends it."""
    out, at = b"", 0
    while (end := raw.find(b"\r\n", at)) >= 0:
        try:
            n = int(raw[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if n == 0:
            break
        out += raw[end + 2 : end + 2 + n]
        at = end + 2 + n + 2
    return out


def unchunked(body: Column) -> Column:
    @F.pandas_udf("binary")
    def plain(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else dechunk(bytes(x)))

    return plain(body)
