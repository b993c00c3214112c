"""A counting Bloom filter that saturates at two, built by the executors.

Each key sets ``PROBES`` cells.  A cell that two keys (or one key twice) touched is "shared"; a key
all of whose cells are shared is possibly repeated, any other key is certainly unique.  Tasks send
their cells as sparse lists grouped by segment, each cell at most twice a batch, so a key that a third of
all rows share adds a few entries and no more; merging needs one segment at a time.  Keys are dealt into
ranges of their hash, each with a filter of its own of at most ``MAX_LOG2_CELLS`` (64 MiB), so that the share of keys
that pass for nothing stays the same at any size.  The price: rows and keys are read once for each range, that is for every
45 million keys, and the filters of all ranges stay broadcast until the result is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBES = 3
CELLS_PER_KEY = 12
MIN_LOG2_CELLS = 18
MAX_LOG2_CELLS = 29
SEGMENT_LOG2 = 15


def ranges(n_keys: int) -> int:
    """How many filters of the largest size the keys need."""
    return max(1, math.ceil(n_keys * CELLS_PER_KEY / (1 << MAX_LOG2_CELLS)))


def log2_cells(n_keys: int) -> int:
    wanted = math.ceil(math.log2(max(1, n_keys) * CELLS_PER_KEY))
    return min(MAX_LOG2_CELLS, max(MIN_LOG2_CELLS, wanted))


def range_of(column: str, n: int) -> Column:
    """The range of a key, from other bits than those that name its cells."""
    return F.pmod(F.xxhash64(column), F.lit(n))


def cells(keys: np.ndarray, log2: int) -> np.ndarray:
    """(PROBES, n) cell numbers by double hashing of the 64-bit keys."""
    k = keys.view(np.uint64)
    a = (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - log2)
    b = ((k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - log2)
    step = b | np.uint64(1)
    mask = np.uint64((1 << log2) - 1)
    return np.stack([(a + np.uint64(i) * step) & mask for i in range(PROBES)])


def shared_cells(keys: DataFrame, column: str, log2: int) -> np.ndarray:
    """Bitmap (uint8, packed) of the cells that at least two entries of ``column`` (long) touch."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(h):
                continue
            cell, times = np.unique(cells(h, log2).ravel().astype(np.int64), return_counts=True)
            cell = np.repeat(cell, np.minimum(times, 2))
            segment = cell >> SEGMENT_LOG2
            cut = np.flatnonzero(np.diff(segment, prepend=-1))
            low = (cell & ((1 << SEGMENT_LOG2) - 1)).astype(np.uint16)
            yield pa.record_batch(
                {
                    "segment": pa.array(segment[cut], pa.int32()),
                    "cells": pa.array([x.tobytes() for x in np.split(low, cut[1:])], pa.binary()),
                }
            )

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(1 << SEGMENT_LOG2, np.int64)
        for c in rows["cells"]:
            count += np.bincount(np.frombuffer(c, np.uint16), minlength=1 << SEGMENT_LOG2)
        bits = np.packbits(count >= 2, bitorder="little").tobytes()
        return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "bits": [bits]})

    found = (
        keys.select(F.col(column).cast("long"))
        .where(F.col(column).isNotNull())
        .mapInArrow(spread, "segment int, cells binary")
        .groupBy("segment")
        .applyInPandas(merge, "segment int, bits binary")
    )
    bitmap = np.zeros(max(1 << log2, 1 << SEGMENT_LOG2) // 8, np.uint8)
    width = (1 << SEGMENT_LOG2) // 8
    for row in found.collect():  # at most 64 MiB
        bitmap[row.segment * width : (row.segment + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return bitmap


def with_flag(rows: DataFrame, column: str, bitmap: np.ndarray, log2: int, flag: str) -> DataFrame:
    """``rows`` plus the boolean ``flag``: false where ``column`` is certainly unique."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap)
    at = rows.columns.index(column)
    schema = T.StructType([*rows.schema.fields, T.StructField(flag, T.BooleanType(), False)])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            c = cells(batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64), log2)
            hit = np.ones(batch.num_rows, bool)
            for row in c:
                hit &= (bits[(row >> np.uint64(3)).astype(np.int64)] >> (row & np.uint64(7)).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, flag])

    return rows.mapInArrow(look, schema)


def flagged(rows: DataFrame, keys: DataFrame, column: str, flag: str) -> DataFrame:
    """``rows`` plus ``flag`` (whether ``column`` is possibly repeated among ``keys``), range by range of the hash."""
    n = keys.count()
    parts = ranges(n)
    log2 = log2_cells(-(-n // parts))
    out = None
    for r in range(parts):
        own, some = (rows, keys) if parts == 1 else (x.where(range_of(column, parts) == r) for x in (rows, keys))
        part = with_flag(own, column, shared_cells(some, column, log2), log2, flag)
        out = part if out is None else out.unionByName(part)
    return out
