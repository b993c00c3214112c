"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over ``GRAM`` bytes triggers a phrase boundary where it is smallest among the next
``REACH`` places, so every window of ``width`` bytes holds a boundary found from its own bytes alone.  The
phrases that end at a boundary, with what follows it, form the dictionary; the bytes from a boundary on
stand for the parse from there.  In corpus order, the suffixes that share a phrase's end and then a
parse prefix lie side by side, and a 400-byte string repeats where such neighbours agree for 400 bytes.

Only that agreement is needed here, not the order of the rest.  So instead of sorting all suffixes,
parse prefixes are named by hash (``name``: the bytes from the boundary that every window on it
holds), and a name that occurs once drops out.  Under a name that recurs, phrases with their
parse prefix are dictionary entries (``seg``), and the suffixes that begin inside differing
entries are matched over their 400 bytes.  See ``repeats`` for the steps.

Null counts as empty.  Texts shorter than the width hold no window.  Matches never cross documents;
overlapping matches in one document count.  Rows that repeat an id or a whole row are documents of their
own, so the latter lose everything they share.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.kernels import PLAIN, U, _powers, byte_rows, mix
from glossweave.llm.repeats import Kernel, Runs, covered, cut, keyed, repeated, with_starts
from glossweave.llm.scratch import table

GRAM = 16
BLOCK = 1 << 16
_PLACE = U((1 << 18) - 1)  # a block and the piece that filled it are shorter


class Phrases(Kernel):
    """The kernel for windows of ``width`` bytes."""

    block = BLOCK

    def __init__(self, width: int) -> None:
        self.width = width
        self.gram = max(1, min(GRAM, width // 4))
        self.reach = max(1, min(width // 2, width - self.gram + 1))

    def units(self, b: np.ndarray) -> np.ndarray:
        return b

    def _prefix(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = _powers()
        h = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(PLAIN[x] * power[: len(x)], out=h[1:])
        return h, inverse

    def anchors(self, x: np.ndarray, valid: np.ndarray) -> Runs:
        h, inverse = self._prefix(x)
        g = len(x) - self.gram + 1
        low = mix((h[self.gram :] - h[:g]) * inverse[:g])
        low = (low & ~_PLACE) | np.arange(g, dtype=np.uint64)
        span = 1
        while 2 * span <= self.reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < self.reach:
            low = np.minimum(low[: len(low) - (self.reach - span)], low[self.reach - span :])
        a, n, t = cut((low[: len(valid)] & _PLACE).astype(np.int64), valid)
        common = self.width - self.reach + 1
        name = mix((h[t + common] - h[t]) * inverse[t])
        end = a + n - 1 + self.width
        seg = mix((h[end] - h[a]) * inverse[a] + n.astype(np.uint64) * U(0x9E3779B97F4A7C15) + (t - a).astype(np.uint64) * U(0xD6E8FEB86659FD93))
        return a, n, name, seg

    def windows(self, b: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = []
        for s, k in zip(a, n, strict=True):
            h, inverse = self._prefix(b[s : s + k - 1 + self.width])
            out.append((h[self.width :] - h[:k]) * inverse[:k])
        return mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def remove_repeats(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans (removed start and end)."""
    rows = keyed(docs, id_col, text_col)
    starts = repeated(rows, Phrases(width), earlier_only=False)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for i, b in enumerate(byte_rows(batch.column(1))):
                gone = covered(len(b), batch.column(2)[i], width)
                edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)]
                for c, v in zip(cols, (len(b), int(gone.sum()), len(s), b[~gone].tobytes() if len(s) else b.tobytes(), spans), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), span_type]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
            )

    return with_starts(rows, starts).mapInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>"
    )


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
k AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS m
  FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS i FROM x WHERE n >= 400)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM k) WHERE c > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 400 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS s, max(i) + 400 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM g) GROUP BY doc_id, island),
b AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM s),
p AS (
  SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) + 1) AS kept
  FROM b JOIN x USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM x LEFT JOIN p USING (doc_id)
"""
