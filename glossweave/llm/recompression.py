"""Removal of repeated word windows by recompression.

Words are symbols.  Each round first names runs of one symbol, then, with the symbols split in two halves
by a bit of their hash, names neighbours of the first and the second half as pairs.  A name is the
hash of what it stands for and the round, so all texts of all tasks get the same names without a table.
Equal stretches get equal symbols inside; only near their ends may the surroundings decide.  How far
these reach is kept for each symbol as its context: the words that fix that this symbol arises here.

A window of ``width`` words hangs on the highest symbol whose context it holds whole (of several, the
least name, then the leftmost); its words alone decide that.  At the bottom every word is a symbol, so
every window has one.  Windows whose symbol, with its context, no earlier document has are dropped;
the others are verified on all their words.  See ``repeats`` for these steps.

Null counts as no words.  Texts shorter than the width hold no window.  A null id counts as larger than
any other; rows that repeat an id are not earlier than each other.  Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.kernels import U, _powers, byte_rows, mix, sequence_hashes, word_hashes, word_spans
from glossweave.llm.repeats import Kernel, Runs, covered, cut, keyed, repeated, with_starts
from glossweave.llm.scratch import table

ROUNDS = 4
BLOCK = 1 << 15
_NONE = U(2**64 - 1)


State = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _union(clo: np.ndarray, chi: np.ndarray, head: np.ndarray, last: np.ndarray, left: np.ndarray, right: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Context of each new symbol: that of its members and, where asked for, of its neighbours; none at an end."""
    lo, hi = np.minimum.reduceat(clo, head), np.maximum.reduceat(chi, head)
    before_lo, before_hi = np.append(-1, clo)[head], np.append(0, chi)[head]
    after_lo, after_hi = np.append(clo, end)[last + 1], np.append(chi, end + 1)[last + 1]
    lo, hi = np.where(left, np.minimum(lo, before_lo), lo), np.where(left, np.maximum(hi, before_hi), hi)
    return np.where(right, np.minimum(lo, after_lo), lo), np.where(right, np.maximum(hi, after_hi), hi)


def _runs_round(state: State, r: int, end: int) -> State:
    symbol, lo, hi, clo, chi = state
    head = np.concatenate(([0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1))
    last = np.append(head[1:], len(symbol)) - 1
    k = (last - head + 1).astype(np.uint64)
    name = np.where(k > 1, mix(mix(symbol[head] + U(2 * r + 1)) * U(31) + k), symbol[head])
    both = np.ones(len(head), bool)  # its neighbours must differ from it
    return name, lo[head], hi[last], *_union(clo, chi, head, last, both, both, end)


def _pairs_round(state: State, r: int, end: int) -> State:
    symbol, lo, hi, clo, chi = state
    second = (mix(symbol ^ U(0x9E3779B97F4A7C15 * (r + 1) % 2**64)) & U(1)).astype(bool)
    joined = np.append(False, ~second[:-1] & second[1:])  # the second of a pair
    head = np.flatnonzero(~joined)
    last = np.append(head[1:], len(symbol)) - 1
    pair = last > head
    name = np.where(pair, mix(mix(symbol[head] + U(2 * r + 2)) * U(31) + symbol[last]), symbol[head])
    # a pair needs nothing else; a lone first needs what follows it, a lone second what precedes it
    return name, lo[head], hi[last], *_union(clo, chi, head, last, second[head], ~pair & ~second[head], end)


class Symbols(Kernel):
    """The kernel for windows of ``width`` words."""

    block, gap = BLOCK, 1

    def __init__(self, width: int, rounds: int = ROUNDS) -> None:
        self.width, self.rounds = width, rounds

    def units(self, b: np.ndarray) -> np.ndarray:
        return word_hashes(b, False)

    def fill(self, at: int) -> np.ndarray:
        return mix(np.array([at], np.uint64) ^ U(0xA0761D6478BD642F))

    def levels(self, w: np.ndarray) -> Iterator[State]:
        """symbol, lo, hi, context lo, context hi after each round, words first."""
        at = np.arange(len(w))
        state: State = (w, at, at + 1, at, at + 1)
        yield state
        for r in range(self.rounds):
            state = _pairs_round(_runs_round(state, r, len(w)), r, len(w))
            yield state

    def anchors(self, w: np.ndarray, valid: np.ndarray) -> Runs:
        power, inverse = _powers()
        h = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * power[: len(w)], out=h[1:])
        rank, clo, chi = [], [], []
        for level, (symbol, _, _, a, z) in enumerate(self.levels(w)):
            fits = np.flatnonzero((a >= 0) & (z <= len(w)) & (z - a <= self.width))
            rank.append((U(self.rounds - level) << U(60)) | ((mix(symbol[fits] + U(level)) >> U(23)) << U(19)))
            clo.append(a[fits])
            chi.append(z[fits])
        rank, clo, chi = np.concatenate(rank), np.concatenate(clo), np.concatenate(chi)
        rank |= np.arange(len(rank), dtype=np.uint64)
        length = chi - clo
        order = np.argsort(length, kind="stable")
        ends = np.searchsorted(length[order], np.arange(self.width + 2))
        best = np.full(len(w) + 1, _NONE)
        for k in range(1, self.width + 1):  # best[i]: of the symbols with their context in w[i : i + k]
            np.minimum(best[:-1], best[1:], out=best[:-1])
            own = order[ends[k] : ends[k + 1]]
            np.minimum.at(best, clo[own], rank[own])
            best[len(w) - k + 1 :] = _NONE
        a, n, t = cut((best[: len(valid)] & U((1 << 19) - 1)).astype(np.int64), valid)
        name = mix((h[chi[t]] - h[clo[t]]) * inverse[clo[t]] + (rank[t] >> U(19)) * U(0xD6E8FEB86659FD93))
        end = a + n - 1 + self.width
        seg = mix((h[end] - h[a]) * inverse[a] + n.astype(np.uint64) * U(0x9E3779B97F4A7C15) + (clo[t] - a).astype(np.uint64) * U(0xBF58476D1CE4E5B9))
        return a, n, name, seg

    def windows(self, b: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = word_hashes(b, False)
        out = [sequence_hashes(w[s : s + k - 1 + self.width], self.width) for s, k in zip(a, n, strict=True)]
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def kept_words(b: np.ndarray, starts: pa.Scalar | None, width: int) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept words joined by one blank."""
    s, e = word_spans(b)
    gone = covered(len(s), starts, width)
    keep = ~gone
    k = np.flatnonzero(keep)
    if not len(k):
        return len(s), len(s), b""
    mask = np.zeros(len(b) + 1, np.int8)
    mask[s[k]] += 1
    mask[e[k]] -= 1
    inside = np.cumsum(mask).astype(bool)
    inside[e[k]] = True  # the byte after each kept word serves as the blank
    out = np.append(b, np.uint8(32))
    out[e[k]] = 32
    return len(s), int(gone.sum()), out[inside].tobytes()[:-1]


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one blank)."""
    rows = keyed(docs, id_col, text_col)
    starts = repeated(rows, Symbols(width), earlier_only=True)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kept_words(b, batch.column(2)[i], width) for i, b in enumerate(byte_rows(batch.column(1)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return with_starts(rows, starts).mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept binary")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM h) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM r),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS kept, count(gone.i) AS n_removed
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
