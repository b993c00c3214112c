"""Finding every repeated window of fixed width in a corpus, without pairs and without one row a window.

A *kernel* cuts the windows of a text into runs: windows that hang on the same anchor, a place chosen by
the content of the window alone.  Equal windows therefore hang on equal anchors at equal distance.  A run
has a ``name``, the hash of content common to all its windows, and ``seg``, the hash of all it covers.

1. Count names.  A run with a name that occurs once holds no repeated window; that is most of a corpus.
2. Where all runs of a name are alike (one ``seg``), the runs are copies, and are settled as they stand.
3. Else one run stands for each class of equal runs, and only its windows are hashed one by one;
   equal windows of different classes meet by their hash.  What is found for it holds for each equal run.
4. What was found goes back to the texts as intervals of window starts.

Counts and minima are partial aggregates, and joins on names have a shuffle on both sides, so that
Spark can split a name that a third of all rows share.  Hashes are 64 bits each, two of them for every
decision (name with seg, name with window).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.kernels import byte_rows
from glossweave.llm.scratch import discard, materialise

Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Kernel:
    """Cuts the windows of texts into runs.  Texts are handled many at a time, and long ones in pieces.

    Pieces of a text overlap by a window less one unit, and ``gap`` units part the pieces in a block, so
    every window lies in one piece and no window holds a gap.
    """

    width: int
    block: int
    gap = 0

    def units(self, b: np.ndarray) -> np.ndarray:
        """The units of a text: its bytes, or a hash for each word."""
        raise NotImplementedError

    def fill(self, at: int) -> np.ndarray:
        """A gap that agrees with nothing else."""
        raise NotImplementedError

    def anchors(self, x: np.ndarray, valid: np.ndarray) -> Runs:
        """First start, number of windows, name and seg of each run of valid windows in one block."""
        raise NotImplementedError

    def windows(self, b: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start in the given runs."""
        raise NotImplementedError

    def many(self, texts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """(text number, a, n, name, seg) arrays for blocks of texts."""
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for i, b in enumerate(texts):
            u = self.units(b)
            for lo in range(0, len(u) - self.width + 1, self.block):
                piece = u[lo : lo + self.block + self.width - 1]
                held.append((i, lo, piece))
                size += len(piece) + self.gap
                if size >= self.block:
                    yield self._solve(held)
                    held, size = [], 0
        if held:
            yield self._solve(held)

    def _solve(self, held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, ...]:
        parts, starts, at = [], [], 0
        for _, _, piece in held:
            starts.append(at)
            parts.append(piece)
            at += len(piece)
            if self.gap:
                parts.append(self.fill(at))
                at += self.gap
        x = np.concatenate(parts)
        valid = np.zeros(len(x) - self.width + 1, bool)
        for s, (_, _, piece) in zip(starts, held, strict=True):
            valid[s : s + len(piece) - self.width + 1] = True
        a, n, name, seg = self.anchors(x, valid)
        k = np.searchsorted(starts, a, "right") - 1
        text, lo = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        return text[k], a - np.array(starts)[k] + lo[k], n, name, seg


def cut(t: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and anchor of the runs of valid windows with one anchor."""
    t = np.where(valid, t, -1)
    a = np.concatenate(([0], np.flatnonzero(np.diff(t)) + 1))
    n = np.diff(np.concatenate((a, [len(t)])))
    keep = t[a] >= 0
    return a[keep], n[keep], t[a][keep]
_LAST = (1 << 63) - 1


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d (the id, null last), h (hash of the text; tells rows apart that repeat an id), doc_id, text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(text).alias("h"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text")
    )


def _runs(docs: DataFrame, kernel: Kernel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, a, n, name, seg in kernel.many(byte_rows(batch.column(2))):
                yield pa.record_batch(
                    {"d": d[i], "h": h[i], "a": a.astype(np.int32), "n": n.astype(np.int32), "name": name.view(np.int64), "seg": seg.view(np.int64)}
                )

    return docs.select("d", "h", "text").mapInArrow(run, "d long, h long, a int, n int, name long, seg long")


def _windows(docs: DataFrame, reps: DataFrame, kernel: Kernel) -> DataFrame:
    """d, h, run (its first start), at, name, w, copies, least: the windows of the runs in ``reps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, b in enumerate(byte_rows(batch.column(2))):
                held = batch.column(3)[i].values
                a, n, name, copies, least = (held.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                each = np.repeat(np.arange(len(a)), n)
                k = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                at = a[each] + k
                yield pa.record_batch(
                    {
                        "d": np.full(len(at), d[i]),
                        "h": np.full(len(at), h[i]),
                        "run": a[each].astype(np.int32),
                        "at": at.astype(np.int32),
                        "name": name[each],
                        "w": kernel.windows(b, a, n).view(np.int64),
                        "copies": copies[each],
                        "least": least[each],
                    }
                )

    held = reps.groupBy("d", "h").agg(F.collect_list(F.struct("a", "n", "name", "copies", "least")).alias("runs"))
    return docs.join(held, ["d", "h"]).dropDuplicates(["d", "h"]).select("d", "h", "text", "runs").mapInArrow(
        run, "d long, h long, run int, at int, name long, w long, copies long, least long"
    )


def repeated(docs: DataFrame, kernel: Kernel, earlier_only: bool) -> DataFrame:
    """d, h, starts (array of a, n): window starts to remove.

    ``earlier_only``: a window goes if it also starts in a document with a smaller id; else, if it
    also starts anywhere else.  ``docs`` is as ``keyed`` gives it.
    """
    runs = materialise(_runs(docs, kernel), "runs")
    names = runs.groupBy("name").agg(
        F.count(F.lit(1)).alias("total"), F.min("seg").alias("s0"), F.max("seg").alias("s1"), F.min("d").alias("d0"), F.max("d").alias("d1")
    )
    names = names.where("total > 1 and d0 < d1" if earlier_only else "total > 1")
    names = materialise(names.select("name", (F.col("s0") == F.col("s1")).alias("alike"), "d0"), "names")
    shared = materialise(runs.join(names, "name"), "shared-runs")
    discard(runs, names)
    settled = shared.where("alike and d > d0" if earlier_only else "alike").select("d", "h", "a", "n")
    mixed = shared.where("not alike")
    classes = mixed.groupBy("name", "seg").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("d", "h", "a", "n")).alias("rep"), F.min("d").alias("least")
    )
    classes = materialise(classes, "classes")
    same = mixed.join(classes.select("name", "seg", "copies", "least", F.col("rep.h").alias("rep_h"), F.col("rep.a").alias("rep_a")), ["name", "seg"])
    many = same.where("d > least" if earlier_only else "copies > 1").select("d", "h", "a", "n")
    reps = classes.select("rep.d", "rep.h", "rep.a", "rep.n", "name", "copies", "least")
    single = materialise(_windows(docs, reps, kernel), "windows")
    met = single.groupBy("name", "w").agg(F.sum("copies").alias("all"), F.min("least").alias("first"), F.max("least").alias("last"))
    met = materialise(met.where("first < last" if earlier_only else "all > 1").select("name", "w", "first"), "met")
    found = single.join(met, ["name", "w"]).where("least > first" if earlier_only else "copies = 1").select("d", "h", "run", "at")
    found = materialise(found, "found")
    discard(single, met)
    out = settled.unionByName(many).unionByName(found.select("d", "h", F.col("at").alias("a"), F.lit(1).alias("n")))
    if earlier_only:  # runs equal to the representative in rows of its own id lose the same windows
        twins = same.where("d = least and (h <> rep_h or a <> rep_a)").select("d", F.col("rep_h").alias("h"), F.col("rep_a").alias("run"), F.col("h").alias("own_h"), "a")
        moved = found.join(materialise(twins.distinct(), "twins"), ["d", "h", "run"])
        out = out.unionByName(moved.select("d", F.col("own_h").alias("h"), (F.col("a") + F.col("at") - F.col("run")).alias("a"), F.lit(1).alias("n")))
    return out.groupBy("d", "h").agg(F.collect_list(F.struct("a", "n")).alias("starts"))


def covered(length: int, starts: pa.Scalar | None, width: int) -> np.ndarray:
    """Boolean mask of the units that the windows beginning in ``starts`` cover."""
    edge = np.zeros(length + 1, np.int64)
    if starts is not None and starts.is_valid:
        a, n = (starts.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        np.add.at(edge, a, 1)
        np.add.at(edge, np.minimum(a + n - 1 + width, length), -1)
    return np.cumsum(edge[:-1]) > 0


def with_starts(docs: DataFrame, starts: DataFrame) -> DataFrame:
    return docs.join(starts, ["d", "h"], "left").select("doc_id", "text", "starts")
