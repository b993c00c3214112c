"""Reading order of the boxes of a page from its graph of successors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(boxes: list[tuple[int, float]], edges: list[tuple[int, int]]) -> list[int]:
    """Boxes (id, rank) so that successors follow; of those free to come next the least rank, and those in cycles last, by rank."""
    rank, waits = dict(boxes), dict.fromkeys((b for b, _ in boxes), 0)
    after: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        waits[b] += 1
    free = [(rank[b], b) for b, n in waits.items() if n == 0]
    heapq.heapify(free)
    out = []
    while free:
        b = heapq.heappop(free)[1]
        out.append(b)
        for c in after.get(b, []):
            waits[c] -= 1
            if waits[c] == 0:
                heapq.heappush(free, (rank[c], c))
    done = set(out)
    return out + [b for _, b in sorted((r, b) for b, r in rank.items() if b not in done)]


def ordered(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """page, box, place (from 0).  ``edges``: page, box, next.  A page becomes one row, so that a batch holds many; it holds what one sheet holds."""
    ranked = boxes.select("page", "box", (F.col("x0") + F.col("y0")).alias("rank"), F.lit(None).cast("long").alias("next"))
    rows = ranked.unionByName(edges.select("page", "box", F.lit(None).cast("double").alias("rank"), "next"))
    own = F.array_sort(F.collect_list(F.when(F.col("next").isNull(), F.struct("box", "rank"))))
    links = F.collect_list(F.when(F.col("next").isNotNull(), F.struct("box", "next")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, at, order, place = batch.column(0), [], [], []
            (own_ends, own), (link_ends, links) = map(_pairs, batch.columns[1:])
            for i in range(len(pages)):
                page = in_order(own[own_ends[i] : own_ends[i + 1]], links[link_ends[i] : link_ends[i + 1]])
                at += [i] * len(page)
                order += page
                place += range(len(page))
            yield pa.RecordBatch.from_arrays([pages.take(pa.array(at, pa.int64())), pa.array(order, pa.int64()), pa.array(place, pa.int64())], names=["page", "box", "place"])

    pages = rows.groupBy(F.col("page").cast("long").alias("page")).agg(own.alias("own"), links.alias("links"))
    return pages.mapInArrow(run, "page long, box long, place long")


def _pairs(lists: pa.ListArray) -> tuple[list[int], list[tuple]]:
    """Where the lists end, from 0, and the pairs of all of them."""
    first = lists.offsets[0].as_py() if len(lists) else 0
    a, b = lists.flatten().flatten()
    return [x - first for x in lists.offsets.to_pylist()], list(zip(a.to_pylist(), b.to_pylist(), strict=True))
