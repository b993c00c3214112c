"""The batch dataflow: pack, drop repeats, call a client, reconcile counts, halve what failed, expand, look up what is cached.

A client is a column expression from an array of texts to an array of texts (a pandas UDF over arrays in
real use).  It may return null (the batch failed) or another number of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_LIMIT, MAX_DEPTH = 300, 2
Client = Callable[[Column], Column]


def _batch_numbers(sizes: list[int], limit: int) -> list[int]:
    """The batch of each size in order; one above the limit stands alone."""
    out, batch, held, is_open = [], 0, 0, False
    for n in sizes:
        if n > limit:
            batch, held, is_open = batch + 1, 0, False
        elif is_open and held + n <= limit:
            held += n
        else:
            batch, held, is_open = batch + 1, n, True
        out.append(batch)
    return out


def packed(rows: DataFrame, group: str, order: str, size: Column, limit: int) -> DataFrame:
    """``rows`` with their batch in the group, in one linear pass over each group's sizes."""

    @F.pandas_udf("array<long>")
    def numbers(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: _batch_numbers(list(s), limit))

    items = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), size.cast("long").alias("n")))).alias("x"))
    placed = items.select(group, F.explode(F.arrays_zip(F.col("x.k").alias("k"), numbers(F.col("x.n")).alias("b"))).alias("z"))
    return rows.join(placed.select(group, F.col("z.k").alias(order), F.col("z.b").alias("batch")), [group, order])


def called(rows: DataFrame, group: str, order: str, text: str, client: Client) -> DataFrame:
    """``rows`` (with batch) plus ``out``: each batch's distinct texts in order of first use, through the client, and back.

    A short answer is filled with empty texts, a long one cut; a failed batch gives null.
    """
    firsts = rows.groupBy(group, "batch", text).agg(F.min(order).alias("first"))
    batches = firsts.groupBy(group, "batch").agg(F.array_sort(F.collect_list(F.struct("first", F.col(text).alias("t")))).alias("x"))
    batches = batches.select(group, "batch", F.col("x.t").alias("texts"), client(F.col("x.t")).alias("got"))
    aligned = F.transform("texts", lambda t, i: F.struct(t.alias(text), F.when(F.col("got").isNull(), None).otherwise(F.coalesce(F.get("got", i), F.lit(""))).alias("out")))
    answers = batches.select(group, "batch", (F.size("got") != F.size("texts")).alias("mismatch"), F.explode(aligned).alias("z")).select(group, "batch", "mismatch", "z.*")
    return rows.join(answers, [group, "batch", text])


def translated(rows: DataFrame, group: str, order: str, text: str, client: Client, limit: int) -> DataFrame:
    """``rows`` plus ``out`` and ``depth``: failed batches are packed anew at half the limit, at most twice; null where all failed."""
    done: list[DataFrame] = []
    left = rows
    for depth in range(MAX_DEPTH + 1):
        got = called(packed(left, group, order, F.char_length(text), limit), group, order, text, client).withColumn("depth", F.lit(depth))
        last = depth == MAX_DEPTH
        done.append((got if last else got.where("out IS NOT NULL")).select(*rows.columns, "out", "depth", "mismatch"))
        left, limit = got.where("out IS NULL").select(*rows.columns), max(LEAST_LIMIT, limit // 2)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def once_each(rows: DataFrame, key: Column, text: str, one: Callable[[Column], Column]) -> DataFrame:
    """``rows`` plus ``out``: one call for each distinct cache key, joined back by its digest."""
    keyed = rows.withColumn("key", F.sha2(key, 256))
    answers = keyed.groupBy("key").agg(F.min(text).alias("t")).select("key", one(F.col("t")).alias("out"))
    return keyed.join(answers, "key").drop("key")


def lru_hits(rows: DataFrame, group: str, order: str, key: str, capacity: int) -> DataFrame:
    """group, order, hit of each access in order to a cache that drops what was used longest ago.

    Groups stream through their task in order; only ``capacity`` keys are held.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(group, order).schema.fields) + ", hit boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held = None, {}
        for df in frames:
            hits = []
            for g, k in zip(df[group], df[key], strict=True):
                if g != here:
                    here, held = g, {}
                hits.append(k in held)
                held.pop(k, None)
                if capacity > 0:
                    if len(held) >= capacity:
                        del held[next(iter(held))]
                    held[k] = True
            yield df[[group, order]].assign(hit=hits)

    return rows.select(group, order, key).repartition(group).sortWithinPartitions(group, order).mapInPandas(run, schema)
