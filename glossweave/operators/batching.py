"""Packing, de-duplication and budgets over ordered rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked(text: Column, ends: str, limit: int) -> Column:
    """A text in chunks of whole sentences of at most ``limit`` characters, stripped; longer sentences are cut.

    A sentence ends at one of ``ends``.  One pass over each text, in Arrow batches.
    """
    pattern = re.compile(f"[^{ends}]*[{ends}]|[^{ends}]+")

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            out, held = [], ""
            for sentence in pattern.findall(t or ""):
                for at in range(0, len(sentence), limit):
                    piece = sentence[at : at + limit]
                    if held and len(held) + len(piece) > limit:
                        out.append(held)
                        held = ""
                    held += piece
            return [x for x in (c.strip() for c in [*out, held]) if x]

        return texts.map(one)

    return chunks(text)


def first_seen(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Rows with ``first`` (the order of the text's first use in its group) and ``slot`` (its number among the distinct ones)."""
    first = F.min(order).over(Window.partitionBy(group, "digest"))
    return rows.withColumn("digest", F.sha2(text, 256)).withColumn("first", first).withColumn("slot", F.dense_rank().over(Window.partitionBy(group).orderBy("first")).cast("long"))


def within_budget(rows: DataFrame, group: str, order: str, text: str, most_chars: int, most_rows: int) -> DataFrame:
    """The leading non-blank rows of each group up to the first that overflows a budget; a joint costs one character."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.where(F.trim(text) != "").withColumn("used", F.sum(F.char_length(text) + 1).over(w) - 1).withColumn("place", F.count(F.lit(1)).over(w))
    return kept.where((F.col("used") <= most_chars) & (F.col("place") <= most_rows))


def islands(rows: DataFrame, group: str, position: str) -> DataFrame:
    """Runs of consecutive integers in each group: first, last, n."""
    island = F.col(position) - F.row_number().over(Window.partitionBy(group).orderBy(position))
    return (
        rows.select(group, position).distinct().withColumn("island", island).groupBy(group, "island")
        .agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")).drop("island")
    )


def zip_lines(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Positional full outer join; the shorter side is filled with empty texts."""
    return left.join(right, keys, "full_outer").na.fill("", ["original", "translated"])


BUCKETS = 4096


def exact_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, least, most, mean, p50 and p95 by the exclusive method (the largest value below 20 samples).

    Values fall into equal steps between a group's least and largest one; only the steps that hold a wanted rank are
    sorted, so no task holds a group, however many rows or distinct values it has.
    """
    known = rows.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"))
    ends = known.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"))
    step = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - F.col("least")) / (F.col("most") - F.col("least")) * BUCKETS))
    placed = known.join(ends, group).select(group, "v", F.when(F.col("most") > F.col("least"), step).otherwise(0).alias("step"))
    counts = placed.groupBy(group, "step", "v").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(group).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.groupBy(group, "step").agg(F.sum("c").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    n = F.col("n")
    j = F.greatest(F.lit(1), F.least(F.floor(19 * (n + 1) / 20), n - 1))
    wanted = ends.select(group, F.explode(F.array_distinct(F.array(j, F.least(j + 1, n), F.floor((n + 1) / 2), F.floor(n / 2) + 1))).alias("rank"))
    held = steps.join(wanted, group).where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("c"))).select(group, "step", "before", "rank")
    inside = Window.partitionBy(group, "step").orderBy("v")
    ranked = counts.join(held.select(group, "step", "before").distinct(), [group, "step"]).withColumn("upto", F.col("before") + F.sum("c").over(inside))
    found = ranked.drop("before").join(held.drop("before"), [group, "step"]).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
    values = found.groupBy(group).agg(F.map_from_entries(F.collect_set(F.struct("rank", "v"))).alias("at"))
    delta = 19 * (n + 1) - 20 * j

    def value_at(rank: Column) -> Column:
        return F.get(F.map_values(F.map_filter("at", lambda k, _: k == rank)), F.lit(0))

    p95 = F.when(n >= 20, (value_at(j) * (20 - delta) + value_at(j + 1) * delta) / 20).otherwise(F.col("most"))
    p50 = (value_at(F.floor((n + 1) / 2)) + value_at(F.floor(n / 2) + 1)) / 2
    return ends.join(values, group).select(group, "n", "least", "most", F.round("mean", 6).alias("mean"), F.round(p50, 6).alias("p50"), F.round(p95, 6).alias("p95"))
