"""How many characters a batch may hold so that its prompt fits the context of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.dialect import BLANKS

# The least limit, the number of halvings, the texts of a sample, tokens kept free.
LEAST, HALVINGS, SAMPLE, SPARE, MOST_REPLY = 300, 6, 50, 96, 1024


def candidates(configured: int) -> tuple[list[int], int]:
    """Limits to try, and the one that stays when none fits."""
    least = min(configured, LEAST)
    tried, now = [], configured
    for _ in range(HALVINGS):
        tried.append(now)
        following = max(least, now // 2)
        if following >= now:
            break
        now = following
    return tried, now


def reply_tokens(context: int, setting: int | None = None) -> int:
    return setting if setting and setting > 0 else min(MOST_REPLY, max(0, context // 2))


def context_limits(texts: DataFrame, group: str, order: str, text: str, configured: int, context: int, reply: int | None = None, head: str = "", item: str = "''", joint: str = "\n") -> DataFrame:
    """limit, estimated, texts, tokens for each group: the first limit whose sample of leading texts fits twice, with the reply.

    A prompt is ``head`` and the stripped texts, each behind ``item`` (SQL over its number i), joined by ``joint``.  A sample takes texts while
    they fit a limit, but at least one and at most 50: that is the rule, not a saving.  Sums along a group answer every limit at once.
    Blank texts don't count; a group of these keeps the configured limit.  Without a context, or without a positive limit, nothing is estimated.
    """
    groups = texts.select(F.col(group)).distinct()
    if configured <= 0 or context <= 0:
        return groups.select(group, F.lit(configured).cast("long").alias("limit"), F.lit(False).alias("estimated"), F.lit(None).cast("long").alias("texts"), F.lit(None).cast("long").alias("tokens"))
    tried, rest = candidates(configured)
    w = Window.partitionBy(group).orderBy(order)
    rows = texts.select(group, order, F.btrim(F.col(text), F.lit(BLANKS)).alias("own")).where("own <> ''")
    rows = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= SAMPLE)
    rows = rows.withColumn("upto", F.sum(F.char_length("own")).over(w)).withColumn("line", F.concat(F.when(F.col("i") > 1, F.lit(joint)).otherwise(""), F.expr(item), F.col("own")))
    rows = rows.withColumn("plain", F.regexp_count("line", F.lit(r"[\x00-\x7F]"))).withColumn("other", F.char_length("line") - F.col("plain"))
    columns = []
    for k, limit in enumerate(tried):
        taken = (F.col("i") == 1) | (F.col("upto") <= limit)
        columns += [F.sum(F.when(taken, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("plain", "other")] + [F.sum(taken.cast("long")).alias(f"n{k}")]
    sums = rows.groupBy(group).agg(*columns)
    plain = sum(ord(c) < 128 for c in head)
    results = [
        F.struct(F.lit(limit).alias("limit"), F.col(f"n{k}").alias("texts"), (F.col(f"other{k}") + (len(head) - plain) + F.floor((F.col(f"plain{k}") + (plain + 2)) / 3)).alias("tokens"))
        for k, limit in enumerate(tried)
    ]
    fits = F.filter(F.array(*results), lambda r: 2 * r["tokens"] + (2 + reply_tokens(context, reply) + SPARE) <= context)
    best = sums.select(group, F.get(fits, F.lit(0)).alias("r"))
    out = groups.join(best.withColumn("known", F.lit(True)), group, "left")
    limit = F.when(F.col("known").isNull(), F.lit(configured)).otherwise(F.coalesce("r.limit", F.lit(rest))).cast("long")
    return out.select(group, limit.alias("limit"), (F.col("known").isNotNull() & (F.col("r").isNull() | (F.col("r.limit") < configured))).alias("estimated"), F.col("r.texts").alias("texts"), F.col("r.tokens").cast("long").alias("tokens"))
