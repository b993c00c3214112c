"""Messages as blocks of subject and body, and translated messages from blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.dialect import BLANKS
from glossweave.operators.batching import chunked

# The ends of sentences in messages, the characters of a block, the names of blocks.
ENDS, MOST = "。！？!?\n", 3000
SUBJECT, BODY, CHUNK = "msg_subject", "msg_body_", "_chunk_"


def _stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def paragraphs(messages: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """``keys``, place (from 0, blank paragraphs counted), nth (from 1, without blank ones), text, pieces (its chunks, null for a short one)."""
    parts = F.when(F.col(body) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(body), "\n\n"))
    parts = F.transform(parts, _stripped)
    nth = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.size(F.filter(F.slice("parts", 1, i), lambda p: p != "")))
    rows = messages.select(*keys, parts.alias("parts")).where(F.size("parts") > 0)
    rows = rows.select(*keys, F.posexplode(F.arrays_zip(F.col("parts").alias("text"), nth.alias("nth"))).alias("place", "p"))
    long = F.char_length("text") > MOST
    rows = rows.select(*keys, F.col("place").cast("long").alias("place"), F.col("p.nth").cast("long").alias("nth"), F.col("p.text").alias("text"))
    return rows.withColumn("pieces", F.when(long, chunked(F.when(long, F.col("text")), ENDS, MOST)))


def blocks(messages: DataFrame, keys: list[str], subject: str = "subject", body: str = "body", wanted: Column | None = None) -> DataFrame:
    """``keys``, id, section, text, location of what is to be translated.

    The subject is section 0, paragraph i (blank ones keep their number) section i + 1; longer paragraphs come in chunks.
    ``wanted`` is a condition on the column text.  Null and empty subjects and bodies give no block.
    """
    head = messages.where(F.col(subject) != "").select(
        *keys, F.lit(SUBJECT).alias("id"), F.lit(0).cast("long").alias("section"), F.col(subject).alias("text"), F.lit("件名").alias("location")
    )
    rest = paragraphs(messages, keys, body).where("text <> ''")
    rest = rest.select(*keys, "place", "nth", F.col("pieces").isNotNull().alias("cut"), F.posexplode(F.coalesce("pieces", F.array("text"))).alias("k", "text"))
    name = F.concat(F.lit(BODY), F.col("place"))
    label = F.concat(F.lit("本文段落"), F.col("nth"))
    rest = rest.select(
        *keys,
        F.when(F.col("cut"), F.concat(name, F.lit(CHUNK), F.col("k"))).otherwise(name).alias("id"),
        (F.col("place") + 1).alias("section"),
        "text",
        F.when(F.col("cut"), F.concat(label, F.lit(" (分割"), F.col("k") + 1, F.lit(")"))).otherwise(label).alias("location"),
    )
    both = head.unionByName(rest)
    return both if wanted is None else both.where(wanted)


def rebuilt(messages: DataFrame, translations: DataFrame, keys: list[str], subject: str = "subject", body: str = "body") -> DataFrame:
    """``keys``, subject, body with ``translations`` (keys, id, text) in place; blank paragraphs stay, what has none keeps its own text.

    A message is put together in one row, as its body was.
    """
    said = translations.select(*keys, "id", F.col("text").alias("said"))
    parts = paragraphs(messages, keys, body)
    parts = parts.select(*keys, "place", "pieces", F.posexplode(F.coalesce("pieces", F.array("text"))).alias("k", "own"))
    name = F.concat(F.lit(BODY), F.col("place"))
    parts = parts.withColumn("id", F.when(F.col("pieces").isNotNull(), F.concat(name, F.lit(CHUNK), F.col("k"))).otherwise(name)).drop("pieces")
    parts = parts.join(said, [*keys, "id"], "left").withColumn("text", F.when(F.col("own") == "", "").otherwise(F.coalesce("said", "own")))
    whole = parts.groupBy(*keys, "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text"))
    bodies = whole.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("__body"))
    heads = said.where(F.col("id") == SUBJECT).select(*keys, F.col("said").alias("__subject"))
    return messages.join(heads, keys, "left").join(bodies, keys, "left").select(
        *keys, F.coalesce("__subject", F.col(subject), F.lit("")).alias("subject"), F.coalesce("__body", F.lit("")).alias("body")
    )
