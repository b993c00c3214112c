"""Matching of glossary terms: whole words, phrases and texts without separators, best ones first.

A short term of ASCII letters and digits must stand as a word; any other may stand anywhere.  A term of
four characters or more without its separators may also stand in the text without separators, which includes
every longer term.  Each text is read once, through a sieve of fixed size that all terms set (``functions.sieve``).  What it lets pass,
each string once a text, meets the terms in an equi-join on the string itself, which drops what no term is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossweave.functions import sieve


def folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s_/\\-]+", "")


def loaded(lines: DataFrame, line: str = "line") -> DataFrame:
    """idx, source, target of comma-separated lines; empty ones and those with a ``#`` first are skipped."""
    row = F.from_csv(F.col(line), "source string, target string")
    parsed = lines.select("idx", F.trim(row["source"]).alias("source"), F.coalesce(F.trim(row["target"]), F.lit("")).alias("target"))
    return parsed.where((F.coalesce("source", F.lit("")) != "") & ~F.startswith("source", F.lit("#")))


def _sieve(forms: DataFrame) -> tuple[dict[int, list[int]], np.ndarray]:
    """Lengths in bytes by kind, and the sieve (2 MiB), of ``forms``: kind, key."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, keys = batch.column(0).to_numpy(), batch.column(1)
            slots, sizes = (pa.array(np.unique(np.concatenate(x)), pa.int64()) for x in ([np.zeros(0, np.int64), *sieve.slots(keys, kinds)], [pc.binary_length(keys).to_numpy() * 4 + kinds]))
            none = [pa.nulls(len(x), pa.int64()) for x in (slots, sizes)]
            yield pa.record_batch({"slot": pa.concat_arrays([slots, none[1]]), "size": pa.concat_arrays([none[0], sizes])})

    # The set bits of slots in words of 64, so that their count is bounded by the size of the sieve, and the lengths.
    rows = forms.select("kind", "key").mapInArrow(spread, "slot long, size long").groupBy(F.shiftright("slot", 6).alias("word"), "size")
    held = rows.agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("bits")).toArrow()
    lengths: dict[int, list[int]] = {}
    for x in held["size"].drop_null().to_pylist():
        lengths.setdefault(x % 4, []).append(x // 4)
    words = held.filter(held["word"].is_valid())
    bits = np.zeros(1 << (sieve.LOG2_SLOTS - 6), np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return lengths, bits.view(np.uint8)


def _strings(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """doc_id, key: the strings of ``texts`` (doc_id, t) that ``forms`` (kind, key) may hold, all that it holds among them."""
    told = texts.sparkSession.sparkContext.broadcast(_sieve(forms))
    schema = T.StructType([texts.schema["doc_id"], T.StructField("key", T.BinaryType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, keys in sieve.found(batch.column(1), *told.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), keys], names=["doc_id", "key"])

    return texts.select("doc_id", "t").mapInArrow(look, schema)


def matched(docs: DataFrame, glossary: DataFrame, k: int) -> DataFrame:
    """doc_id, n, truncated, terms: the ``k`` best of the terms whose source or target stands in the text.

    Best: numeric units, then the longest of source and target, then the first.  ``glossary``: idx, source, target; it is read at once.
    """
    first = Window.partitionBy("source").orderBy("idx")
    both = F.concat_ws(" ", folded(F.col("source")), folded(F.col("target")))
    unit = F.regexp_like(both, F.lit("[億兆]|oku|k yen")) | (F.contains(both, F.lit("円")) & F.regexp_like(both, F.lit("[千万]")))
    size = F.greatest(F.char_length("source"), F.char_length("target"))
    terms = glossary.withColumn("r", F.row_number().over(first)).where("r = 1 AND idx IS NOT NULL")
    terms = terms.select("idx", F.row_number().over(Window.partitionBy("idx").orderBy("source")).alias("part"), "source", "target", unit.cast("int").alias("unit"), size.alias("size"))
    forms = terms.select("idx", F.explode(F.array("source", "target")).alias("form")).withColumn("form", F.trim(folded(F.col("form")))).where("form <> ''")
    forms = forms.withColumn("c", compact(F.col("form")))
    bare = F.char_length("c") >= sieve.LEAST
    kind = F.when(bare, sieve.BARE).when(F.regexp_like("form", F.lit("^[a-z0-9]+$")), sieve.WORD).otherwise(sieve.PART)
    # A key tells its kind: with separators or of fewer characters it is no bare one, and of ASCII letters and digits only it is a word.
    forms = forms.select("idx", kind.alias("kind"), F.when(bare, F.col("c")).otherwise(F.col("form")).cast("binary").alias("key"))
    texts = docs.select("doc_id", folded(F.col("text")).alias("t"))
    hits = _strings(texts, forms).join(forms, "key").select("doc_id", "idx").join(terms.select("idx", "part", "unit", "size"), "idx").repartition("doc_id")
    ranks = Window.partitionBy("doc_id").orderBy(F.desc("unit"), F.desc("size"), "idx", "part")
    placed = hits.withColumn("place", F.dense_rank().over(ranks))  # a term found by both its forms takes one place
    best = placed.withColumn("n", F.max("place").over(Window.partitionBy("doc_id"))).where(F.col("place") <= k)
    return best.join(terms.select("idx", "part", "source"), ["idx", "part"]).groupBy("doc_id").agg(
        F.max("n").cast("long").alias("n"),
        (F.max("n") > k).alias("truncated"),
        F.array_join(F.array_sort(F.array_distinct(F.collect_list(F.struct("place", "source")))).getField("source"), ",").alias("terms"),
    )
