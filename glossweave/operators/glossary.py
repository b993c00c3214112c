"""Matching of glossary terms against texts, best ones first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def words(text: str) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def matches(docs: DataFrame, glossary: DataFrame, k: int) -> DataFrame:
    """doc_id, n (terms found), truncated, terms: the ``k`` longest, earlier rules first.

    ``glossary``: rule, term (one lower-case word).  The texts' distinct words meet the terms in an equi-join,
    which replaces a join on containment.
    """
    found = docs.select("doc_id", F.explode(F.array_distinct(words("text"))).alias("term")).join(glossary, "term")
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.char_length("term").desc(), "rule"))
    ranked = found.withColumn("place", best)
    return ranked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) > k).alias("truncated"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= k, F.struct("place", "term")))).getField("term"), ",").alias("terms"),
    )
