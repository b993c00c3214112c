"""Exact dedup by two Bloom passes.

Pass one hashes every text and fills a saturating Bloom filter with the hashes.  Pass two asks the
filter about each hash: rows whose hash is certainly unique pass straight through, and only the
others are shuffled, to be grouped by the full SHA-256 of the normalised text.  Groups are reduced
on the map side first, so a group of copies that holds a third of all rows costs each task one row.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; null counts as empty.  Of equal
texts the one with the most code points in the original stays, then the smallest id (a null id comes
last).  Texts of any length count whole.  Empty tables give empty results; extra columns pass through ``drop_duplicates`` untouched.
Rows that repeat an id and a text are one text: ``decisions`` marks each of them alike and
``drop_duplicates`` keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import bloom
from glossweave.llm.scratch import materialise, table

_BLANK = "[\\x20\\x09-\\x0D]"


def _sha(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANK, ""), 256)


def _rank(length: Column, doc_id: Column) -> Column:
    return F.struct(length.alias("n"), F.coalesce(-doc_id, F.lit(-(2**63))).alias("i"))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    keys = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"),
        _sha(text).alias("text_sha256"),
    )
    return keys.withColumn("h", F.conv(F.substring("text_sha256", 2, 15), 16, 10).cast("long"))


def flagged_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, text_sha256, h and ``maybe``: whether another row possibly has the same text."""
    keys = materialise(_keys(docs, id_col, text_col), "exact-keys")
    return bloom.flagged(keys, keys, "h", "maybe")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = flagged_keys(docs, id_col, text_col)
    single = keys.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    rows = keys.where("maybe").select("doc_id", "n_chars", "text_sha256")
    groups = rows.groupBy("text_sha256").agg(
        F.max_by("doc_id", _rank(F.col("n_chars"), F.col("doc_id"))).alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
    )
    groups = materialise(groups, "exact-groups")  # the join then shuffles both sides itself, and Spark can split a hot text
    grouped = rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return single.unionByName(grouped)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, without later copies of a text.

    Rows that the filter passes never leave their task.  The rest meet as one best row per text and
    task, because the reduction runs before the shuffle.
    """
    sha, h, flag = "__gw_sha", "__gw_h", "__gw_maybe"
    while {sha, h, flag} & set(docs.columns):
        sha, h, flag = sha + "_", h + "_", flag + "_"
    keys = materialise(_keys(docs, id_col, text_col).select(F.col("h").alias(h)), "exact-hashes")
    hashed = docs.withColumn(sha, _sha(F.col(text_col))).withColumn(h, F.conv(F.substring(sha, 2, 15), 16, 10).cast("long"))
    rows = bloom.flagged(hashed, keys, h, flag)
    single = rows.where(~F.col(flag)).select(*docs.columns)
    length = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    best = (
        rows.where(flag)
        .groupBy(sha)
        .agg(F.max_by(F.struct(*docs.columns), _rank(length, F.col(id_col).cast("long"))).alias("row"))
        .select("row.*")
    )
    return single.unionByName(best)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM k
"""
