"""Queries that compare texts: untranslated replies by their folded form, versions by their parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import vectorised


def untranslated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents beside variants of themselves: spaced, in other case and full width, or changed."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    wide = F.translate("text", "aeA(!", "ａｅＡ（！")
    variant = F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit(" "), F.lit(" 　\t"))).when(F.col("doc_id") % 4 == 1, wide).when(F.col("doc_id") % 4 == 2, F.concat("text", F.lit("!"))).otherwise(F.lit(" \n"))
    rows = rows.withColumn("out", variant)
    folded, bare = vectorised.udf(vectorised.folded, "string"), vectorised.udf(vectorised.bare, "string")
    untranslated = vectorised.udf(vectorised.looks_untranslated, "boolean")
    return rows.select("doc_id", F.md5(folded(F.col("out"))).alias("folded"), F.md5(bare(F.col("out"))).alias("bare"), untranslated(F.col("text"), F.col("out")).alias("untranslated"))


def newer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions made of order lines against those of the next line of the same order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.col("l_quantity").cast("long")
    pre = F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("-rc."), (q % 3).cast("string"))).when(F.col("l_suppkey") % 4 == 1, F.concat(F.lit("-"), (q % 2).cast("string"))).otherwise("")
    version = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "v").otherwise(""), (F.col("l_partkey") % 2).cast("string"), F.lit("."), (q % 12).cast("string"), F.when(F.col("l_partkey") % 3 == 0, ".0").otherwise(""), pre, F.when(q % 5 == 0, "+build.7").otherwise(""))
    pairs = rows.select("l_orderkey", "l_linenumber", version.alias("version"))
    following = pairs.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("version").alias("latest"))
    newer = vectorised.udf(vectorised.is_newer, "boolean")
    return pairs.join(following, ["l_orderkey", "l_linenumber"]).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "version", "latest", newer("latest", "version").alias("newer"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (untranslated_pairs, newer_versions)}

_FOLD = "replace(lower(replace(replace(replace(replace(replace(replace({0}, 'ａ', 'a'), 'ｅ', 'e'), 'Ａ', 'A'), '（', '('), '！', '!'), chr(12288), ' ')), 'ß', 'ss')".format
_BARE = "regexp_replace({0}, '\\s', '', 'g')".format

SQL: dict[str, str] = {
    "untranslated_pairs": f"""
WITH o AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN replace(text, ' ', ' ' || chr(12288) || chr(9)) WHEN 1 THEN translate(text, 'aeA(!', 'ａｅＡ（！') WHEN 2 THEN text || '!' ELSE ' ' || chr(10) END AS out FROM documents)
SELECT doc_id, md5({_FOLD('out')}) AS folded, md5({_BARE(_FOLD('out'))}) AS bare, {_BARE(_FOLD('text'))} <> '' AND {_BARE(_FOLD('text'))} = {_BARE(_FOLD('out'))} AS untranslated FROM o""",
    "newer_versions": """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey % 2 AS major, l_quantity::BIGINT % 12 AS minor, CASE l_suppkey % 4 WHEN 0 THEN [1, l_quantity::BIGINT % 3] WHEN 1 THEN [0, l_quantity::BIGINT % 2] END AS pre,
  CASE WHEN l_linenumber % 2 = 0 THEN 'v' ELSE '' END || l_partkey % 2 || '.' || l_quantity::BIGINT % 12 || CASE WHEN l_partkey % 3 = 0 THEN '.0' ELSE '' END || CASE l_suppkey % 4 WHEN 0 THEN '-rc.' || l_quantity::BIGINT % 3 WHEN 1 THEN '-' || l_quantity::BIGINT % 2 ELSE '' END || CASE WHEN l_quantity::BIGINT % 5 = 0 THEN '+build.7' ELSE '' END AS version FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber::BIGINT AS l_linenumber, a.version, b.version AS latest,
  CASE WHEN a.major <> b.major THEN b.major > a.major WHEN a.minor <> b.minor THEN b.minor > a.minor WHEN a.pre IS NULL OR b.pre IS NULL THEN b.pre IS NULL AND a.pre IS NOT NULL WHEN a.pre[1] <> b.pre[1] THEN b.pre[1] > a.pre[1] ELSE b.pre[2] > a.pre[2] END AS newer
FROM v a JOIN v b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
}
