"""Queries on tables inside texts and on limits of batches, from conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.dialect import BLANKS, Oracle
from glossweave.operators import limits, references, tabular

CONFIGURED, CONTEXT, REPLY, HEAD, ITEM = 4000, 2400, 300, "Style: minimal\n===INPUT_TEXT===\n", "concat(i, '. [[ID:', i, ']] ')"


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a table: a row per turn, its text in three cells, sentences on lines of their own; the hints of some are off."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("t", F.replace(F.replace("text", F.lit("\t"), F.lit(" ")), F.lit(". "), F.lit(".\n")))
    third = F.floor(F.char_length("t") / 3).cast("int")
    cut = turns.select("conv_id", "turn", F.substring("t", F.lit(1), third).alias("a"), F.substring("t", third + 1, third).alias("b"), F.expr("substring(t, 2 * CAST(floor(length(t) / 3) AS INT) + 1)").alias("c"))
    feeds = lambda c: F.regexp_count(c, F.lit("\n")).cast("long")
    row = F.struct("turn", F.concat_ws("\t", "a", "b", "c").alias("row"), (feeds("a") + (F.col("conv_id") % 5 == 1).cast("long")).alias("lead"), feeds("c").alias("trail"))
    found = cut.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    hinted = F.col("id") % 4 != 3
    return found.select(
        "id", F.array_join(F.transform("r", lambda r: r["row"]), "\n").alias("text"), F.array_join(F.transform("r", lambda r: r["row"]), "\r\n").alias("source"), F.when(hinted, F.lit(3).cast("long")).alias("columns"), F.when(hinted, F.size("r").cast("long") + (F.col("id") % 7 == 6).cast("long")).alias("rows"),
        F.transform("r", lambda r: r["lead"]).alias("lead"), F.transform("r", lambda r: r["trail"]).alias("trail"),
    )


def tabular_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tabular.parsed(_tables(spark, sf_dir))
    return rows.select("id", F.col("row").cast("long").alias("row"), F.size("cells").cast("long").alias("columns"), F.md5(F.array_join("cells", "\t")).alias("md5"), F.coalesce(F.col("cost"), F.lit(0)).cast("long").alias("cost"))


def tabular_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other table by the hints of a copy whose rows end otherwise than the lines in its cells."""
    tables = _tables(spark, sf_dir)
    hints = tabular.hints(tables.where("id % 2 = 0").select("id", F.col("source").alias("text")))
    texts = tables.select("id", "text").join(hints, "id", "left")
    return tabular.pasted(tabular.parsed(texts)).select("id", F.md5("text").alias("md5"), F.char_length("text").cast("long").alias("n"))


def context_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return limits.context_limits(turns, "conv_id", "turn", "text", CONFIGURED, CONTEXT, REPLY, HEAD, ITEM)


MOST = 2000


def reference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reference files, read twice: in between, every seventh has changed and every eleventh has gone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat_ws("/", F.coalesce("source", F.lit("")), "doc_id").alias("path"), "doc_id", "text")
    changed = F.col("doc_id") % 7 == 0
    first = docs.select("path", F.lit(1).cast("long").alias("mtime"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))
    body = F.when(changed, F.concat(F.lit(" \r\n"), F.reverse("text"), F.lit("\t"))).otherwise(F.col("text"))
    second = docs.where("doc_id % 11 <> 0").select("path", F.when(changed, 2).otherwise(1).cast("long").alias("mtime"), F.octet_length(body).cast("long").alias("size"), body.alias("content"))
    cache = references.cut(first, MOST)
    wanted = references.refreshed(second, cache, lambda keys: second.join(keys, references.KEY, "left_semi"), MOST)
    return wanted.select("path", "mtime", "size", F.md5("text").alias("md5"), "truncated", "reused")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (tabular_cells, tabular_paste, context_limits, reference_texts)}

_TABLES = """
SELECT id, string_agg(a || chr(9) || b || chr(9) || c, chr(10) ORDER BY turn) AS text, string_agg(a || chr(9) || b || chr(9) || c, chr(13) || chr(10) ORDER BY turn) AS source, CASE WHEN id % 4 <> 3 THEN 3 END AS columns, CASE WHEN id % 4 <> 3 THEN count(*) + CASE WHEN id % 7 = 6 THEN 1 ELSE 0 END END AS rows,
  list(len(regexp_extract_all(a, chr(10))) + CASE WHEN id % 5 = 1 THEN 1 ELSE 0 END ORDER BY turn) AS lead, list(len(regexp_extract_all(c, chr(10))) ORDER BY turn) AS trail
FROM (SELECT conv_id AS id, turn, substr(t, 1, length(t) // 3) AS a, substr(t, length(t) // 3 + 1, length(t) // 3) AS b, substr(t, 2 * (length(t) // 3) + 1) AS c
  FROM (SELECT *, replace(replace(text, chr(9), ' '), '. ', '.' || chr(10)) AS t FROM conversations)) GROUP BY id"""


def _parsed_sql(source: str) -> str:
    """Every cut of every gap is tried."""
    return f"""
t AS MATERIALIZED ({source}),
l AS (SELECT id, columns, rows, lead, trail, unnest(range(len(string_split(rtrim(text, chr(10)), chr(10))))) AS i, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line FROM t WHERE contains(text, chr(9))),
m AS (SELECT *, length(line) - length(replace(line, chr(9), '')) AS tabs FROM l),
n AS MATERIALIZED (SELECT *, sum(tabs) OVER (PARTITION BY id ORDER BY i)::BIGINT AS upto, sum(tabs) OVER (PARTITION BY id)::BIGINT AS total, coalesce(columns - 1, max(tabs) OVER (PARTITION BY id)) AS each FROM m),
bad AS (SELECT DISTINCT id FROM n WHERE total % each <> 0 OR (columns IS NOT NULL AND total // each <> rows) OR (tabs > 0 AND (upto - tabs) // each <> (upto - 1) // each)),
g AS (SELECT id, upto // each AS own, count(*) AS z, any_value(columns) AS columns, any_value(lead) AS lead, any_value(trail) AS trail FROM n WHERE tabs = 0 AND upto % each = 0 AND upto > 0 AND upto < total GROUP BY id, upto, each),
k AS (SELECT id, own, z, columns, unnest(range(z + 1)) AS k, coalesce(lead[own + 1], 0) AS wanted, coalesce(trail[own], 0) AS behind FROM g),
c AS (SELECT id, own, CASE WHEN any_value(columns) IS NULL THEN max(z) ELSE arg_min(k, 2 * abs(k - behind) + 3 * abs(z - k - wanted)) END AS stay FROM k GROUP BY id, own),
p AS (SELECT n.*, row_number() OVER (PARTITION BY n.id, n.upto, n.tabs = 0 ORDER BY n.i) AS place, c.stay FROM n LEFT JOIN c ON c.id = n.id AND n.tabs = 0 AND n.upto % n.each = 0 AND c.own = n.upto // n.each WHERE n.id NOT IN (SELECT id FROM bad)),
r AS (SELECT *, CASE WHEN stay IS NOT NULL AND place <= stay THEN upto // each - 1 WHEN tabs = 0 THEN least(upto // each, total // each - 1) ELSE (upto - tabs) // each END AS row FROM p),
e AS (SELECT *, min(i) FILTER (tabs > 0) OVER w - min(i) OVER w AS first, max(i) OVER w - max(i) FILTER (tabs > 0) OVER w AS last FROM r WINDOW w AS (PARTITION BY id, row)),
o AS (SELECT id, row, string_agg(line, chr(10) ORDER BY i) AS text, CASE WHEN any_value(columns) IS NOT NULL THEN 3 * abs(max(first) - coalesce(any_value(lead)[row + 1], 0)) + CASE WHEN row = any_value(total // each) - 1 THEN 0 ELSE 2 * abs(max(last) - coalesce(any_value(trail)[row + 1], 0)) END END AS cost FROM e GROUP BY id, row)"""


_OVER = f"trim(text, {Oracle().text(BLANKS)})"
_TRIED, _REST = limits.candidates(CONFIGURED)
_HINTS = f"""
SELECT id, text, CASE WHEN hinted THEN wide END AS columns, CASE WHEN hinted THEN len(cells) END AS rows, list_transform(cells, lambda x: len(regexp_extract_all(x[1], chr(10)))) AS lead, list_transform(cells, lambda x: len(regexp_extract_all(coalesce(x[wide], ''), chr(10)))) AS trail
FROM (SELECT *, list_max(list_transform(cells, lambda x: len(x))) AS wide, id % 2 = 0 AS hinted FROM (
  SELECT id, text, list_transform(string_split(rtrim(source, chr(13) || chr(10)), chr(13) || chr(10)), lambda y: string_split(y, chr(9))) AS cells FROM ({_TABLES}) AS t) AS c) AS w"""

_BODY = "CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(13) || chr(10) || reverse(text) || chr(9) ELSE text END"
_WHOLE = f"trim(replace(replace({_BODY}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {Oracle().text(BLANKS)})"

SQL: dict[str, str] = {
    "reference_texts": f"""
SELECT coalesce(source, '') || '/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS mtime, strlen({_BODY}) AS size, md5(substr({_WHOLE}, 1, {MOST})) AS md5, length({_WHOLE}) > {MOST} AS truncated, doc_id % 7 <> 0 AS reused
FROM documents WHERE doc_id % 11 <> 0""",
    "tabular_cells": f"WITH {_parsed_sql(_TABLES)} SELECT id, row, len(string_split(text, chr(9))) AS columns, md5(text) AS md5, coalesce(cost, 0)::BIGINT AS cost FROM o",
    "tabular_paste": f"""
WITH {_parsed_sql(_HINTS)}
SELECT id, md5(text) AS md5, length(text) AS n FROM (
  SELECT id, string_agg(list_aggregate(list_transform(string_split(text, chr(9)), lambda c: CASE WHEN contains(c, '"') OR contains(c, chr(10)) THEN '"' || replace(c, '"', '""') || '"' ELSE c END), 'string_agg', chr(9)), chr(13) || chr(10) ORDER BY row) AS text FROM o GROUP BY id)""",
    "context_limits": f"""
WITH t AS (SELECT conv_id, turn, {_OVER} AS own FROM conversations WHERE {_OVER} <> ''),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, sum(length(own)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM t),
c AS (SELECT unnest({_TRIED}) AS lim, unnest(range({len(_TRIED)})) AS place),
p AS (SELECT conv_id, lim, place, count(*) AS texts, '{HEAD.replace(chr(10), "' || chr(10) || '")}' || string_agg(i || '. [[ID:' || i || ']] ' || own, chr(10) ORDER BY i) AS prompt FROM i, c WHERE i <= 50 AND (i = 1 OR upto <= lim) GROUP BY ALL),
k AS (SELECT conv_id, lim, place, texts, length(prompt) - len(regexp_extract_all(prompt, '[\\x00-\\x7F]')) + (len(regexp_extract_all(prompt, '[\\x00-\\x7F]')) + 2) // 3 AS tokens FROM p),
b AS (SELECT conv_id, arg_min(lim, place) AS lim, arg_min(texts, place) AS texts, arg_min(tokens, place) AS tokens FROM k WHERE 2 * tokens + 2 + {REPLY} + 96 <= {CONTEXT} GROUP BY conv_id)
SELECT a.conv_id, CASE WHEN a.conv_id NOT IN (SELECT conv_id FROM t) THEN {CONFIGURED} ELSE coalesce(lim, {_REST}) END::BIGINT AS "limit", a.conv_id IN (SELECT conv_id FROM t) AND (lim IS NULL OR lim < {CONFIGURED}) AS estimated, texts, tokens
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b USING (conv_id)""",
}
