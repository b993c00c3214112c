"""Queries on messages and workbooks: blocks, rebuilt bodies, names of sheets, merged areas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.dialect import BLANKS, Oracle
from glossweave.operators import messages, sheets


def _mails(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a message: the first turn is the subject, the others the body, whose lines are paragraphs with blank ones between turns."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t")))).alias("r"), F.min_by("text", "turn").alias("subject"))
    return own.select("conv_id", "subject", F.array_join(F.transform(F.slice("r", F.lit(2), F.size("r")), lambda r: r["t"]), "\n\n \n\n").alias("body"))


def message_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = messages.blocks(_mails(spark, d), ["conv_id"])
    return rows.select("conv_id", "id", "section", F.md5("text").alias("md5"), "location")


def message_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Every block but those of each third section is translated, into its reverse."""
    mails = _mails(spark, d)
    said = messages.blocks(mails, ["conv_id"]).where("section % 3 <> 1").withColumn("text", F.reverse("text"))
    return messages.rebuilt(mails, said, ["conv_id"]).select("conv_id", F.md5("subject").alias("subject_md5"), F.md5("body").alias("body_md5"))


_SUFFIX = ["_A1", "_shape_2", "_BC12", "_a1", "_chart_3_title", "_chart_1_axis_value", "_A0"]
_MIDDLE = ["", "_x", "_x_y"]


def _named(docs: DataFrame) -> DataFrame:
    """A block a document: its source is the workbook, its language the sheet, plain or with a longer name."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % n + 1).cast("int"))
    return docs.select("doc_id", F.col("source").alias("book"), F.concat("lang", pick(_MIDDLE, 3), pick(_SUFFIX, 7)).alias("id"))


def routed_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.where("doc_id % 2 = 0").select(F.col("source").alias("book"), F.explode(F.array("lang", F.concat("lang", F.lit("_x")))).alias("sheet"))
    found = sheets.targets(sheets.routed(_named(docs), names, ["book"]))
    places = [F.coalesce(x, F.lit(-1).cast("long")).alias(x) for x in ("row", "column", "number")]
    return found.select("doc_id", "id", "sheet", "kind", *places, F.coalesce("part", F.lit("")).alias("part"))


def areas_of_cells(spark: SparkSession, d: str) -> DataFrame:
    """Line items as cells of a sheet for each supplier group; returned ones span areas.  How many areas each cell is in, and the widest."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    r, c = F.col("l_partkey").cast("long") % 5000 + 1, F.col("l_orderkey").cast("long") % 300 + 1
    cells = lines.select(F.col("l_suppkey").cast("long").alias("sheet"), r.alias("row"), c.alias("column")).distinct()
    areas = lines.where("l_returnflag = 'R'").select(
        F.col("l_suppkey").cast("long").alias("sheet"), r.alias("r1"), c.alias("c1"), (r + F.col("l_quantity").cast("long") * 40).alias("r2"), (c + F.col("l_linenumber").cast("long") * 9).alias("c2")
    ).distinct()
    size = (F.col("r2") - F.col("r1") + 1) * (F.col("c2") - F.col("c1") + 1)
    return sheets.in_areas(cells, areas, ["sheet"]).groupBy("sheet", "row", "column").agg(F.count(F.lit(1)).alias("areas"), F.max(size).alias("widest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (message_blocks, message_bodies, routed_blocks, areas_of_cells)}

_BLANK = Oracle().text(BLANKS)
#: Bodies of conversations have no paragraph of more than 3000 characters; the tests hold chunks against known answers.
_PARTS = f"""
t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
m AS (SELECT conv_id, max(text) FILTER (n = 1) AS subject,
  coalesce(string_agg(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10) || ' ' || chr(10) || chr(10) ORDER BY turn) FILTER (n > 1), '') AS body FROM t GROUP BY conv_id),
s AS (SELECT conv_id, CASE WHEN body = '' THEN [] ELSE string_split(body, chr(10) || chr(10)) END AS parts FROM m),
p AS (SELECT conv_id, unnest(range(len(parts))) AS place, trim(unnest(parts), {_BLANK}) AS text FROM s)"""

_PICK = lambda names, n: "([" + ", ".join(f"'{x}'" for x in names) + f"])[doc_id % {n} + 1]"
SQL = {
    "message_blocks": f"""WITH {_PARTS}
SELECT conv_id, 'msg_subject' AS id, 0 AS section, md5(subject) AS md5, '件名' AS location FROM m WHERE subject <> ''
UNION ALL SELECT conv_id, 'msg_body_' || place, place + 1, md5(text), '本文段落' || row_number() OVER (PARTITION BY conv_id ORDER BY place) FROM p WHERE text <> ''""",
    "message_bodies": f"""WITH {_PARTS},
b AS (SELECT conv_id, string_agg(CASE WHEN (place + 1) % 3 <> 1 THEN reverse(text) ELSE text END, chr(10) || chr(10) ORDER BY place) AS body FROM p GROUP BY conv_id)
SELECT m.conv_id, md5(reverse(m.subject)) AS subject_md5, md5(coalesce(b.body, '')) AS body_md5 FROM m LEFT JOIN b ON b.conv_id = m.conv_id""",
    "routed_blocks": f"""WITH d AS (SELECT doc_id, source, lang, {_PICK(_MIDDLE, 3)} AS middle, {_PICK(_SUFFIX, 7)} AS tail FROM documents),
s AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 0),
x AS (SELECT doc_id, lang || middle || tail AS id, lang || middle AS sheet, tail FROM d SEMI JOIN s ON s.source = d.source AND s.lang = d.lang WHERE middle <> '_x_y' AND tail NOT IN ('_a1', '_A0'))
SELECT doc_id, id, sheet, CASE WHEN tail LIKE '%shape%' THEN 'shape' WHEN tail LIKE '%chart%' THEN 'chart' ELSE 'cell' END AS kind,
  CASE tail WHEN '_A1' THEN 1 WHEN '_BC12' THEN 12 ELSE -1 END AS row, CASE tail WHEN '_A1' THEN 1 WHEN '_BC12' THEN 55 ELSE -1 END AS "column",
  CASE tail WHEN '_shape_2' THEN 2 WHEN '_chart_3_title' THEN 3 WHEN '_chart_1_axis_value' THEN 1 ELSE -1 END AS number,
  CASE tail WHEN '_chart_3_title' THEN 'title' WHEN '_chart_1_axis_value' THEN 'value' ELSE '' END AS part FROM x""",
    "areas_of_cells": """WITH l AS (SELECT DISTINCT l_suppkey AS sheet, l_partkey % 5000 + 1 AS r, l_orderkey % 300 + 1 AS c FROM lineitem),
a AS (SELECT DISTINCT l_suppkey AS sheet, l_partkey % 5000 + 1 AS r1, l_orderkey % 300 + 1 AS c1, l_partkey % 5000 + 1 + CAST(trunc(l_quantity) AS BIGINT) * 40 AS r2, l_orderkey % 300 + 1 + l_linenumber * 9 AS c2
  FROM lineitem WHERE l_returnflag = 'R')
SELECT l.sheet, r AS row, c AS "column", count(*) AS areas, max((r2 - r1 + 1) * (c2 - c1 + 1)) AS widest
FROM l JOIN a ON a.sheet = l.sheet AND r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2 GROUP BY ALL""",
}
