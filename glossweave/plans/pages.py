"""Queries on page geometry: tables, neighbours, cells and reading order, from one statement for both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.operators import reading
from glossweave.plans.relational import _BOXES, boxes

# Gaps, shares and labels that results depend on.
GAP, SHARE, MARGIN, SIZE, JUMP, COLUMN_GAP = 5.0, 0.3, 20.0, 10.5, 5.0, 10.0
PAGE_W, PAGE_H = 800.0, 900.0
SKIPPED, TEXTUAL = "('figure')", "('text', 'title', 'table')"

_DX, _DY = "(least(a.x1, o.x1) - greatest(a.x0, o.x0))", "(least(a.y1, o.y1) - greatest(a.y0, o.y0))"
_OTHER = "NOT (abs(o.x0 - a.x0) < 5 AND abs(o.y0 - a.y0) < 5)"
_VALUES = "SELECT page, 'x' AS axis, x0 AS v FROM b UNION ALL SELECT page, 'x', x1 FROM b UNION ALL SELECT page, 'y', y0 FROM b UNION ALL SELECT page, 'y', y1 FROM b"
# Equal edges are peers of one frame, so they share a cluster whichever of them comes first.
_LINES = f"""
  SELECT page, axis, line, total, n, row_number() OVER (PARTITION BY page, axis ORDER BY line) - 1 AS i FROM (
    SELECT page, axis, avg(v) AS line, sum(v) AS total, count(*) AS n FROM (
      SELECT page, axis, v, sum(new) OVER (PARTITION BY page, axis ORDER BY v) AS cluster FROM (
        SELECT page, axis, v, CASE WHEN v - lag(v) OVER (PARTITION BY page, axis ORDER BY v) > {JUMP} THEN 1 ELSE 0 END AS new FROM ({_VALUES}) AS e) AS f) AS g
    GROUP BY page, axis, cluster) AS h"""
# The nearest grid line to an edge is the one after all midpoints below it, so the first of equally near ones. A midpoint is one
# quotient of sums and counts: as differences of means, rounding would tell equally near lines apart.
_NEAREST = f"""
  SELECT page, box, x0, y0, x1, y1, max(CASE WHEN side = 'x0' THEN i END) AS c0, max(CASE WHEN side = 'x1' THEN i END) AS c1, max(CASE WHEN side = 'y0' THEN i END) AS r0, max(CASE WHEN side = 'y1' THEN i END) AS r1 FROM (
    SELECT page, box, x0, y0, x1, y1, side, sum(mid) OVER (PARTITION BY page, axis ORDER BY v, mid) AS i FROM (
      SELECT page, axis, 1 AS mid, '' AS side, (total * next_n + next_total * n) / (2 * n * next_n) AS v, NULL AS box, NULL AS x0, NULL AS y0, NULL AS x1, NULL AS y1 FROM (
        SELECT page, axis, total, n, lead(total) OVER (PARTITION BY page, axis ORDER BY line) AS next_total, lead(n) OVER (PARTITION BY page, axis ORDER BY line) AS next_n FROM ({_LINES}) AS k) AS m WHERE next_n IS NOT NULL
      UNION ALL SELECT page, 'x', 0, 'x0', x0, box, x0, y0, x1, y1 FROM b UNION ALL SELECT page, 'x', 0, 'x1', x1, box, x0, y0, x1, y1 FROM b
      UNION ALL SELECT page, 'y', 0, 'y0', y0, box, x0, y0, x1, y1 FROM b UNION ALL SELECT page, 'y', 0, 'y1', y1, box, x0, y0, x1, y1 FROM b) AS u) AS w
  WHERE side <> '' GROUP BY page, box, x0, y0, x1, y1"""
_EDGES = f"""
  SELECT a.page, a.box, o.box AS next FROM b a JOIN b o ON a.page = o.page AND a.box <> o.box
  WHERE CASE WHEN {_DY} > 0 AND {_DY} / least(a.y1 - a.y0, o.y1 - o.y0) >= 0.3 THEN o.x0 > a.x0 + 10 ELSE (o.y0 + o.y1) / 2 > (a.y0 + a.y1) / 2 + 5 AND {_DX} > 0 AND {_DX} / least(a.x1 - a.x0, o.x1 - o.x0) >= 0.3 END"""
_BETWEEN = f"""
  SELECT DISTINCT e.page, e.box, e.next FROM ({_EDGES}) e JOIN b a ON a.page = e.page AND a.box = e.box JOIN b o ON o.page = e.page AND o.box = e.next
    JOIN b m ON m.page = e.page AND m.box <> e.box AND m.box <> e.next
  WHERE CASE WHEN {_DY} > 0 AND {_DY} / least(a.y1 - a.y0, o.y1 - o.y0) >= 0.3
    THEN m.x1 > a.x1 AND m.x0 < o.x0 AND least(a.y1, m.y1) - greatest(a.y0, m.y0) >= 0.3 * least(a.y1 - a.y0, m.y1 - m.y0) AND least(a.y1, m.y1) > greatest(a.y0, m.y0)
         AND least(o.y1, m.y1) - greatest(o.y0, m.y0) >= 0.3 * least(o.y1 - o.y0, m.y1 - m.y0) AND least(o.y1, m.y1) > greatest(o.y0, m.y0)
    ELSE m.y1 > a.y1 AND m.y0 < o.y0 AND least(a.x1, m.x1) - greatest(a.x0, m.x0) >= 0.3 * least(a.x1 - a.x0, m.x1 - m.x0) AND least(a.x1, m.x1) > greatest(a.x0, m.x0)
         AND least(o.x1, m.x1) - greatest(o.x0, m.x0) >= 0.3 * least(o.x1 - o.x0, m.x1 - m.x0) AND least(o.x1, m.x1) > greatest(o.x0, m.x0) END"""


#: name -> statement over ``b``: page, box, x0, y0, x1, y1, label.
STATEMENTS: dict[str, str] = {
    "painted_boxes": f"""
SELECT page, box, label, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN label IN {SKIPPED} THEN 1 ELSE 0 END, box) AS paint_order FROM b
WHERE NOT (label IN {TEXTUAL} AND (x1 - x0 < 32 OR y1 - y0 < 32))""",
    "translation_cells": f"SELECT page, box, label, x0, y0, x1, y1, concat('P', page, '_', box) AS address FROM b WHERE (x1 - x0) % 10 / 10 >= 0.3 AND label NOT IN {SKIPPED} AND label <> 'footer'",
    "axis_overlaps": f"""
SELECT a.page, a.box AS a, o.box AS o, {_DX} >= 0.5 * least(a.x1 - a.x0, o.x1 - o.x0) AS horizontal, {_DY} >= 0.5 * least(a.y1 - a.y0, o.y1 - o.y0) AS vertical,
  a.label = o.label AND a.label <> 'footer' AS same_region
FROM b a JOIN b o ON a.page = o.page AND a.box < o.box WHERE {_DX} > 0 OR {_DY} > 0""",
    "grid_lines": f"SELECT page, axis, CAST(i AS BIGINT) AS i, round(line, 6) AS line FROM ({_LINES}) AS l",
    "table_structure": f"""
SELECT t.page, t.box, CAST(floor(r0 / 2) AS BIGINT) AS row_idx, CAST(floor(c0 / 2) AS BIGINT) AS col_idx, CAST(greatest(1, floor((r1 - r0 + 1) / 2)) AS BIGINT) AS row_span, CAST(greatest(1, floor((c1 - c0 + 1) / 2)) AS BIGINT) AS col_span
FROM b t JOIN ({_NEAREST}) e ON e.page = t.page AND e.box = t.box AND e.x0 = t.x0 AND e.y0 = t.y0 AND e.x1 = t.x1 AND e.y1 = t.y1""",
    "adjacent_limits": f"""
SELECT a.page, a.box,
  max(greatest({MARGIN}, CASE WHEN o.x1 < a.x0 - {GAP} AND {_DY} > (a.y1 - a.y0) * {SHARE} THEN o.x1 + {GAP} ELSE {MARGIN} END)) AS lim_left,
  min(least({PAGE_W - MARGIN}, CASE WHEN o.x0 > a.x1 + {GAP} AND {_DY} > (a.y1 - a.y0) * {SHARE} THEN o.x0 - {GAP} ELSE {PAGE_W - MARGIN} END)) AS lim_right,
  max(greatest({MARGIN}, CASE WHEN o.y1 < a.y0 - {GAP} AND {_DX} > (a.x1 - a.x0) * {SHARE} THEN o.y1 + {GAP} ELSE {MARGIN} END)) AS lim_bottom,
  min(least({PAGE_H - MARGIN}, CASE WHEN o.y0 > a.y1 + {GAP} AND {_DX} > (a.x1 - a.x0) * {SHARE} THEN o.y0 - {GAP} ELSE {PAGE_H - MARGIN} END)) AS lim_top
FROM b a JOIN b o ON a.page = o.page GROUP BY a.page, a.box""",
    "side_boundaries": f"""
SELECT page, box, bound_left, bound_right, bound_bottom, bound_top, greatest(0, x0 - bound_left) AS free_left, greatest(0, bound_right - x1) AS free_right, greatest(0, y0 - bound_bottom) AS free_bottom, greatest(0, bound_top - y1) AS free_top,
  CASE WHEN x1 >= {PAGE_W - MARGIN} THEN x1 - x0 ELSE greatest(x1 - x0, bound_right - x0) END AS expandable_width FROM (
  SELECT a.page, a.box, a.x0, a.y0, a.x1, a.y1,
    least(min(a.x0), max(CASE WHEN {_OTHER} AND o.x1 < a.x0 - {COLUMN_GAP} AND {_DY} >= (a.y1 - a.y0) * {SHARE} AND o.x1 + {COLUMN_GAP} > {MARGIN} THEN o.x1 + {COLUMN_GAP} ELSE {MARGIN} END)) AS bound_left,
    greatest(max(a.x1), min(CASE WHEN {_OTHER} AND o.x0 > a.x1 + {COLUMN_GAP} AND {_DY} >= (a.y1 - a.y0) * {SHARE} AND o.x0 - {COLUMN_GAP} < {PAGE_W - MARGIN} THEN o.x0 - {COLUMN_GAP} ELSE {PAGE_W - MARGIN} END)) AS bound_right,
    least(min(a.y0), max(CASE WHEN {_OTHER} AND o.y1 < a.y0 - {COLUMN_GAP} AND {_DX} >= (a.x1 - a.x0) * {SHARE} AND o.y1 + {COLUMN_GAP} > {MARGIN} THEN o.y1 + {COLUMN_GAP} ELSE {MARGIN} END)) AS bound_bottom,
    greatest(max(a.y1), min(CASE WHEN {_OTHER} AND o.y0 > a.y1 + {COLUMN_GAP} AND {_DX} >= (a.x1 - a.x0) * {SHARE} AND o.y0 - {COLUMN_GAP} < {PAGE_H - MARGIN} THEN o.y0 - {COLUMN_GAP} ELSE {PAGE_H - MARGIN} END)) AS bound_top
  FROM b a JOIN b o ON a.page = o.page GROUP BY a.page, a.box, a.x0, a.y0, a.x1, a.y1) AS s""",
    "cell_boundaries": f"""
SELECT page, box, c0 AS cell_left, c1 AS cell_right, d0 AS cell_bottom, d1 AS cell_top, greatest(0, x0 - c0 - {COLUMN_GAP}) AS free_left, greatest(0, c1 - x1 - {COLUMN_GAP}) AS free_right FROM (
  SELECT a.page, a.box, a.x0, a.x1, o.x0 AS c0, o.x1 AS c1, o.y0 AS d0, o.y1 AS d1, row_number() OVER (PARTITION BY a.page, a.box ORDER BY {_DX} * {_DY} DESC, o.box) AS place
  FROM b a JOIN b o ON a.page = o.page AND o.label = 'table' AND a.box <> o.box AND (a.x0 + a.x1) / 2 BETWEEN o.x0 AND o.x1 AND (a.y0 + a.y1) / 2 BETWEEN o.y0 AND o.y1 AND {_DX} > 0 AND {_DY} > 0) AS s WHERE place = 1""",
    "font_sizes": f"""
SELECT page, box, coalesce(min(CASE WHEN place = 1 THEN size END), {SIZE}) AS size FROM (
  SELECT a.page, a.box, o.y1 - o.y0 AS size, row_number() OVER (PARTITION BY a.page, a.box ORDER BY {_DX} * {_DY} DESC, o.box) AS place
  FROM b a JOIN b o ON a.page = o.page AND o.label = 'text' AND {_DX} > 0 AND {_DY} > 0 AND {_DX} * {_DY} >= 0.2 * least((a.x1 - a.x0) * (a.y1 - a.y0), (o.x1 - o.x0) * (o.y1 - o.y0))
  UNION ALL SELECT page, box, NULL, NULL FROM b) AS s GROUP BY page, box""",
    "cells_at_points": """
SELECT p.page, p.box AS point, coalesce(min(c.box), -1) AS cell FROM b p LEFT JOIN b c ON c.page = p.page AND c.label = 'table' AND (p.x0 + p.x1) / 2 >= c.x0 AND (p.x0 + p.x1) / 2 <= c.x1 AND (p.y0 + p.y1) / 2 >= c.y0 AND (p.y0 + p.y1) / 2 <= c.y1 GROUP BY p.page, p.box""",
    "reading_edges": f"SELECT e.page, e.box, e.next FROM ({_EDGES}) e LEFT JOIN ({_BETWEEN}) k ON k.page = e.page AND k.box = e.box AND k.next = e.next WHERE k.box IS NULL",
}
_TEXTS = {
    "spark": "SELECT page, cell, array_join(transform(array_sort(collect_list(struct(y, x, id))), t -> CAST(t.id AS STRING)), ',') AS ids FROM ({}) AS q GROUP BY page, cell",
    "oracle": "SELECT page, cell, string_agg(id::VARCHAR, ',' ORDER BY y, x, id) AS ids FROM ({}) AS q GROUP BY page, cell",
}
_MEMBERS = f"SELECT a.page, o.box AS cell, a.box AS id, a.y0 AS y, a.x0 AS x FROM b a JOIN b o ON a.page = o.page AND o.label = 'table' AND a.label <> 'table' AND a.x1 > o.x0 - {GAP} AND a.x0 < o.x1 + {GAP} AND a.y1 > o.y0 - {GAP} AND a.y0 < o.y1 + {GAP}"


def _query(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    import re

    sql = re.sub(r"\b(FROM|JOIN) b\b", r"\1 {b}", statement)
    return lambda spark, sf_dir: spark.sql(sql, b=boxes(spark, sf_dir))


def boxes_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that a detector gives as JSON, a list a page."""
    told = F.to_json(F.struct(F.collect_list(F.struct("box", "label", F.array("x0", "y0", "x1", "y1").alias("coordinate"))).alias("boxes")))
    replies = boxes(spark, sf_dir).groupBy("page").agg(told.alias("json"))
    read = F.from_json("json", "boxes array<struct<box: bigint, label: string, coordinate: array<double>>>")
    return replies.select("page", F.explode(read["boxes"]).alias("b")).select("page", "b.box", "b.label", *[F.get("b.coordinate", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each box in its page's reading order."""
    b = boxes(spark, sf_dir)
    return reading.ordered(b, QUERIES["reading_edges"](spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(s) for name, s in STATEMENTS.items()}
QUERIES |= {"cell_texts": _query(_TEXTS["spark"].format(_MEMBERS)), "reading_order": reading_order, "boxes_from_json": boxes_from_json}
SQL = {name: f"WITH b AS ({_BOXES}) {s}" for name, s in {**STATEMENTS, "cell_texts": _TEXTS["oracle"].format(_MEMBERS)}.items()}
SQL["boxes_from_json"] = f"SELECT page, box, label, x0, y0, x1, y1 FROM ({_BOXES})"
