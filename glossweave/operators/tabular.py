"""Tables in texts: cells by tabs, rows of several lines, and the hint that a source gives on its translation.

A row holds a fixed number of tabs, so only lines without tabs that stand between two rows can go to either.  The best cut costs 3 for each
line by which the lines before a row's first tab miss the hint, and 2 for each after its last.  These costs part by gap, and as the first
weighs more, the following row takes as many lines as its hint says, if there are that many: the minimum over all cuts, without a search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAD_COST, TRAIL_COST = 3, 2


def _plain(x: str) -> str:
    return f"replace(replace({x}, '\\r\\n', '\\n'), '\\r', '\\n')"


def hints(sources: DataFrame) -> DataFrame:
    """id, columns, rows, lead, trail from id and text: its size and, by row, the line feeds in the first and the last cell; null without a table."""
    lines = f"CASE WHEN contains(text, '\\r\\n') THEN split(rtrim('\\r\\n', text), '\\r\\n', -1) WHEN contains({_plain('text')}, '\\n') THEN split(rtrim('\\n', {_plain('text')}), '\\n', -1) ELSE array(text) END"
    cut = sources.where("contains(text, '\\t')").selectExpr("id", f"transform({lines}, l -> split(l, '\\t', -1)) AS cells")
    wide = cut.selectExpr("id", "cells", "array_max(transform(cells, c -> size(c))) AS columns").where("columns >= 2")
    feeds = "CAST(regexp_count({0}, '\\r\\n|\\r|\\n') AS BIGINT)".format
    return wide.selectExpr("id", "CAST(columns AS BIGINT) AS columns", "CAST(size(cells) AS BIGINT) AS rows", f"transform(cells, c -> {feeds('c[0]')}) AS lead", f"transform(cells, c -> {feeds("coalesce(get(c, columns - 1), '')")}) AS trail")


def parsed(texts: DataFrame) -> DataFrame:
    """id, row, cells, cost from id, text, columns, rows, lead, trail; texts that don't form the table have no rows.

    Without a hint (null columns) the widest line gives the number of tabs, and rows keep the lines behind them.  ``cost`` is that of the row.
    """
    body = f"rtrim('\\n', {_plain('text')})"
    lines = texts.where("contains(text, '\\t')").selectExpr("id", "columns", "rows", "lead", "trail", f"posexplode(split({body}, '\\n', -1)) AS (i, line)").selectExpr("*", "CAST(length(line) - length(replace(line, '\\t', '')) AS BIGINT) AS tabs")
    lines = lines.selectExpr("*", "coalesce(sum(tabs) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS upto", "sum(tabs) OVER (PARTITION BY id) AS total", "coalesce(columns - 1, max(tabs) OVER (PARTITION BY id)) AS each")
    lines = lines.where("each > 0").selectExpr("*", "total DIV each AS n", "CASE WHEN tabs = 0 THEN upto DIV each ELSE (upto - tabs) DIV each END AS own", "tabs = 0 AND upto % each = 0 AND upto > 0 AND upto < total AS between")
    lines = lines.selectExpr(
        "*", "sum(CASE WHEN between THEN 1 ELSE 0 END) OVER (PARTITION BY id, upto) AS gap", "row_number() OVER (PARTITION BY id, upto, between ORDER BY i) AS place",
        "max(CASE WHEN total % each <> 0 OR columns IS NOT NULL AND (rows <= 0 OR n <> rows) OR tabs > 0 AND own <> (upto - 1) DIV each THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS bad",
    ).where("bad = 0")
    stay = "CASE WHEN columns IS NULL THEN gap ELSE greatest(gap - coalesce(get(lead, CAST(own AS INT)), 0), 0) END"
    row = f"CASE WHEN between AND place <= {stay} THEN own - 1 ELSE least(own, n - 1) END"
    lines = lines.selectExpr("id", "i", "line", "tabs", "columns", "n", "lead", "trail", f"{row} AS row")
    held = lines.groupBy("id", "row").agg(F.expr("array_sort(collect_list(struct(i, line, tabs)))").alias("l"), F.first("columns").alias("columns"), F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("trail").alias("trail"))
    filled = "transform(filter(transform(l, (x, k) -> struct(k, x.tabs)), x -> x.tabs > 0), x -> x.k)"
    missed = "abs({0} - coalesce(get({1}, CAST(row AS INT)), 0))".format
    first, last = f"{filled}[0]", f"(size(l) - 1 - array_max({filled}))"
    cost = f"CASE WHEN columns IS NOT NULL THEN {LEAD_COST} * {missed(first, 'lead')} + CASE WHEN row = n - 1 THEN 0 ELSE {TRAIL_COST} * {missed(last, 'trail')} END END"
    return held.selectExpr("id", "row", "split(array_join(transform(l, x -> x.line), '\\n'), '\\t', -1) AS cells", f"{cost} AS cost")


def pasted(rows: DataFrame) -> DataFrame:
    """id, text: rows as a spreadsheet takes them, ends of rows as carriage return and line feed, cells with line feeds or quotes in quotes."""
    cell = "CASE WHEN contains(c, '\"') OR contains(c, '\\n') THEN concat('\"', replace(c, '\"', '\"\"'), '\"') ELSE c END"
    line = rows.selectExpr("id", "row", f"array_join(transform(cells, c -> {cell}), '\\t') AS line")
    return line.groupBy("id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(row, line))), x -> x.line), '\\r\\n')").alias("text"))
