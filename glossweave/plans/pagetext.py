"""Queries on page text: turns of conversations laid out on pages, character by character."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossweave.functions import pagetext, text
from glossweave.functions.dialect import Dialect, Oracle, Spark
from glossweave.operators import page_text, wrapping
from glossweave.plans import steps

ROLES = "CASE cls WHEN 3 THEN 'header' WHEN 1000 THEN 'table_cell' END"
#: Pages of a task.
PAGES = 300
#: Letters of every third conversation become Japanese characters.
LETTERS, KANA = "aeioutsn.,(", "のがを人社です日。、（"


def chars(d: Dialect) -> str:
    """A row per code point: lines of 50, paragraphs of five lines, columns of 17 in tables, wide spacing on some pages."""
    shown = f"CASE WHEN conv_id % 3 = 0 THEN {d.translate('text', LETTERS, KANA)} ELSE text END"
    found = d.all(shown, "(?s).")
    each = {
        "spark": f"SELECT conv_id, turn, page, CAST(k AS BIGINT) AS k, ch FROM conversations LATERAL VIEW posexplode({found}) AS k, ch",
        "oracle": f"SELECT conv_id, turn, unnest(range(len({found}))) AS k, unnest({found}) AS ch FROM conversations",
    }[d.name]
    page = {"spark": "page", "oracle": "conv_id * 1000 + turn AS page"}[d.name]
    placed = (
        f"SELECT {page}, k AS seq, ch, conv_id, turn, k, {d.div('k', '50')} AS line, {d.div('k', '250')} AS para, k % 50 AS col, {d.div('(k % 50)', '17')} AS cell, "
        f"CASE WHEN conv_id % 5 = 2 THEN 9 ELSE 6 END AS step, CASE (conv_id + {d.div('k', '250')}) % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1000 WHEN 4 THEN 1001 WHEN 5 THEN 2 ELSE CASE WHEN turn % 2 = 0 THEN -1 ELSE 0 END END AS cls "
        f"FROM ({each}) AS e WHERE NOT (ch = ' ' AND turn % 2 = 1)"
    )
    x = "(60.0 + col * step + CASE WHEN cls >= 1000 THEN cell * 8 WHEN line % 11 = 10 THEN cell * 20 ELSE 0 END + CASE WHEN line % 5 = 0 THEN 12 ELSE 0 END)"
    y = "(800.0 - line * 12 - para * 10 - CASE WHEN line % 13 = 12 THEN 2 ELSE 0 END)"
    size = "CASE WHEN line % 6 = 5 AND col > 20 THEN 12.0 ELSE 10.0 END"
    return (
        f"SELECT page, seq, ch, CAST({x} AS DOUBLE) AS x0, CAST({x} + 5.5 AS DOUBLE) AS x1, CAST({y} AS DOUBLE) AS y0, CAST({y} + {size} AS DOUBLE) AS y1, CAST({size} AS DOUBLE) AS size, {d.integer('cls')} AS cls, "
        f"CASE WHEN {d.div('k', '9')} % 23 = 5 THEN 'CMMI10' WHEN {d.div('k', '9')} % 23 = 11 THEN 'CMR10' ELSE 'Times' END AS font, "
        f"CASE WHEN cls >= 1000 THEN {d.integer('cell + 10 * line')} END AS cell_top, CASE WHEN cls >= 1000 AND line % 3 > 0 THEN {d.integer('cell + 10 * line')} END AS cell_base FROM ({placed}) AS p"
    )


def _chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages are dealt before they become characters, so no character moves; their number sets that of tasks, whose sorts stay small."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("*", "conv_id * 1000 + turn AS page")
    turns = turns.repartition(max(spark.sparkContext.defaultParallelism, turns.count() // PAGES + 1), "page")
    return spark.sql(steps.bound(chars(Spark()), ["conversations"]), conversations=turns)


def page_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before each character, with regions and by distances alone."""
    both = page_text.marked(_chars(spark, sf_dir))
    far = pagetext.boundary(False, **{k: str(v) for k, v in THRESHOLDS.items()})
    return both.selectExpr("page", "seq", "CAST(i AS BIGINT) AS i", "base", "kind", "formula", "v", f"{pagetext.boundary(False)} AS plain", f"{far} AS dynamic")


#: Thresholds as for a page of 800 points and a size of 12.
THRESHOLDS = {"paragraph": 21.6, "line": 3.6, "column": 160.0}


def page_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.formulas(page_text.marked(_chars(spark, sf_dir)))


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.paragraphs(page_text.fragments(page_text.marked(_chars(spark, sf_dir))))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.blocks(page_paragraphs(spark, sf_dir), ROLES)


def boxed(d: Dialect) -> str:
    """Turns as texts of boxes of several widths, sizes and languages; some boxes have no width, some sizes count as missing."""
    shown = f"CASE WHEN conv_id % 3 = 0 THEN {d.translate('text', LETTERS, KANA)} ELSE text END"
    fields = {
        "x0": "10.0 + turn * 3", "y0": "400.0 - turn", "x1": "10.0 + turn * 3 + CASE WHEN conv_id % 19 = 7 THEN 0 ELSE 30 + (conv_id * 37 + turn * 11) % 300 END", "y1": "400.0 - turn + 20 + conv_id % 90",
        "size": "CASE WHEN turn % 7 = 6 THEN 0 ELSE 8 + conv_id % 5 END", "first_x": "CASE WHEN turn % 2 = 0 THEN 14.0 + turn * 3 END", "first_y": "CASE WHEN turn % 3 = 0 THEN 415.0 - turn END",
    }
    numbers = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in fields.items())
    return f"SELECT conv_id * 1000 + turn AS id, {shown} AS text, {numbers}, CASE conv_id % 4 WHEN 0 THEN 'ja' WHEN 1 THEN 'en' WHEN 2 THEN 'zh-CN' ELSE 'xx' END AS lang, turn % 5 = 4 AS is_cell FROM conversations"


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(steps.bound(boxed(Spark()), ["conversations"]), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each text in its box, and where they go."""
    boxes = _boxed(spark, sf_dir)
    lines = wrapping.wrapped(boxes.selectExpr("id", "text", "x1 - x0 AS box", "size"))
    return wrapping.placed(lines, boxes.drop("text")).selectExpr("id", "line", "text", "round(height, 6) AS height", "x", "round(y, 6) AS y")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (page_boundaries, page_formulas, page_paragraphs, page_blocks, wrapped_lines)}


def _marked_sql() -> str:
    d = Oracle()
    sql = f"SELECT * FROM ({chars(d)}) AS c WHERE cls <> 0 AND ch <> ''"
    for name, expression in page_text.steps(d):
        sql = f"SELECT *, {expression} AS {name} FROM ({sql}) AS s"
    return sql


def _paragraphs_sql() -> str:
    """One fragment a page and step, by recursion over the text so far."""
    d = Oracle()
    p, last = "t", "right(t, 1)"
    stripped = text.right_stripped(d, p)
    cjk_all = d.like(stripped, f"^{pagetext.LAYOUT_CJK}{{1,2}}$")
    ends = text.one_of(text.SENTENCE_END_JA + text.SENTENCE_END_EN)
    tail = f"right({stripped}, 1)"
    next_cjk, last_cjk = pagetext.is_cjk(d, "n.ch"), pagetext.is_cjk(d, last)
    opened = d.like(tail, f"^{text.one_of(pagetext.OPENING_END)}$")
    latin = f"{d.like(stripped, '[A-Za-z]')} AND NOT {d.like(stripped, pagetext.LAYOUT_CJK)} AND NOT {d.like(tail, ends)} AND NOT {d.like(tail, text.one_of(text.UNITS_JA))} AND NOT {text.is_toc_line(d, p)} AND NOT {next_cjk}"
    hyphen = f"{d.like(last, text.one_of(text.HYPHENS))} AND {d.like('n.ch', r'^\p{Ll}')}"
    separator = (
        f"CASE WHEN t = '' OR {hyphen} THEN '' WHEN {d.like(last, ends)} THEN CASE WHEN {last_cjk} OR {next_cjk} THEN '' ELSE ' ' END "
        f"WHEN {last_cjk} AND ({next_cjk} OR {d.like('n.ch', pagetext.LAYOUT_LATIN)}) THEN '' WHEN {d.like(last, pagetext.LAYOUT_LATIN)} AND {next_cjk} THEN '' WHEN {d.like(last, '[ \t\n]')} THEN '' ELSE ' ' END"
    )
    return f"""
WITH RECURSIVE m AS MATERIALIZED ({_marked_sql()}),
f AS MATERIALIZED (
  SELECT page, fragment, string_agg(piece, '' ORDER BY i) AS text, max(kind) FILTER (starts) AS kind, max(ch) FILTER (starts) AS ch, coalesce(bool_or(gap > 1) FILTER (starts), false) AS apart,
    coalesce(bool_or({pagetext.spaced()}) FILTER (starts), false) AS spaced, coalesce(bool_or({pagetext.stacked()}) FILTER (starts), false) AS stacked,
    min(x0) FILTER (NOT formula) AS x0, min(y0) FILTER (NOT formula) AS y0, max(x1) FILTER (NOT formula) AS x1, max(y1) FILTER (NOT formula) AS y1, max(cls) FILTER (NOT formula) AS cls,
    arg_min(size, i) FILTER (NOT formula) AS size, arg_min(y0, i) FILTER (NOT formula) AS y, max(size) FILTER (NOT formula AND ch <> ' ') AS most, count(*) FILTER (NOT formula) AS n
  FROM m GROUP BY page, fragment),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY fragment) AS place FROM f),
r AS (
  SELECT page, place, 0::BIGINT AS paragraph, text AS t, false AS broken FROM o WHERE place = 1
  UNION ALL
  SELECT page, place, paragraph, CASE WHEN apart AND NOT {pagetext.is_cjk(d, 'right(u, 1)')} AND NOT {pagetext.is_cjk(d, 'ch')} AND right(u, 1) <> ' ' THEN u || ' ' ELSE u END || text, broken FROM (
    SELECT page, place, text, apart, ch, CASE WHEN new THEN paragraph + 1 ELSE paragraph END AS paragraph, NOT new AND broke AS broken,
      CASE WHEN new THEN '' WHEN NOT broke THEN t WHEN hyphen THEN left(t, length(t) - 1) ELSE t || separator END AS u FROM (
      SELECT *, kind <> 'break' AND NOT (opened OR wide OR below OR wrapped) AS new, kind = 'break' OR opened OR below OR wrapped AS broke FROM (
        SELECT n.page, n.place, n.text, n.apart, n.ch, n.kind, r.paragraph, r.t, {separator} AS separator, {hyphen} AS hyphen, {opened} AS opened,
          NOT {opened} AND {cjk_all} AND {next_cjk} AND n.spaced AS wide, NOT {opened} AND {cjk_all} AND {next_cjk} AND NOT n.spaced AND n.stacked AND n.kind = 'new' AS below,
          n.kind = 'new' AND {stripped} <> '' AND ({text.is_continuation(d, p)} OR {latin}) AS wrapped
        FROM r JOIN o AS n ON n.page = r.page AND n.place = r.place + 1)))),
s AS (SELECT r.*, o.x0, o.y0, o.x1, o.y1, o.cls, o.size, o.y, o.most, o.n FROM r JOIN o USING (page, place))
SELECT page, paragraph, arg_max(t, place) AS text, bool_or(broken) AS broken, sum(n)::BIGINT AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(cls) AS cls,
  greatest(arg_min(size, place) FILTER (size IS NOT NULL), max(most)) AS size,
  arg_min(y, place) FILTER (size IS NOT NULL) - (greatest(arg_min(size, place) FILTER (size IS NOT NULL), max(most)) - arg_min(size, place) FILTER (size IS NOT NULL)) AS y
FROM s GROUP BY page, paragraph"""


def _blocks_sql() -> str:
    sql = f"({_paragraphs_sql()})"
    for name, expression in page_text.block_steps(Oracle(), ROLES):
        sql = f"(SELECT *, {expression} AS {name} FROM {sql} AS s)"
    return f"SELECT page, paragraph, block, leader, page_number, role, skip, n_lines, is_cell, x0, y0, x1, y1, size, y FROM {sql} AS s WHERE bare <> ''"


def _wrapped_sql() -> str:
    """Line by line, by recursion; what fits is looked up among all places of a text."""
    single = lambda x: f"regexp_matches({x}, '^[{wrapping.SINGLE}]')"
    heights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in wrapping.LINE_HEIGHTS.items())
    return f"""
WITH RECURSIVE b AS MATERIALIZED (SELECT *, x1 - x0 AS box, CASE WHEN size > 0 THEN size ELSE 10.0 END AS own_size FROM ({boxed(Oracle())}) AS s),
l AS MATERIALIZED (SELECT id, box, own_size, unnest(range(len(string_split(text, chr(10))))) AS part, unnest(string_split(text, chr(10))) AS own, len(string_split(text, chr(10))) - 1 AS last FROM b WHERE text <> '' AND box > 0),
c AS (SELECT id, part, box, own_size, unnest(range(length(own) + 1)) AS p, unnest(list_concat(regexp_extract_all(own, '(?s).'), [''])) AS ch FROM l WHERE own <> ''),
w AS (SELECT *, CASE WHEN ch = '' THEN 0 WHEN {single('ch')} THEN own_size ELSE own_size / 2 END AS w, coalesce(lag(ch) OVER (PARTITION BY id, part ORDER BY p), ' ') AS before FROM c),
h AS MATERIALIZED (SELECT id, part, box, p, ch, sum(w) OVER (PARTITION BY id, part ORDER BY p) - w AS upto, before = ' ' OR ch = '' OR {single('ch')} OR {single('before')} AS joint, max(p) OVER (PARTITION BY id, part) AS n FROM w),
j AS MATERIALIZED (SELECT a.id, a.part, a.p, a.n, max(e.p) FILTER (e.joint AND e.p > a.p AND e.upto - a.upto <= a.box * (1 + 1e-9)) AS fits, max(e.p) FILTER (e.p = a.p + 1 OR e.upto - a.upto <= a.box * (1 + 1e-9)) AS chars, min(e.p) FILTER (e.joint AND e.p > a.p) AS token
  FROM h a JOIN h e ON a.id = e.id AND a.part = e.part AND e.p >= a.p AND e.p <= a.p + 200 WHERE a.p < a.n GROUP BY a.id, a.part, a.p, a.n),
s AS MATERIALIZED (SELECT j.*, coalesce(fits, chars) AS loose, fits IS NOT NULL OR chars = token AS cut, g.p AS held_blank, k.p AS loose_blank FROM j LEFT JOIN h g ON g.id = j.id AND g.part = j.part AND g.p = greatest(j.fits, j.token) AND g.ch = ' ' LEFT JOIN h k ON k.id = j.id AND k.part = j.part AND k.p = coalesce(j.fits, j.chars) AND k.ch = ' '),
r AS (
  SELECT id, part, p, q, n, whole, CASE WHEN at_joint AND blank IS NOT NULL THEN q + 1 ELSE q END AS next, at_joint AND blank IS NULL AS next_whole, at_joint, coalesce(at_joint AND blank = n - 1, false) AS dropped
  FROM (SELECT *, false AS whole, loose AS q, cut AS at_joint, loose_blank AS blank FROM s WHERE p = 0)
  UNION ALL
  SELECT id, part, p, q, n, whole, CASE WHEN at_joint AND blank IS NOT NULL THEN q + 1 ELSE q END, at_joint AND blank IS NULL, at_joint, coalesce(at_joint AND blank = n - 1, false)
  FROM (SELECT s.*, r.next_whole AS whole, CASE WHEN r.next_whole THEN greatest(s.fits, s.token) ELSE s.loose END AS q, r.next_whole OR s.cut AS at_joint, CASE WHEN r.next_whole THEN s.held_blank ELSE s.loose_blank END AS blank
    FROM r JOIN s ON s.id = r.id AND s.part = r.part AND s.p = r.next)),
t AS (
  SELECT r.id, r.part, r.p, CASE WHEN at_joint AND q < n THEN rtrim(substr(own, p + 1, q - p), ' ') ELSE substr(own, p + 1, q - p) END AS text FROM r JOIN l USING (id, part)
  UNION ALL SELECT r.id, r.part, n, '' FROM r JOIN l USING (id, part) WHERE dropped AND part < last
  UNION ALL SELECT id, part, 0, '' FROM l WHERE own = '' AND part < last
  UNION ALL SELECT id, 0, 0, text FROM b WHERE text <> '' AND box <= 0),
u AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, p) - 1 AS line, count(*) OVER (PARTITION BY id) AS n_lines, text FROM t),
v AS (SELECT u.*, b.* EXCLUDE (id, text), CASE lower(lang) {heights} ELSE 1.1 END::DOUBLE AS normal FROM u JOIN b USING (id)),
x AS (SELECT *, CASE WHEN y1 - y0 <= 0 OR box <= 0 THEN normal ELSE list_reduce(range(0, greatest(1, trunc((normal - 1.0) / 0.05)::BIGINT + 1)), lambda h, k: CASE WHEN k < trunc((normal - 1.0) / 0.05) + 1 AND n_lines * own_size * h > y1 - y0 AND h > 1.0 THEN h - 0.05 ELSE h END, normal) END AS lowered FROM v)
SELECT id, line, text, round(CASE WHEN y1 - y0 <= 0 OR box <= 0 THEN lowered ELSE greatest(1.0, lowered) END, 6) AS height, CASE WHEN line = 0 THEN coalesce(first_x, x0) ELSE x0 END AS x,
  round(coalesce(first_y, y0) - line * own_size * CASE WHEN y1 - y0 <= 0 OR box <= 0 THEN lowered ELSE greatest(1.0, lowered) END, 6) AS y FROM x"""


SQL: dict[str, str] = {
    "wrapped_lines": _wrapped_sql(),
    "page_boundaries": f"SELECT page, seq, i, base, kind, formula, v, {pagetext.boundary(False)} AS plain, {pagetext.boundary(False, **{k: str(v) for k, v in THRESHOLDS.items()})} AS dynamic FROM ({_marked_sql()}) AS m",
    "page_formulas": f"SELECT page, v, string_agg(ch, '' ORDER BY i) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min(font, i) AS font, arg_min(size, i) AS size FROM ({_marked_sql()}) AS m WHERE formula GROUP BY page, v",
    "page_paragraphs": _paragraphs_sql(),
    "page_blocks": _blocks_sql(),
}
