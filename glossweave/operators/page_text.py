"""Paragraphs, formulas and blocks from positioned characters.

All that depends on distances is decided in windows over a page: boundaries, formula runs, and fragments, which are
stretches of a line that nothing interrupts.  Only whether a fragment goes on with the paragraph before it needs the text so far; fragments,
sorted by page, stream through a fold that holds one paragraph.  No row and no task holds a whole page of characters.

Characters come as rows of page, seq, x0, y0, x1, y1, ch, font, size, cls and, for tables, cell_top and cell_base (null outside of
cells).  Null or empty characters and those of region 0 are left out.  They are read from top to bottom and left to right, ties by
seq.  A page of formulas alone has one paragraph without a box.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions import forms, lines, pagetext, text
from glossweave.functions.dialect import Dialect, Spark

LAGGED = ("x0", "y0", "x1", "ch", "size", "cls", "cell_base")
ORDER = "PARTITION BY page ORDER BY -y0, x0, seq"


def steps(d: Dialect, layout: bool = True) -> list[tuple[str, str]]:
    """Columns of each character that follow from its neighbour, from formula characters and from counts along the page."""
    upto = f"({ORDER} ROWS UNBOUNDED PRECEDING)"
    last = f"CASE WHEN pformula THEN '}}' ELSE {d.last('pch')} END"
    blank = f"gap > {pagetext.WORD_GAP} AND NOT {pagetext.is_cjk(d, last)} AND NOT {pagetext.is_cjk(d, 'ch')} AND {last} <> ' '"
    return [
        *[(f"p{c}", f"lag({c}) OVER ({ORDER})") for c in LAGGED],
        ("formula", forms.is_formula_char(d, "coalesce(font, '')", "ch")),
        ("pformula", f"coalesce(lag(formula) OVER ({ORDER}), false)"),
        *pagetext.distances().items(),
        ("base", pagetext.boundary(layout)),
        ("kind", pagetext.kind(d, layout)),
        ("i", f"row_number() OVER ({ORDER})"),
        ("v", f"CAST(sum(CASE WHEN formula AND NOT pformula THEN 1 ELSE 0 END) OVER {upto} AS BIGINT) - 1"),
        ("starts", "NOT formula AND kind <> 'none'"),
        ("fragment", f"CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER {upto} AS BIGINT)"),
        ("piece", f"CASE WHEN formula AND pformula THEN '' WHEN formula THEN '{{v' || v || '}}' WHEN NOT starts AND {blank} THEN ' ' || ch ELSE ch END"),
    ]


def marked(chars: DataFrame, layout: bool = True) -> DataFrame:
    """The characters that count, with their boundary (``kind``), formula number ``v`` and fragment."""
    df = chars.where(f"cls <> {pagetext.LEFT_OUT} AND ch <> ''")
    for name, expression in steps(Spark(), layout):
        df = df.selectExpr("*", f"{expression} AS {name}")
    return df


def _exprs(*columns: str) -> list[Column]:
    return [F.expr(c) for c in columns]


def formulas(chars: DataFrame) -> DataFrame:
    """page, v, text, box, font and size of each run of formula characters; from ``marked``."""
    return (
        chars.where("formula").groupBy("page", "v")
        .agg(*_exprs("array_join(transform(array_sort(collect_list(struct(i, ch))), c -> c.ch), '') AS text", "min(x0) AS x0", "min(y0) AS y0", "max(x1) AS x1", "max(y1) AS y1", "min_by(font, i) AS font", "min_by(size, i) AS size"))
    )


def fragments(chars: DataFrame) -> DataFrame:
    """A row per fragment: its text, how it starts, and box, sizes and region of its characters; from ``marked``."""
    d = Spark()
    start, plain = "FILTER (WHERE starts)", "FILTER (WHERE NOT formula)"
    return chars.groupBy("page", "fragment").agg(
        *_exprs(
            "array_join(transform(array_sort(collect_list(struct(i, piece))), c -> c.piece), '') AS text",
            f"max(kind) {start} AS kind", f"max(ch) {start} AS ch", f"coalesce(max(gap > {pagetext.WORD_GAP}) {start}, false) AS apart", f"coalesce(max({pagetext.spaced()}) {start}, false) AS spaced", f"coalesce(max({pagetext.stacked()}) {start}, false) AS stacked",
            *(f"{f} {plain} AS {n}" for f, n in (("min(x0)", "x0"), ("min(y0)", "y0"), ("max(x1)", "x1"), ("max(y1)", "y1"), ("max(cls)", "cls"), ("min_by(size, i)", "size"), ("min_by(y0, i)", "y"))),
            "max(size) FILTER (WHERE NOT formula AND ch <> ' ') AS most", f"count(*) {plain} AS n",
        )
    )


class _Paragraph:
    """The paragraph at hand."""

    def __init__(self, page: object, number: int) -> None:
        self.page, self.number, self.text, self.broken, self.box, self.n = page, number, "", False, None, 0

    def take(self, r: dict, text: str) -> None:
        self.text = text + r["text"]
        self.n += r["n"]
        if r["x0"] is None:
            return
        if self.box is None:
            self.box = [r["x0"], r["y0"], r["x1"], r["y1"], r["cls"], r["size"], r["y"]]
            self.first, b = (r["size"], r["y"]), self.box
        else:
            b = self.box
            b[:5] = min(b[0], r["x0"]), min(b[1], r["y0"]), max(b[2], r["x1"]), max(b[3], r["y1"]), max(b[4], r["cls"])
        # A larger size lowers the origin by what it adds, so only the largest counts.
        b[5] = max(b[5], r["most"] if r["most"] is not None else b[5])
        b[6] = self.first[1] - (b[5] - self.first[0])

    def row(self) -> tuple:
        return (self.page, self.number, self.text, self.broken, self.n, *(self.box or [None] * 7))


def _fold(rows: Iterator[dict]) -> Iterator[tuple]:
    now: _Paragraph | None = None
    for r in rows:
        if now is None or now.page != r["page"]:
            if now:
                yield now.row()
            now = _Paragraph(r["page"], 0)
            now.take(r, "")
            continue
        kind, char, so_far = r["kind"], r["ch"], now.text
        if kind == "break":
            new, broken = False, True
        else:
            opened = lines.ends_open(so_far)
            short = not opened and lines.is_short_cjk(so_far) and lines.is_cjk(char)
            wide, under = short and r["spaced"], short and not r["spaced"] and r["stacked"] and kind == "new"
            wrapped = kind == "new" and lines.wraps(so_far, char)
            new, broken = not (opened or wide or under or wrapped), opened or under or wrapped
        if new:
            yield now.row()
            now, so_far = _Paragraph(now.page, now.number + 1), ""
        elif broken:
            now.broken = True
            so_far = lines.joined_lines(so_far, char)
        now.take(r, lines.spaced(so_far, char) if r["apart"] else so_far)
    if now:
        yield now.row()


def paragraphs(found: DataFrame) -> DataFrame:
    """page, paragraph, text (formulas as numbered marks), broken, n, box, region, size and origin; from ``fragments``."""
    page = dict(found.dtypes)["page"]
    schema = f"page {page}, paragraph long, text string, broken boolean, n long, x0 double, y0 double, x1 double, y1 double, cls long, size double, y double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds: list[pa.Schema] = []

        def rows() -> Iterator[dict]:
            for batch in batches:
                if not kinds:
                    boxed = [(c, pa.int64() if c == "cls" else pa.float64()) for c in ("x0", "y0", "x1", "y1", "cls", "size", "y")]
                    kinds.append(pa.schema([("page", batch.schema.field("page").type), ("paragraph", pa.int64()), ("text", pa.string()), ("broken", pa.bool_()), ("n", pa.int64()), *boxed]))
                yield from batch.to_pylist()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds[0], strict=True)], schema=kinds[0])

        for row in _fold(rows()):
            out.append(row)
            if len(out) == 4096:
                yield batch()
                out.clear()
        if out:
            yield batch()

    wanted = found.selectExpr("page", "fragment", "text", "kind", "ch", "apart", "spaced", "stacked", *[f"CAST({c} AS DOUBLE) AS {c}" for c in ("x0", "y0", "x1", "y1", "size", "most", "y")], "CAST(cls AS BIGINT) AS cls", "n")
    return wanted.repartition("page").sortWithinPartitions("page", "fragment").mapInArrow(run, schema)


MARK = r"(?i)[{(\[]\s*v[\d\s]+\s*[})\]]"


def block_steps(d: Dialect, roles: str) -> list[tuple[str, str]]:
    """What a paragraph is as a block: its title where it ends in a leader and a page number, and whether it is to be translated."""
    bare = d.strip(d.sub("whole", MARK))
    return [
        ("whole", d.strip("text")),
        ("bare", bare),
        ("toc", text.is_toc_line(d, "bare")),
        ("title", "CASE WHEN toc THEN " + text.toc_title(d, "bare") + " END"),
        ("block", "CASE WHEN title <> '' THEN title ELSE whole END"),
        ("shown", "CASE WHEN title <> '' THEN title ELSE bare END"),
        ("page_number", "CASE WHEN title <> '' THEN " + text.toc_page(d, "bare") + " END"),
        ("leader", "CASE WHEN title <> '' THEN " + d.get(d.sub(text.right_stripped(d, "bare"), r"[ \x{3000}]*\p{Nd}(?:\p{Nd}|[ \x{3000}])*$"), text.one_of(text.LEADERS) + "+$") + " END"),
        ("role", f"CASE WHEN cls = {pagetext.PAGE_NUMBER} THEN coalesce({roles}, 'page_number') ELSE {roles} END"),
        ("skip", f"CASE WHEN cls = {pagetext.PAGE_NUMBER} OR coalesce(role, '') IN ('header', 'footer', 'page_header', 'page_footer') THEN true ELSE NOT {text.should_translate_pdf(d, 'shown')} END"),
        ("n_lines", f"CAST({pagetext.line_count(d, 'cls', '(y1 - y0)', 'size', 'broken')} AS BIGINT)"),
        ("is_cell", f"cls >= {pagetext.TABLES}"),
    ]


def blocks(found: DataFrame, roles: str = "CAST(NULL AS STRING)") -> DataFrame:
    """Paragraphs that are more than blanks and formulas, as blocks; ``roles`` gives the role of a region ``cls`` in SQL."""
    df = found
    for name, expression in block_steps(Spark(), roles):
        df = df.selectExpr("*", f"{expression} AS {name}")
    return df.where("bare <> ''").selectExpr("page", "paragraph", "block", "leader", "page_number", "role", "skip", "n_lines", "is_cell", "x0", "y0", "x1", "y1", "size", "y")
