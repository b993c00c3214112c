"""Rules on positioned characters of a page, as portable expressions.

A character has x0, y0, x1, y1 (y grows upwards), ch, font, size and cls, its region: 0 is left out, 1 is background, from 2 on
are paragraphs, from 1000 on tables, -1 is a page number.  cell_top and cell_base name the table cell at its top and at its
base.  The character before it on the page has the same columns with a ``p`` in front.
"""

from __future__ import annotations

from glossweave.functions.dialect import Dialect
from glossweave.functions.forms import LAYOUT_CJK, LAYOUT_LATIN
from glossweave.functions.text import DIGIT, one_of

# Distances in points, factors and characters that results depend on.
SAME_LINE, SAME_PARAGRAPH, WORD_GAP, BREAK_BACK = 3.0, 20.0, 1.0, 1.0
COLUMN_JUMP, CELL_GAP, ROW_STEP, CONTENTS_RESET = 100.0, 15.0, 5.0, 80.0
NUMBER_GAP, LABEL_GAP, LABEL_FACTOR = 3.0, 1.0, 0.4
SPACED_MOST, SPACED_FACTOR, LINE_FACTOR, STACK_FACTOR = 40.0, 4.0, 0.3, 0.6
DEFAULT_SIZE, LINE_HEIGHT = 10.0, 1.1
LEFT_OUT, BACKGROUND, PARAGRAPHS, TABLES, PAGE_NUMBER = 0, 1, 2, 1000, -1
OPENING_SPLIT, CLOSING_SPLIT, OPENING_END = "(（「『【〔〈《", ")）」』】〕〉》", "(（「『【〔〈《｛［"
PERIODS, NEGATIVES = ".。", "△▲▼"


def is_cjk(d: Dialect, ch: str) -> str:
    return d.like(f"coalesce({ch}, '')", f"^{LAYOUT_CJK}")



def boundary(layout: bool, paragraph: str = str(SAME_PARAGRAPH), line: str = str(SAME_LINE), column: str = str(COLUMN_JUMP)) -> str:
    """What stands before a character: 'strong' or 'new' (a paragraph), 'break' (a line) or 'none'; from dy, gap, back and dx.

    dy is the distance of the bases, gap that from the end of the one before, back its opposite, dx that of the starts.
    """
    if not layout:
        return (
            f"CASE WHEN dy > {paragraph} THEN 'new' WHEN dx > {column} THEN CASE WHEN y0 > py0 THEN 'strong' ELSE 'break' END "
            f"WHEN dy > {line} AND back > {CONTENTS_RESET} THEN 'new' WHEN dy > {line} THEN 'break' ELSE 'none' END"
        )
    alike = f"(cls >= {PARAGRAPHS} AND pcls >= {PARAGRAPHS} AND (cls < {TABLES}) = (pcls < {TABLES}))"
    far = f"WHEN dy > {paragraph} THEN 'new' WHEN dy > {line} THEN 'break' ELSE 'none' END"
    return (
        f"CASE WHEN cls <> pcls AND cls <> {BACKGROUND} AND pcls <> {BACKGROUND} THEN CASE WHEN {alike} THEN 'new' ELSE 'strong' END "
        f"WHEN cls <> pcls THEN CASE {far} "
        f"WHEN gap > {CELL_GAP} THEN 'strong' "
        f"WHEN cls >= {TABLES} THEN CASE WHEN dy > {ROW_STEP} OR back > {column} THEN 'strong' WHEN dy > {line} THEN 'break' ELSE 'none' END "
        f"WHEN dy > {line} AND back > {CONTENTS_RESET} THEN 'new' {far}"
    )


def splits(d: Dialect, layout: bool) -> str:
    """Whether the characters themselves part here, whatever the distances say."""
    table = f"cls >= {TABLES}" if layout else "false"
    before_cjk = is_cjk(d, "pch")
    before_latin = f"({d.like('pch', f'^{LAYOUT_LATIN}')} AND NOT {d.like('pch', f'^{DIGIT}')})"
    size = f"CASE WHEN psize = 0 THEN {DEFAULT_SIZE} ELSE psize END"
    return (
        f"(cls <> pcls AND {PAGE_NUMBER} IN (cls, pcls) "
        f"OR gap > {WORD_GAP} AND ({d.like('ch', f'^{one_of(OPENING_SPLIT)}$')} OR {d.like('pch', f'^{one_of(CLOSING_SPLIT)}$')}) "
        f"OR gap > {NUMBER_GAP} AND {d.like('pch', f'^{one_of(PERIODS)}$')} AND {is_cjk(d, 'ch')} "
        f"OR {d.like('ch', f'^{DIGIT}+$')} AND CASE WHEN {table} THEN {before_cjk} AND gap >= 0 OR {before_latin} AND gap >= greatest({LABEL_GAP}, {size} * {LABEL_FACTOR}) ELSE {before_cjk} AND gap > {LABEL_GAP} END "
        f"OR {d.like('ch', f'^{one_of(NEGATIVES)}$')} AND CASE WHEN {table} THEN gap >= 0 ELSE gap > {LABEL_GAP} END)"
    )


def kind(d: Dialect, layout: bool) -> str:
    """The boundary with all that strengthens it; the first character of a page starts a paragraph."""
    cell = f"cls >= {TABLES} AND pcls = cls AND cell_top <> pcell_base" if layout else "false"
    return (
        f"CASE WHEN px0 IS NULL THEN 'new' WHEN coalesce({cell}, false) OR {splits(d, layout)} THEN 'strong' "
        f"WHEN base <> 'none' THEN base WHEN x1 < px0 - {BREAK_BACK} THEN 'break' ELSE 'none' END"
    )


def distances() -> dict[str, str]:
    return {"dy": "abs(y0 - py0)", "dx": "x0 - px0", "gap": "x0 - px1", "back": "px1 - x0"}


def spaced() -> str:
    """Next to the one before it on one line, as in a word with wide spacing."""
    size = f"CASE WHEN psize = 0 THEN {DEFAULT_SIZE} ELSE psize END"
    return f"coalesce(dy <= greatest({size} * {LINE_FACTOR}, {SAME_LINE}) AND gap >= 0 AND gap <= greatest({SPACED_MOST}, {size} * {SPACED_FACTOR}), false)"


def stacked() -> str:
    """Under the one before it, as in vertical writing."""
    size = f"CASE WHEN psize = 0 THEN {DEFAULT_SIZE} ELSE psize END"
    return f"coalesce(dy > greatest({size} * {LINE_FACTOR}, {SAME_LINE}) AND dy <= {SAME_PARAGRAPH} AND abs(dx) <= greatest(1.0, {size} * {STACK_FACTOR}), false)"


def line_count(d: Dialect, text_cls: str, height: str, size: str, broken: str) -> str:
    """Lines of a block: by its height in tables and where it was broken, else one."""
    even = {"spark": "bround", "oracle": "round_even"}[d.name]
    n = f"greatest(1.0, {even}({height} / (CASE WHEN {size} > 0 THEN {size} ELSE {DEFAULT_SIZE} END * {LINE_HEIGHT}), 0))"
    return f"CASE WHEN {text_cls} >= {TABLES} THEN {n} WHEN {broken} THEN greatest(2.0, {n}) ELSE 1.0 END"
