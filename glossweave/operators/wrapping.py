"""Words wrapped into lines of a box, and where the lines go.

A text is cut into tokens: a character of a script without blanks, or a word with the blank behind it.  A line takes tokens while they fit.
A token that doesn't fit starts the next line, whole; only on an empty line it is cut between characters, and what is left of it then shares
its line with what follows.  A blank that would
start a line is dropped, and the blanks at the end of a full line as well.  A line feed ends a line, full or not.

Where a line that starts at a place ends does not depend on the lines before it, only on whether it began empty.  So the ends from
all places of a text follow from its running widths at once, and the lines from a walk along these ends.  Spark gives the widths; what a
text needs stays in its row, and no row meets another one.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a box by which widths may exceed it, for rounding.
TOLERANCE = 1e-9
# Heights of lines by language, the step and the least ones of their compression, sizes.
SINGLE = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{FF65}-\x{FF9F}"
LINE_HEIGHTS = {"ja": 1.1, "zh": 1.4, "zh-cn": 1.4, "zh-tw": 1.4, "ko": 1.2, "en": 1.2, "ar": 1.0, "ru": 0.8}
DEFAULT_HEIGHT, LEAST_HEIGHT, LEAST_TABLE_HEIGHT, HEIGHT_STEP, DEFAULT_SIZE = 1.1, 1.0, 1.0, 0.05, 10.0


def is_single(ch: str) -> str:
    """Whether a character is a token of its own."""
    return f"regexp_like({ch}, r'^[{SINGLE}]')"


_RANGES = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", SINGLE)]


def cut_lines(own: str, widths: np.ndarray, box: float) -> tuple[list[str], bool]:
    """The lines of a text without line feeds, and whether a blank was dropped after the last one."""
    n = len(own)
    codes = np.frombuffer(own.encode("utf-32-le", "surrogatepass"), "<u4")
    single = np.zeros(n, bool)
    for low, high in _RANGES:
        single |= (codes >= low) & (codes <= high)
    # A place p stands before the character p.
    joint = np.ones(n + 1, bool)
    joint[1:n] = single[1:] | single[:-1] | (codes[:-1] == 32)
    far = np.concatenate(([0.0], np.cumsum(widths))) / box
    places = np.arange(n + 1)
    chars = np.searchsorted(far, far + (1 + TOLERANCE), "right") - 1
    fits = np.maximum.accumulate(np.where(joint, places, 0))[chars]
    tokens = np.flatnonzero(joint)
    token = np.append(tokens[np.searchsorted(tokens, places[:-1], "right")], n)
    least = np.maximum(chars, places + 1)
    loose, held = np.where(fits > places, fits, least), np.maximum(fits, token)
    cut = (fits > places) | (least == token)
    lines, p, whole, dropped = [], 0, False, False
    while p < n:
        q, at_joint = (int(held[p]), True) if whole else (int(loose[p]), bool(cut[p]))
        lines.append(own[p:q].rstrip(" ") if at_joint and q < n else own[p:q])
        blank = at_joint and q < n and own[q] == " "
        dropped = blank and q == n - 1
        p, whole = (q + 1, False) if blank else (q, at_joint)
    return lines, dropped


def _wrap(text: str, widths: np.ndarray, box: float) -> list[str]:
    if box <= 0:
        return [text]
    out: list[str] = []
    parts, at = text.split("\n"), 0
    for i, own in enumerate(parts):
        lines, dropped = cut_lines(own, widths[at : at + len(own)], box) if own else ([], True)
        # A line feed ends a line with nothing in it, too; the end of a text does not.
        out += [*lines, ""] if dropped and i < len(parts) - 1 else lines
        at += len(own) + 1
    return out


def wrapped(texts: DataFrame, width: str = "CASE WHEN {single} THEN size ELSE size / 2 END") -> DataFrame:
    """id, line (from 0), text of each line; from id, text, box (its width), size.

    ``width`` is the width of the character ``ch`` in SQL, nothing or more.  Null and empty texts have no lines; a box without width takes the
    text as one line; a size of nothing or less counts as the default one.
    """

    @F.pandas_udf("array<string>")
    def wrap(text: pd.Series, widths: pd.Series, box: pd.Series) -> pd.Series:
        return pd.Series([_wrap(*r) for r in zip(text, widths, box, strict=True)], dtype=object)

    spark_size = f"CASE WHEN size > 0 THEN size ELSE {DEFAULT_SIZE} END"
    rows = texts.where("text <> '' AND box IS NOT NULL").selectExpr("id", "text", "CAST(box AS DOUBLE) AS box", f"CAST({spark_size} AS DOUBLE) AS size")
    each = f"transform(regexp_extract_all(text, '(?s).', 0), ch -> coalesce(CAST({width.format(single=is_single('ch'))} AS DOUBLE), 0D))"
    rows = rows.selectExpr("id", "text", "box", f"CASE WHEN box > 0 THEN {each} END AS widths")
    return rows.select("id", F.posexplode(wrap("text", "widths", "box")).alias("line", "text")).select("id", F.col("line").cast("long").alias("line"), "text")


def line_height(lang: str, n_lines: str, size: str, width: str, height: str, is_cell: str) -> str:
    """The height of a line as a multiple of the size: that of the language, less a step at a time until the lines fit or the least is reached."""
    normal = f"CASE lower({lang}) {' '.join(f"WHEN '{k}' THEN {v}D" for k, v in LINE_HEIGHTS.items())} ELSE {DEFAULT_HEIGHT}D END"
    least = f"CASE WHEN {is_cell} THEN {LEAST_TABLE_HEIGHT}D ELSE {LEAST_HEIGHT}D END"
    most = f"CAST(({normal} - {least}) / {HEIGHT_STEP}D AS INT) + 1"
    return (
        f"CASE WHEN {height} <= 0 OR {width} <= 0 THEN {normal} ELSE greatest({least}, aggregate(sequence(1, greatest(1, {most})), {normal}, "
        f"(h, k) -> CASE WHEN k <= {most} AND {n_lines} * {size} * h > {height} AND h > {least} THEN h - {HEIGHT_STEP}D ELSE h END)) END"
    )


def placed(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """id, line, text, x, y: lines below one another; from ``wrapped`` and boxes of id, x0, y0, x1, y1, size, lang, is_cell and, where known, first_x, first_y."""
    counted = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"))
    sized = boxes.selectExpr("*", f"CASE WHEN size > 0 THEN size ELSE {DEFAULT_SIZE} END AS own_size").join(counted, "id")
    sized = sized.selectExpr("*", f"{line_height('lang', 'n_lines', 'own_size', '(x1 - x0)', '(y1 - y0)', 'is_cell')} AS height")
    return lines.join(sized, "id").selectExpr("id", "line", "text", "height", "CASE WHEN line = 0 THEN coalesce(first_x, x0) ELSE x0 END AS x", "coalesce(first_y, y0) - line * own_size * height AS y")
